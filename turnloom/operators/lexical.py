"""Overlap metrics: ROUGE, BLEU, distinct-n. Pairs are rows ``(item, a, b)``; no pair of texts leaves its row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions import text as tx
from turnloom.functions.binding import let
from turnloom.functions.grams import ngrams, shared, tagged, widest
from turnloom.functions.stemming import stem_all
from turnloom.session import bound_batches


def f_measure(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pd.Series) -> pd.Series:
    return stem_all(tokens)


def common_length(x: Sequence[str], y: Sequence[str]) -> int:
    """Length of the longest common subsequence: one bit-parallel sweep per token of ``y``."""
    places: dict[str, int] = {}
    for i, t in enumerate(x):
        places[t] = places.get(t, 0) | (1 << i)
    full = (1 << len(x)) - 1
    row = full
    for t in y:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(x, y) for x, y in zip(a, b)], dtype="int32")


def _prepared(pairs: DataFrame, item: str, a: str, b: str, stem: bool) -> DataFrame:
    prepared = pairs.select(item, tx.lexical_tokens(F.col(a)).alias("_a"), tx.lexical_tokens(F.col(b)).alias("_b"))
    if stem:
        # once per row: a deterministic call is evaluated again in every expression that it is merged into
        stemmed = _stemmed.asNondeterministic()
        prepared = prepared.select(item, stemmed("_a").alias("_a"), stemmed("_b").alias("_b"))
    return prepared


def _scored(both: Column, in_a: Column, in_b: Column) -> Column:
    """Precision, recall and F from counts of what two texts share and hold; a null text holds nothing."""
    part = lambda whole: F.coalesce(F.try_divide(both, whole), F.lit(0.0))
    return let(F.struct(part(in_b).alias("p"), part(in_a).alias("r")), lambda s: F.struct(
        s["p"].alias("precision"), s["r"].alias("recall"), f_measure(s["p"], s["r"]).alias("f")
    ))


def _gram_scores(n: int) -> Column:
    def of(grams: Column) -> Column:
        return _scored(shared(tagged(grams["a"]), tagged(grams["b"])), F.size(grams["a"]), F.size(grams["b"]))

    none = F.array().cast("array<string>")
    side = lambda tokens: ngrams(F.coalesce(tokens, none), n)
    return let(F.struct(side(F.col("_a")).alias("a"), side(F.col("_b")).alias("b")), of)


def rouge_scores(
    pairs: DataFrame, kinds: Sequence[str] = ("1", "L"), item: str = "item_id", a: str = "a", b: str = "b", stem: bool = True
) -> DataFrame:
    """``precision, recall, f`` of target ``a`` and prediction ``b`` for each kind in a column ``rouge<kind>``.

    A kind is a number for n-grams or ``L`` for the longest common subsequence. Texts are cut and stemmed once for all
    kinds and compared in their row: nothing is shuffled. Empty and null texts score 0.
    """
    bound_batches(pairs.sparkSession)
    prepared = _prepared(pairs, item, a, b, stem)
    if "L" in kinds:
        whole = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
        prepared = prepared.withColumn("_lcs", lcs_length(whole("_a"), whole("_b")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    score = {k: _scored(F.col("_lcs"), size("_a"), size("_b")) if k == "L" else _gram_scores(int(k)) for k in kinds}
    return prepared.select(item, *[score[k].alias(f"rouge{k}") for k in kinds])


def rouge_n(
    pairs: DataFrame, n: int = 1, item: str = "item_id", a: str = "a", b: str = "b", stem: bool = True
) -> DataFrame:
    """Clipped n-gram overlap of target ``a`` and prediction ``b``: precision, recall, F per item."""
    return rouge_scores(pairs, (str(n),), item, a, b, stem).select(item, f"rouge{n}.*")


def rouge_l(
    pairs: DataFrame, item: str = "item_id", a: str = "a", b: str = "b", stem: bool = True
) -> DataFrame:
    """Longest common subsequence over the two token lists: precision, recall, F per item."""
    return rouge_scores(pairs, ("L",), item, a, b, stem).select(item, "rougeL.*")


def rouge(
    pairs: DataFrame, kinds: Sequence[str] = ("1", "L"), item: str = "item_id", a: str = "a", b: str = "b", stem: bool = True
) -> DataFrame:
    """F scores side by side as ``rouge1_f``, ``rouge2_f``, ``rougeL_f``."""
    return rouge_scores(pairs, kinds, item, a, b, stem).select(item, *[F.col(f"rouge{k}.f").alias(f"rouge{k}_f") for k in kinds])


def _set_f(p_set: Column, c_set: Column) -> Column:
    both = F.size(F.array_intersect(p_set, c_set))
    p = F.try_divide(both.cast("double"), F.size(p_set).cast("double"))
    r = F.try_divide(both.cast("double"), F.size(c_set).cast("double"))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def _grid_sets(text: Column, n: int) -> Column:
    words = lambda s: tx.words(F.replace(s, F.lit("."), F.lit(" ")))
    return F.transform(tx.sentences(text), lambda s: F.array_distinct(ngrams(words(s), n)))


def rouge_grid(pairs: DataFrame, n: int = 1, item: str = "item_id", premise: str = "a", claim: str = "b") -> DataFrame:
    """Sentence-grid ROUGE-n: for each claim sentence the best premise sentence, averaged; 0 without claim.

    Sentences are compared as sets of n-grams inside the row, so the grid needs no shuffle and no pair rows.
    """
    grid = pairs.select(item, _grid_sets(F.col(premise), n).alias("_p"), _grid_sets(F.col(claim), n).alias("_c"))
    best = lambda c: F.array_max(F.transform(F.col("_p"), lambda p: _set_f(p, c)))
    scores = F.transform(F.col("_c"), lambda c: F.coalesce(best(c), F.lit(0.0)))
    return grid.select(item, mean_of(scores).alias("score"))


class Sentences:
    """Sentences side by side for common subsequences: a word's places as bits, 64 words of a sentence in each number."""

    def __init__(self, sentences: Sequence[Sequence[str]]):
        self.sizes = np.array([len(s) for s in sentences], np.int64)
        self.shape = (len(sentences), max(1, -(-int(self.sizes.max(initial=0)) // 64)))
        self.places: dict[str, np.ndarray] = {}
        for i, sentence in enumerate(sentences):
            for at, word in enumerate(sentence):
                if word not in self.places:
                    self.places[word] = np.zeros(self.shape, np.uint64)
                self.places[word][i, at // 64] |= np.uint64(1 << at % 64)

    def common_lengths(self, words: Iterable[str]) -> np.ndarray:
        """Length of the longest common subsequence of ``words`` with each sentence: one sweep over all per word."""
        row = np.full(self.shape, ~np.uint64(0))
        for word in words:
            places = self.places.get(word)
            if places is None:
                continue
            hit = row & places
            carry = np.zeros(self.shape[0], np.uint64)
            for w in range(self.shape[1]):
                half = row[:, w] + hit[:, w]
                total = half + carry
                carry = ((half < hit[:, w]) | (total < half)).astype(np.uint64)
                row[:, w] = total | (row[:, w] & ~hit[:, w])
        # bits behind a sentence's end have no place and stay
        return np.bitwise_count(~row).sum(axis=1, dtype=np.int64)


@F.pandas_udf(T.DoubleType())
def _lcs_grid(premise: pd.Series, claim: pd.Series) -> pd.Series:
    """Mean over claim sentences of the best LCS F with a premise sentence; a premise is prepared once for all."""
    out = []
    for ps, cs in zip(premise, claim):
        if ps is None or cs is None or not len(ps) or not len(cs):
            out.append(0.0)
            continue
        side = Sentences(ps)
        best = [(2.0 * side.common_lengths(c) / np.maximum(side.sizes + len(c), 1)).max() for c in cs]
        out.append(float(sum(best) / len(cs)))
    return pd.Series(out, dtype="float64")


def rouge_grid_l(pairs: DataFrame, item: str = "item_id", premise: str = "a", claim: str = "b") -> DataFrame:
    """Sentence-grid ROUGE-L: for each claim sentence the best F with a premise sentence, averaged; 0 without claim."""
    words = lambda s: tx.words(F.replace(s, F.lit("."), F.lit(" ")))
    side = lambda c: F.transform(tx.sentences(F.col(c)), words)
    return pairs.select(item, _lcs_grid(side(premise), side(claim)).alias("score"))


def mean_of(scores: Column) -> Column:
    """Mean of an array of doubles, 0 when empty."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    return let(scores, lambda xs: F.when(F.size(xs) > 0, total(xs) / F.size(xs)).otherwise(F.lit(0.0)))


def sentence_bleu(refs: Column, hyps: Column, weights: Sequence[float]) -> Column:
    """BLEU of each token list of ``hyps`` against all of ``refs``: clipped n-gram precision, closest-length penalty.

    A gram counts as often as the reference that has it most often. An order of weight 0 is not looked at, but without
    a common word the score is 0; so it is where an order has no common gram.
    """
    used = [k for k, w in enumerate(weights, start=1) if w > 0]
    orders = sorted({1, *used})

    def caps(rs: Column) -> Column:
        return F.struct(*[widest(F.transform(rs, lambda r: tagged(ngrams(r, k)))).alias(f"c{k}") for k in orders])

    def score(hyp: Column, rs: Column, cap: Column) -> Column:
        hits = F.struct(*[shared(tagged(ngrams(hyp, k)), cap[f"c{k}"]).alias(f"h{k}") for k in orders])
        size = F.size(hyp)
        closest = F.array_min(F.transform(rs, lambda r: F.struct(F.abs(F.size(r) - size).alias("d"), F.size(r).alias("n"))))["n"]

        def of(h: Column) -> Column:
            logs = sum((F.lit(weights[k - 1]) * F.log(h[f"h{k}"] / (size - (k - 1))) for k in used), F.lit(0.0))
            penalty = F.least(F.lit(1.0), F.exp(1 - closest / size))
            some = F.lit(True)
            for k in orders:
                some = some & (h[f"h{k}"] > 0)
            return F.when(some, penalty * F.exp(logs)).otherwise(F.lit(0.0))

        return let(hits, of)

    return let(refs, lambda rs: let(caps(rs), lambda cap: F.transform(hyps, lambda hyp: score(hyp, rs, cap))))


def bleu(
    pairs: DataFrame,
    n: int = 4,
    item: str = "item_id",
    premise: str = "a",
    claim: str = "b",
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """Sentence BLEU of each claim sentence against all premise sentences, averaged per item; 0 without claim."""
    weights = tuple(weights) if weights is not None else (1.0 / n,) * n
    side = lambda c: F.transform(tx.sentences(F.col(c)), tx.words)
    return pairs.select(item, mean_of(sentence_bleu(side(premise), side(claim), weights)).alias("score"))


def bleu_of_tokens(
    base: DataFrame, item: str, n: int = 4, weights: Sequence[float] | None = None
) -> DataFrame:
    """BLEU per (item, hyp) from ``_refs`` and ``_hyps``, arrays of token lists; a null score without hypothesis."""
    weights = tuple(weights) if weights is not None else (1.0 / n,) * n
    scored = base.select(item, sentence_bleu(F.col("_refs"), F.col("_hyps"), weights).alias("_bleu"))
    return scored.select(item, F.posexplode_outer("_bleu").alias("hyp", "bleu"))


def distinct_n(texts: DataFrame, by: str, text: str = "text", n: int = 1) -> DataFrame:
    """Distinct n-grams over all n-grams of a group's texts."""
    grams = texts.select(by, F.explode(ngrams(tx.words(F.col(text)), n)).alias("_g"))
    counts = grams.groupBy(by, "_g").agg(F.count("*").alias("_c"))
    return counts.groupBy(by).agg(
        F.count("*").alias("n_distinct"),
        F.sum("_c").alias("n_grams"),
        (F.count("*") / F.sum("_c")).alias("distinct_ratio"),
    )
