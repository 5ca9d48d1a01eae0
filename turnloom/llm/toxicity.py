"""Toxicity classifier with a counterfactual penalty.

A logistic model over words and word beginnings, fitted on a bounded sample of labelled rows. Every sampled text that
names a group is paired with the same text about another group, and the fit is charged for the squared change of the
score, so a mere mention of a group carries no weight of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import durable

# Terms that can stand for each other in a neutral sentence, one kind of group per line.
IDENTITY = (
    "people women men girls boys",
    "person woman man girl boy",
    "believers muslims christians jews hindus buddhists atheists",
    "religious muslim christian jewish hindu buddhist atheist",
    "straight gay lesbian bisexual transgender queer",
    "white black asian latino african arab european",
    "young old elderly disabled blind deaf",
    "gens femmes hommes filles garçons",
    "musulmans chrétiens juifs athées",
    "leute frauen männer mädchen jungen",
    "muslime christen juden atheisten",
    "gente mujeres hombres chicas chicos",
    "musulmanes cristianos judíos ateos",
)
WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6)
TERMS = {w: line.split()[(i + 1) % len(line.split())] for line in IDENTITY for i, w in enumerate(line.split())}


def text_features(text: str) -> set[str]:
    """Words of the lower-cased text and the first characters of longer words, each once."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def swapped_features(text: str) -> set[str]:
    """Features of the text with every identity term replaced by the next one of its line."""
    return text_features(WORD.sub(lambda m: TERMS.get(m[0], m[0]), text.lower()))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        """Weights by kind: of whole words, and of beginnings by their length."""
        whole = {f: w for f, w in self.weights.items() if not f.endswith("*")}
        starts = [(k, {f[:-1]: w for f, w in self.weights.items() if f.endswith("*") and len(f) == k + 1}) for k in BEGINNINGS]
        object.__setattr__(self, "kinds", (whole, [(k, table) for k, table in starts if table]))

    def score(self, text: str) -> float:
        whole, starts = self.kinds
        words = set(WORD.findall(text.lower()))
        total = self.bias + sum(map(whole.__getitem__, sorted(words & whole.keys())))
        for size, table in starts:  # a beginning counts once, also where several words share it
            total += sum(map(table.__getitem__, sorted({w[:size] for w in words if len(w) > size} & table.keys())))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: checksum of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """``toxic, text`` of at most ``most_rows`` labelled ids outside the held-out part, the least by a hash of the id.

    An id labelled more than once is toxic if any label says so; null labels are ignored. Only documents below the
    hash bound are joined, so the texts that move do not grow with the corpus.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", "toxic", order.alias("o"))
    bound = known.select("o").orderBy("o").limit(most_rows).agg(F.max("o")).first()[0]
    bound = -(1 << 63) if bound is None else bound
    near = docs.select("doc_id", "text").where((order <= bound) & ~held_out(F.col("doc_id")))
    return near.join(known.where(F.col("o") <= bound), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 16_000, most_features: int = 1024, penalty: float = 4.0, rounds: int = 400) -> Model:
    """Fit on at most ``most_rows`` labelled rows; ``penalty`` weighs the score change between counterfactual texts.

    The features are the ``most_features`` that set the two labels apart most; identity terms are always among them
    where they occur. Without labels of both kinds the model gives every text the share of toxic labels (0 for none).
    """

    @F.pandas_udf("own array<string>, swapped array<string>")
    def features(texts: pd.Series) -> pd.DataFrame:
        own = [text_features(t) for t in texts]
        # only a text with an identity term differs from its swapped form
        swapped = [sorted(swapped_features(t)) if o & TERMS.keys() else None for t, o in zip(texts, own, strict=True)]
        return pd.DataFrame({"own": [sorted(o) for o in own], "swapped": swapped})

    rows = training_rows(docs, labels, most_rows)
    rows = durable(rows.select("toxic", features("text").alias("f")).select("toxic", "f.own", "f.swapped"))
    total, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not total or not toxic or toxic == total:
        share = (toxic or 0) / total if total else 0.0
        return Model({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    counts = rows.select("toxic", F.explode("own").alias("feature")).groupBy("feature")
    # a feature of very few rows says little, and long texts hold many such
    counts = counts.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(3.0, total / 1000))
    share = toxic / total
    far = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    is_term = F.col("feature").isin(list(TERMS))
    best = counts.orderBy(is_term.desc(), far.desc(), "feature").limit(most_features)
    names = sorted(r.feature for r in best.select("feature").collect())
    index = {name: i for i, name in enumerate(names)}

    @F.pandas_udf("array<int>")
    def chosen(found: pd.Series) -> pd.Series:
        return pd.Series([sorted(index[f] for f in fs if f in index) for fs in found])

    # at most most_rows rows of a few feature numbers each
    sample = rows.select("toxic", chosen("own").alias("own"), chosen(F.coalesce("swapped", "own")).alias("swapped")).collect()
    sample.sort(key=lambda r: (r.own, r.swapped, r.toxic))
    x = Sparse([r.own for r in sample], len(names))
    y = np.array([r.toxic for r in sample], float)
    pairs = [r for r in sample if r.own != r.swapped]
    gained = Sparse([sorted(set(r.swapped) - set(r.own)) for r in pairs], len(names))
    lost = Sparse([sorted(set(r.own) - set(r.swapped)) for r in pairs], len(names))
    weights, bias = _descend(x, y, gained, lost, penalty, rounds)
    return Model({n: float(w) for n, w in zip(names, weights, strict=True)}, float(bias))


class Sparse:
    """A matrix of zeros and ones from the columns set in each row."""

    def __init__(self, rows: list[list[int]], width: int):
        self.at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.columns = np.array([c for r in rows for c in r], dtype=np.int64)
        self.height, self.width = len(rows), width

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, v[self.columns], self.height)

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, v[self.at], self.width)


def _descend(
    x: Sparse, y: np.ndarray, gained: Sparse, lost: Sparse, penalty: float, rounds: int, ridge: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss + ridge + penalty x mean squared score change of the swapped texts."""
    weights, bias = np.zeros(x.width), float(np.log(y.mean() / (1 - y.mean())))
    # per-feature step sizes: curvature is at most a quarter of the feature's share, plus the penalties'
    curve = 0.25 * x.transposed(np.ones(x.height)) / x.height * max(1.0, len(x.columns) / x.height) + ridge
    if gained.height:
        width = gained.times(np.ones(x.width)) + lost.times(np.ones(x.width))
        curve = curve + 2 * penalty * (gained.transposed(width) + lost.transposed(width)) / gained.height
    ahead_w, ahead_b, t = weights.copy(), bias, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(ahead_w) + ahead_b, -30, 30)))
        gap = (p - y) / len(y)
        grad = x.transposed(gap) + ridge * ahead_w
        if gained.height:
            change = gained.times(ahead_w) - lost.times(ahead_w)
            grad = grad + 2 * penalty * (gained.transposed(change) - lost.transposed(change)) / gained.height
        new_w = ahead_w - grad / curve
        new_b = ahead_b - float(gap.sum()) / 0.5
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w = new_w + (t - 1) / t_next * (new_w - weights)
        ahead_b = new_b + (t - 1) / t_next * (new_b - bias)
        weights, bias, t = new_w, new_b, t_next
    return weights, bias


def score_column(text: Column, model: Model) -> Column:
    """Score between 0 and 1 of a whole text; a null text counts as empty and gets the model's base rate."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t or "") for t in batch], dtype="float64")

    return scores(text)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row. Only the text decides a score; equal texts score alike."""
    rows = docs.select("doc_id", score_column(F.col("text"), fit(docs, labels, **options)).alias("score"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
