"""Token budgets inside one text: leading sentences, sections, chunks. No shuffle: a text is one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.functions.binding import let


def _lead(counts: Column, limit: int, include_crossing: bool) -> Column:
    """How many leading entries of ``counts`` fit the limit, with or without the one that crosses it."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, n: Column) -> Column:
        if include_crossing:
            full = acc["full"] | (acc["used"] >= limit)
        else:
            full = acc["full"] | (acc["used"] + n > limit)
        return F.struct(
            F.when(full, acc["used"]).otherwise(acc["used"] + n).alias("used"),
            F.when(full, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"),
            full.alias("full"),
        )

    return F.aggregate(counts, start, step, lambda acc: acc["kept"])


def leading_sentences(
    text: Column,
    limit: int,
    include_crossing: bool = False,
    keep_short: bool = True,
    tokens: tx.TokenCounter = tx.token_count,
) -> Column:
    """Leading sentences within a token budget, joined by blanks.

    The default stops before the sentence that would overflow and leaves texts within the budget untouched
    (``keep_short``). ``include_crossing`` keeps the overflowing sentence and ends with a blank.
    """

    def cut(sents: Column) -> Column:
        n = _lead(F.transform(sents, lambda s: tokens(s)), limit, include_crossing)
        joined = F.array_join(F.slice(sents, F.lit(1), n), " ")
        if include_crossing:
            return F.when(F.size(sents) > 0, F.concat(joined, F.lit(" "))).otherwise(F.lit(""))
        return tx.strip(joined)

    shortened = let(tx.sentences(text), cut)
    if keep_short and not include_crossing:
        return F.when(tokens(text) <= limit, text).otherwise(shortened)
    return shortened


def paper_context(
    names: Column,
    sections: Column,
    article: Column,
    wanted: Sequence[str] = ("abstract", "introduction"),
    limit: int = 1000,
    fallback_words: int = 1000,
    tokens: tx.TokenCounter = tx.token_count,
) -> Column:
    """Model context of a paper: the first section matching each wanted name, in the wanted order.

    Without section names the leading sentences within ``limit`` tokens (crossing one included); with names
    but no match the first ``fallback_words`` words.
    """

    def find(lowered: Column, name: str) -> Column:
        at = F.array_position(F.transform(lowered, lambda s: s.contains(name)), F.lit(True)).cast("int")
        return let(at, lambda i: F.when(i > 0, F.get(sections, i - 1)))

    def pick(lowered: Column) -> Column:
        hits = F.array_compact(F.array(*[find(lowered, w) for w in wanted]))
        return let(
            hits,
            lambda h: F.when(F.size(h) > 0, F.array_join(h, "\n")).otherwise(tx.first_words(article, fallback_words)),
        )

    unnamed = names.isNull() | (F.size(names) == 0)
    whole = leading_sentences(article, limit, include_crossing=True, tokens=tokens)
    return F.when(unnamed, whole).otherwise(let(F.transform(names, F.lower), pick))


def sentence_chunks(text: Column, words_per_chunk: int = 350) -> Column:
    """Join consecutive sentences into roughly ``words_per_chunk``-word chunks.

    The number of sentences per chunk is sentences // (words // words_per_chunk + 1), at least one.
    """

    def chunk(parts: Column) -> Column:
        n = F.size(parts["s"])
        per = F.greatest((n / (F.floor(parts["w"] / F.lit(words_per_chunk)) + 1)).cast("int"), F.lit(1))
        starts = lambda k: F.sequence(F.lit(1), n, k)
        return let(
            per,
            lambda k: F.transform(starts(k), lambda i: F.array_join(F.slice(parts["s"], i, k), " ")),
        )

    sents = let(tx.sentences(text), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.lit(""))))
    return let(F.struct(sents.alias("s"), tx.word_count(text).alias("w")), chunk)


def within_budget(
    df: DataFrame, column: str, limit: int, tokens: tx.TokenCounter = tx.token_count, name: str = "n_tokens"
) -> DataFrame:
    """Rows whose text holds strictly fewer than ``limit`` tokens, with the count."""
    return df.withColumn(name, tokens(F.col(column))).where(F.col(name) < limit)


def budget_report(
    df: DataFrame, column: str, limit: int, tokens: tx.TokenCounter = tx.token_count
) -> DataFrame:
    """Largest count and number of rows before and after the length gate, in one pass."""
    n = tokens(F.col(column))
    fits = F.col("n") < limit
    return df.select(n.alias("n")).agg(
        F.count("*").alias("rows_before"),
        F.max("n").alias("max_before"),
        F.count(F.when(fits, 1)).alias("rows_after"),
        F.max(F.when(fits, F.col("n"))).alias("max_after"),
    )
