"""Ranked lexical search, term at a time with a limited set of accumulators.

One pass over the texts stores what the queries can ask for: each document's length and how often it holds each query
term. From that table come the counts that weigh the terms, and every task then searches its own documents: a query's
terms are taken rarest first, each posting adds its share to its document's accumulator, and once the greatest shares
of the terms that remain cannot lift a new document to the k-th best partial score, no accumulators are created any
more; those that exist go on to their exact scores. The k-th best score of a task's earlier documents counts too.
A task returns k documents per query at most, so nothing but these is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import durable

DEPTH = 50
#: Terms of queries, repeats in other queries counted, that are searched for in one pass: the size of what is broadcast.
BLOCK = 100_000
#: Documents whose accumulators are held at once.
DOCUMENTS = 8192
#: Top lists of tasks are merged by query and so many slices before they are merged by query.
SLICES = 64

_TERM = b"0123456789abcdefghijklmnopqrstuvwxyz"
# bytes of terms as they are, A-Z lower-cased, bytes of characters beyond ASCII kept, all others a space
_FOLD = bytes(b if b >= 128 or bytes([b]).lower() in _TERM else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8: runs of ASCII letters, digits and all characters beyond ASCII."""
    return (text or "").encode("utf-8").translate(_FOLD).split(b" ") if text else []


class Queries(NamedTuple):
    """Queries of one pass: their ids, and for each the numbers of its terms in ``words``."""

    ids: list
    words: dict[bytes, int]
    asked: list[list[int]]


def query_blocks(items: DataFrame, block: int = BLOCK) -> Iterator[Queries]:
    """The rows of ``item_id, text`` in blocks of about ``block`` terms; rows of one id are one query of all their terms."""

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({t for t in terms(text) if t}) for text in texts])

    each = durable(items.select("item_id", F.explode(cut("text")).alias("term")).distinct())
    parts = max(1, -(-each.count() // block))
    for part in range(parts):
        own = each.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else each
        words: dict[bytes, int] = {}
        asked: dict = {}
        for row in own.toLocalIterator():
            asked.setdefault(row["item_id"], []).append(words.setdefault(bytes(row["term"]), len(words)))
        yield Queries(list(asked), words, list(asked.values()))


def held_terms(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """``id, missing, n, term, tf``: each document's number of terms and the query terms it holds; documents without a term are left out.

    ``missing`` marks documents without an id.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = sent.value.get
        for batch in batches:
            size, held, times = [], [], []
            for text in batch.pop("text"):
                all_terms = terms(text)
                n = len(all_terms) - all_terms.count(b"")
                found = Counter(map(number, all_terms))
                found.pop(None, None)
                size.append(n)
                held.append(np.fromiter(found.keys(), np.int32, len(found)))
                times.append(np.fromiter(found.values(), np.int32, len(found)))
            yield batch.assign(n=size, term=held, tf=times)

    rows = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing"), "text")
    return rows.mapInPandas(count, "id long, missing boolean, n long, term array<int>, tf array<int>").where("n > 0")


def weights(number: int, df: dict[int, int], words: int) -> np.ndarray:
    """Weight of each term among ``number`` documents; a term in no document has that of none."""
    return np.array([math.floor(1000 * math.log((2 * number + 2) / (2 * df.get(t, 0) + 1))) for t in range(words)], np.int64)


def search(postings: list[tuple[np.ndarray, np.ndarray]], documents: int, depth: int, floor: int = 0) -> np.ndarray:
    """Scores of the documents that may be among the best ``depth`` or reach ``floor``, exact; 0 for all others.

    ``postings`` has the query's terms, rarest first, each with the numbers of its documents and what it adds to them.
    """
    scores, created = np.zeros(documents, np.int64), np.zeros(documents, bool)
    rest = sum(int(gain.max()) for _, gain in postings)
    growing = True
    for at, gain in postings:
        if growing:
            # a new document ends at ``rest`` or below; an equal score may still win by its id
            growing = rest >= max(floor, 1)
            if growing and np.count_nonzero(created) >= depth:
                growing = rest >= np.partition(scores[created], -depth)[-depth]
        rest -= int(gain.max())
        if growing:
            created[at] = True
            scores[at] += gain
        else:
            alive = created[at]
            scores[at[alive]] += gain[alive]
    return scores


def _inverted(term: np.ndarray, at: np.ndarray, gain: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    term, at, gain = term[order], at[order], gain[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(term))
    return {int(term[s]): (at[s:e], gain[s:e]) for s, e in zip(starts, ends, strict=True)}


def _best(found: pd.DataFrame, depth: int) -> pd.DataFrame:
    return found.sort_values(["score", "missing", "id"], ascending=[False, True, True], kind="stable").head(depth)


def _searched(index: DataFrame, queries: Queries, depth: int) -> DataFrame:
    """``query, id, missing, score``: the best documents of each query, from every task its own."""
    sums = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    number, length = sums[0], sums[1]
    df = {r["term"]: r["n"] for r in index.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = weights(number, df, len(queries.words))
    rarest = [sorted((t for t in asked if t in df), key=lambda t: (df[t], t)) for asked in queries.asked]
    sent = index.sparkSession.sparkContext.broadcast((weight, rarest))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, rarest = sent.value
        tops: dict[int, pd.DataFrame] = {}
        for whole in batches:
            for start in range(0, len(whole), DOCUMENTS):
                batch = whole.iloc[start : start + DOCUMENTS]
                sizes = batch["term"].map(len).to_numpy()
                at = np.repeat(np.arange(len(batch)), sizes)
                term, tf = (np.concatenate(batch[c].to_list()).astype(np.int64) for c in ("term", "tf"))
                m = 100 - 50 + (50 * batch["n"].to_numpy(np.int64) * number) // length
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
                lists = _inverted(term, at, gain)
                for query, order in enumerate(rarest):
                    top = tops.get(query)
                    floor = int(top["score"].iloc[-1]) if top is not None and len(top) == depth else 0
                    scores = search([lists[t] for t in order if t in lists], len(batch), depth, floor)
                    hits = np.flatnonzero(scores >= max(floor, 1))
                    if len(hits) > depth:
                        hits = hits[scores[hits] >= np.partition(scores[hits], -depth)[-depth]]
                    if len(hits):
                        new = batch.iloc[hits][["id", "missing"]].assign(score=scores[hits])
                        tops[query] = _best(new if top is None else pd.concat([top, new]), depth)
        for query, top in tops.items():
            yield top.assign(query=query)[["query", "id", "missing", "score"]]

    return index.mapInPandas(scan, "query int, id long, missing boolean, score long")


def ranked(docs: DataFrame, items: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``depth`` best documents of every item with a score above 0.

    Equal scores go by ascending ``doc_id``, documents without an id behind all others. Repeated rows of ``docs`` are
    documents of their own; rows of ``items`` with one id are one item with all their terms. A null or empty text has
    no terms: such a document is not counted and never found, such an item has no rows. Empty tables give no rows.
    Items are searched for in blocks of ``block`` terms, each with one pass over the texts; what a block broadcasts and
    brings to the driver, its terms and their counts, is bounded by its size.
    """
    spark, found = docs.sparkSession, []
    kind = items.schema["item_id"].dataType.simpleString()
    for queries in query_blocks(items, block):
        if not queries.ids:
            continue
        index = durable(held_terms(docs, queries.words))
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {kind}")
        # a document without any term makes a sum over none: there is nothing to search
        hits = _searched(index, queries, depth) if not index.isEmpty() else None
        if hits is not None:
            best = [F.col("score").desc(), F.col("missing"), F.col("id")]
            slices = Window.partitionBy("query", F.pmod(F.xxhash64("id"), F.lit(SLICES))).orderBy(*best)
            hits = hits.withColumn("rank", F.row_number().over(slices)).where(F.col("rank") <= depth)
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= depth)
            found.append(hits.join(names, "query").select("item_id", "rank", F.when(~F.col("missing"), F.col("id")).alias("doc_id"), "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
