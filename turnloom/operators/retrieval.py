"""Lexical retrieval (BM25) over an inverted index with exact top lists, and ranking metrics.

The index has one row per block of postings: a term's documents and what the term adds to each, with the highest of
these. Frequent terms have many blocks. A query's terms reach the blocks of those terms only, and not all of them:
its rarest terms first give scores that the k-th best document reaches at least. Terms that together cannot lift a
document above that bring no candidates; they are only looked up for candidates that can still reach it.

Queries whose terms are few enough to be sent to every task need no such index: one pass over the texts keeps what they
can ask for, each task adds up the scores of its own documents and returns its best of each query, and nothing but these
is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.functions.binding import let
from turnloom.functions.grams import by_run, run_starts
from turnloom.session import durable

K1, B = 1.2, 0.75
#: Postings in a block, at most about; a term with more has its documents dealt over several blocks.
BLOCK = 4096
#: Postings, per wanted document, that the rarest terms of a query may have for the first scores.
FIRST = 20
#: Words of all queries up to which they are sent to every task; more go by the index.
SENT = 1 << 16
#: Scores are sums of doubles in any order: bounds are taken this much wider.
SLACK = 1e-7


class Index(NamedTuple):
    """``blocks``: ``term, block, docs, gains, top``; ``terms``: ``term, df, top``, both without the terms' own weight."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int


def n_terms(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")), F.lit(0))


def term_counts(text: Column) -> Column:
    """``array<struct<term, n>>``: each term of a text once with its number of occurrences."""
    entry = lambda run: F.struct(F.get(run, F.lit(0)).alias("term"), F.size(run).alias("n"))
    return let(F.sort_array(tx.lexical_tokens(text)), lambda ts: let(run_starts(ts), lambda starts: by_run(ts, starts, entry)))


def build_index(
    corpus: DataFrame, vocabulary: DataFrame | None = None, doc: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, block: int = BLOCK
) -> Index:
    """Index of ``corpus``, of the terms of ``vocabulary(term)`` only if it is given.

    Terms are counted inside each row, so a document's terms are shuffled once each, in blocks. Documents without a
    term count for the average length and have no postings.
    """
    length = n_terms(F.col(text))
    size = corpus.agg(F.count("*").alias("n"), F.avg(length).alias("avgdl")).first()
    n_docs, avgdl = size["n"], float(size["avgdl"] or 1.0)
    # in a step of its own: beside an explode the length would be taken for each term
    bags = corpus.select(F.col(doc).alias("doc"), length.alias("dl"), term_counts(F.col(text)).alias("bag"))
    tf = F.col("e.n")
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    # outer: otherwise the terms would be counted once more to find texts without any
    each = bags.select("doc", "dl", F.explode_outer("bag").alias("e")).where("e is not null")
    postings = each.select("e.term", "doc", gain.alias("gain"))
    if vocabulary is not None:
        postings = postings.join(vocabulary, "term")
    postings = durable(postings)
    terms = durable(postings.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("top")))
    parts = F.greatest(F.ceil(F.col("df") / block), F.lit(1))
    dealt = postings.join(terms.select("term", "df"), "term").withColumn("block", F.pmod(F.xxhash64("doc"), parts))
    blocks = dealt.groupBy("term", "block").agg(  # about ``block`` postings each
        F.collect_list(F.struct("doc", "gain")).alias("postings"), F.max("gain").alias("top")
    )
    blocks = blocks.select("term", "block", F.col("postings.doc").alias("docs"), F.col("postings.gain").alias("gains"), "top")
    return Index(durable(blocks), terms, n_docs)


def asked_terms(queries: DataFrame, index: Index, query: str, text: str) -> DataFrame:
    """``query, term, weight, df, most``: the terms of each query that the index has, with the most that one can add."""
    terms = queries.select(F.col(query).alias("query"), F.explode(tx.lexical_tokens(F.col(text))).alias("term"))
    terms = terms.groupBy("query", "term").agg(F.count("*").alias("qtf")).join(index.terms, "term")
    idf = F.log1p((F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.withColumn("weight", idf * F.col("qtf"))
    return weighed.select("query", "term", "weight", "df", (F.col("weight") * F.col("top")).alias("most"))


def reached(asked: DataFrame, index: Index) -> DataFrame:
    """``query, doc, score`` of the postings that ``asked(query, term, weight)`` reaches, added up.

    With a column ``need`` a block counts only if its highest posting can lift a document to ``need`` together with
    all of the query that is not looked up by ``asked`` or stands in other terms: ``most_else``.
    """
    met = asked.join(index.blocks, "term")
    if "need" in asked.columns:
        met = met.where(F.col("weight") * F.col("top") + F.col("most_else") >= F.col("need"))
    each = met.select("query", "weight", F.explode(F.arrays_zip("docs", "gains")).alias("p"))
    return each.groupBy("query", F.col("p.docs").alias("doc")).agg(F.sum(F.col("weight") * F.col("p.gains")).alias("score"))


def first_scores(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """``query, least``: a score that ``k`` documents reach, from the query's rarest terms; queries with fewer hits are left out."""
    rarest = Window.partitionBy("query").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = asked.withColumn("_before", before).where(F.col("_before") < FIRST * k)
    best = Window.partitionBy("query").orderBy(F.col("score").desc())
    placed = reached(few, index).withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k)
    return placed.where(F.col("_place") == k).select("query", F.col("score").alias("least"))


def split_terms(asked: DataFrame, least: DataFrame) -> DataFrame:
    """``asked`` with ``need``, ``leading``, ``most_else`` and ``most_late`` by query.

    The weakest terms of a query whose greatest shares add up to less than ``need`` do not lead: a document with none
    but these cannot be among the best. ``most_else`` is what all other terms can add, ``most_late`` what all terms
    that do not lead can.
    """
    weakest = Window.partitionBy("query").orderBy("most", "term")
    every = Window.partitionBy("query")
    rows = asked.join(least, "query", "left").withColumn("need", F.coalesce(F.col("least") * (1 - SLACK) - SLACK, F.lit(0.0))).drop("least")
    rows = rows.withColumn("leading", F.sum("most").over(weakest) >= F.col("need"))
    late = F.sum(F.when(~F.col("leading"), F.col("most")).otherwise(0.0)).over(every)
    return rows.withColumns({"most_else": F.sum("most").over(every) - F.col("most"), "most_late": late})


def search(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """``query, doc, score`` with every document that can be among the best ``k`` of its query, scores exact."""
    split = durable(split_terms(asked, first_scores(asked, index, k)))
    leading = reached(split.where("leading"), index)
    late = split.where("not leading").select("query", "term", "weight")
    bounds = split.groupBy("query").agg(F.first("need").alias("need"), F.first("most_late").alias("most_late"))
    alive = leading.join(bounds, "query").where(F.col("score") + F.col("most_late") >= F.col("need"))
    alive = durable(alive.select("query", "doc", "score"))
    # a posting of a late term moves once, to its document's candidates
    wanted = alive.select("query", "doc").join(late, "query")
    held = index.blocks.join(late.select("term").distinct(), "term", "left_semi")
    held = held.select("term", F.explode(F.arrays_zip("docs", "gains")).alias("p")).select("term", F.col("p.docs").alias("doc"), F.col("p.gains").alias("gain"))
    added = wanted.join(held, ["term", "doc"]).groupBy("query", "doc").agg(F.sum(F.col("weight") * F.col("gain")).alias("more"))
    return alive.join(added, ["query", "doc"], "left").select("query", "doc", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def held_terms(corpus: DataFrame, words: dict[str, int], doc: str, text: str) -> DataFrame:
    """``doc, dl, term, tf``: the length of each document and the terms of ``words`` that it holds, by their numbers."""
    sent = corpus.sparkSession.sparkContext.broadcast(words)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            terms, times = [], []
            for said in batch.column("said"):
                found = Counter(map(number, (said.as_py() or "").split(" ")))
                found.pop(None, None)
                terms.append(list(found))
                times.append(list(found.values()))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("dl"), *lists], ["doc", "dl", "term", "tf"])

    said = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " ")
    rows = corpus.select(F.col(doc).alias("doc"), n_terms(F.col(text)).alias("dl"), said.alias("said"))
    return rows.mapInArrow(held, f"doc {rows.schema['doc'].dataType.simpleString()}, dl int, term array<int>, tf array<int>")


def best_scored(rows: DataFrame, queries: list[list[tuple[int, float]]], k: int) -> DataFrame:
    """``query, doc, score, place``: of every task's ``rows(doc, term, gain)`` the best ``k`` for each query, a list of
    term and weight. ``place`` is the score in nine digits, which orders documents; equal ones go by ``doc``."""
    sent = rows.sparkSession.sparkContext.broadcast([(np.array([t for t, _ in q], np.int64), [w for _, w in q]) for q in queries])
    order = [("place", "descending"), ("doc", "ascending")]

    def top(found: pa.Table) -> pa.Table:
        return found if len(found) <= k else found.take(pc.sort_indices(found, sort_keys=order, null_placement="at_start")[:k])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, pa.Table] = {}
        floors: dict[int, float] = {}
        for batch in batches:
            n, lists = batch.num_rows, batch.column("term")
            at = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            term, gain = lists.flatten().to_numpy(), batch.column("gain").flatten().to_numpy()
            by_term = np.argsort(term, kind="stable")
            term, at, gain = term[by_term], at[by_term], gain[by_term]
            for query, (asked, weights) in enumerate(sent.value):
                low, high = np.searchsorted(term, asked, "left"), np.searchsorted(term, asked, "right")
                met = [(slice(a, b), w) for a, b, w in zip(low, high, weights) if a < b]
                if not met:
                    continue
                scores = np.bincount(np.concatenate([at[s] for s, _ in met]), np.concatenate([gain[s] * w for s, w in met]), n)
                hits = np.flatnonzero((scores > 0) & (scores >= floors.get(query, 0.0) - SLACK))
                place = np.round(scores[hits], 9)
                if len(hits) > k:
                    # only what reaches the k-th place; equal ones are left to ``top``
                    kept = place >= np.partition(place, -k)[-k]
                    hits, place = hits[kept], place[kept]
                new = pa.table({"doc": batch.column("doc").take(pa.array(hits)), "score": scores[hits], "place": place})
                best = tops[query] = top(pa.concat_tables([tops[query], new]) if query in tops else new)
                if len(best) == k:
                    floors[query] = pc.min(best["place"]).as_py()
        for query, best in tops.items():
            yield from best.append_column("query", pa.array([query] * len(best), pa.int32())).combine_chunks().to_batches()

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc {kind}, score double, place double, query int")


def scanned(
    held: DataFrame, words: dict[str, int], queries: DataFrame, k: int, doc: str, query: str, text: str, k1: float, b: float
) -> DataFrame:
    """``query, doc, score, rank`` of the best ``k`` documents by one pass over their ``held_terms``.

    What the driver holds are the queries' terms.
    """
    spark = held.sparkSession
    size = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    spread = k1 * (1 - b + b * F.col("dl") / F.lit(float(size["avgdl"] or 1.0)))
    rows = held.select("doc", "term", F.transform("tf", lambda n: n * (k1 + 1) / (n + spread)).alias("gain"))
    names = spark.createDataFrame(list(words.items()), "term string, number int")
    counts = held.select(F.explode("term").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    # no posting adds more than the limit of its share for ever more occurrences
    terms = counts.join(names, "number").select("term", "number", "df", F.lit(k1 + 1).alias("top"))
    asked: dict = {}
    for r in asked_terms(queries, Index(held, terms, size["n"]), query, text).orderBy("query", "df", "term").toLocalIterator():
        asked.setdefault(r["query"], []).append((words[r["term"]], r["weight"]))
    ids = spark.createDataFrame(list(enumerate(asked)), f"query int, id {queries.schema[query].dataType.simpleString()}")
    found = durable(best_scored(rows, list(asked.values()), k))
    order = Window.partitionBy("query").orderBy(F.col("place").desc(), "doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(ids, "query").select(F.col("id").alias(query), F.col("doc").alias(doc), "score", "rank")


def bm25(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 100,
    doc: str = "doc_id",
    query: str = "query_id",
    text: str = "text",
    k1: float = K1,
    b: float = B,
    block: int = BLOCK,
) -> DataFrame:
    """Exact top ``k`` documents per query: ``(query, doc, score, rank)``; equal scores go by ``doc``.

    Queries and documents without a common term do not come. Queries of more than ``SENT`` words in all go by the index,
    with ``block`` postings in a block; so do documents of which some share an id, whose shares add up over tasks.
    """
    vocabulary = durable(queries.select(F.explode(tx.lexical_tokens(F.col(text))).alias("term")).distinct())
    asked_words = queries.agg(F.sum(n_terms(F.col(text)))).first()[0] or 0
    if asked_words <= SENT:
        words = {r["term"]: i for i, r in enumerate(vocabulary.toLocalIterator())}
        held = durable(held_terms(corpus, words, doc, text))
        if held.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return scanned(held, words, queries, k, doc, query, text, k1, b)
    index = build_index(corpus, vocabulary, doc, text, k1, b, block)
    asked = durable(asked_terms(queries, index, query, text))
    order = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc")
    best = search(asked, index, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("query").alias(query), F.col("doc").alias(doc), "score", "rank")


def rerank(run: DataFrame, scores: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Order retrieved candidates by an outside score; candidates without one keep the lowest places."""
    joined = run.drop("score", "rank").join(scores.select(query, doc, "score"), [query, doc], "left")
    order = Window.partitionBy(query).orderBy(F.col("score").desc_nulls_last(), doc)
    return joined.withColumn("rank", F.row_number().over(order))


def retrieval_metrics(
    run: DataFrame,
    qrels: DataFrame,
    ks: Sequence[int] = (1, 3, 5, 10, 100, 1000),
    query: str = "query_id",
    doc: str = "doc_id",
) -> DataFrame:
    """NDCG, MAP, recall and precision at each k, averaged over judged queries that have results.

    ``run`` holds (query, doc, rank); only its judged documents are joined, so a query's row count is bounded by
    its judgements.
    """
    top = max(ks)
    kept = run.where(F.col("rank") <= top).select(query, doc, "rank")
    answered = kept.select(query).distinct()
    judged = kept.join(qrels.where("grade > 0"), [query, doc])
    seen = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    judged = judged.withColumn("_found", seen)
    relevant = qrels.where("grade > 0").groupBy(query).agg(F.count("*").alias("_relevant"))
    best_first = Window.partitionBy(query).orderBy(F.col("grade").desc(), doc)
    ideal = (
        qrels.where("grade > 0").withColumn("_place", F.row_number().over(best_first)).where(F.col("_place") <= top)
    )
    gain = lambda place: F.col("grade") / F.log2(F.col(place) + 1)
    found_aggs, ideal_aggs = [], []
    for k in ks:
        hit = F.col("rank") <= k
        found_aggs += [
            F.sum(F.when(hit, gain("rank")).otherwise(0.0)).alias(f"_dcg{k}"),
            F.sum(F.when(hit, F.col("_found") / F.col("rank")).otherwise(0.0)).alias(f"_ap{k}"),
            F.count_if(hit).alias(f"_hit{k}"),
        ]
        ideal_aggs.append(F.sum(F.when(F.col("_place") <= k, gain("_place")).otherwise(0.0)).alias(f"_ideal{k}"))
    per_query = (
        ideal.groupBy(query)
        .agg(*ideal_aggs)
        .join(relevant, query)
        .join(answered, query)
        .join(judged.groupBy(query).agg(*found_aggs), query, "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.coalesce(F.try_divide(zero(f"_dcg{k}"), F.col(f"_ideal{k}")), F.lit(0.0)).alias("ndcg"),
                (zero(f"_ap{k}") / F.col("_relevant")).alias("map"),
                (zero(f"_hit{k}") / F.col("_relevant")).alias("recall"),
                (zero(f"_hit{k}") / F.lit(float(k))).alias("precision"),
            )
            for k in ks
        ]
    )
    return (
        per_query.select(F.explode(rows).alias("_m"))
        .select("_m.*")
        .groupBy("k")
        .agg(*[F.avg(m).alias(m) for m in ("ndcg", "map", "recall", "precision")], F.count("*").alias("n_queries"))
    )
