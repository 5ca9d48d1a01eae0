"""Exact duplicates by an extendible-hash index on shared files. DataFrame functions only.

The directory maps the leading bits of a text's 64-bit hash to a bucket. It starts with one bucket and doubles until
no bucket holds more than ``capacity`` hashes, or ``MAX_DEPTH`` bits are used; what doubling cannot split is chained.
Owner tasks group the rows of their buckets by hash and by the whole text, so texts of one hash are told apart by
their bytes. The index has one row per different text and is written to the shared folder in key ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import durable

#: Directory bits: at most 2**20 slots of two numbers, so the broadcast stays below 32 MB at any size of the corpus.
MAX_DEPTH = 20


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"))


def _prefix(column, depth: int):
    """The leading ``depth`` bits of a 64-bit hash as a number."""
    return F.shiftrightunsigned(column, 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = 4096) -> DataFrame:
    """Directory after all doublings: ``slot`` (prefix of global depth), ``bucket``, ``local_depth``, ``global_depth``.

    ``hashes`` has a column ``hash``; repeated hashes count once. A bucket is named by its own prefix with a leading
    one bit, so names are unique over depths. An empty input has one bucket.
    """
    bins = hashes.groupBy("hash").agg(F.lit(1).alias("one")).groupBy(_prefix(F.col("hash"), MAX_DEPTH).alias("bin"))
    bins = bins.agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth")
    nodes = (
        bins.select("bin", "n", levels)
        .groupBy("depth", F.expr(f"shiftright(bin, {MAX_DEPTH} - depth)").alias("prefix"))
        .agg(F.sum("n").alias("n"))
    )
    full = nodes.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    # both halves of a split bucket are buckets, also where one of them is empty
    halves = full.where(f"depth <= {MAX_DEPTH}").select("depth", F.explode(F.array(F.col("parent") * 2, F.col("parent") * 2 + 1)).alias("prefix"))
    root = hashes.sparkSession.range(1).select(F.col("id").cast("int").alias("depth"), F.col("id").alias("prefix"))
    leaves = root.unionByName(halves).join(
        nodes.where((F.col("n") > capacity) & (F.col("depth") < MAX_DEPTH)).select("depth", "prefix"), ["depth", "prefix"], "left_anti"
    )
    leaves = leaves.select("*", F.max("depth").over(Window.partitionBy()).alias("global_depth"))
    slots = F.expr(
        "sequence(shiftleft(prefix, global_depth - depth), shiftleft(prefix + 1, global_depth - depth) - 1)"
    )
    return leaves.select(
        F.explode(slots).alias("slot"),
        (F.col("prefix") + F.expr("shiftleft(1L, depth)")).alias("bucket"),
        F.col("depth").alias("local_depth"),
        "global_depth",
    )


def text_index(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row per different text, stored in the shared folder in key ranges.

    ``bucket, hash, chain, text_sha256, keep_id, group_size``; ``chain`` numbers texts of one hash. Copies are folded
    before the shuffle, so a text that fills a third of the corpus reaches its owner once per input task.
    """
    slots = durable(directory(_keyed(docs).select("hash"), capacity))
    deepest = slots.agg(F.max("global_depth")).first()[0]
    rows = _keyed(docs).withColumn("slot", _prefix(F.col("hash"), deepest))
    rows = rows.join(F.broadcast(slots.select("slot", "bucket")), "slot")  # at most 2**MAX_DEPTH slots
    entries = (
        rows.groupBy("bucket", "hash", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("bucket", "hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
        .repartitionByRange("bucket", "hash")
    )
    chain = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("text_sha256"))
    return durable(entries.withColumn("chain", chain))


def exact_dedup(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row; the largest ``doc_id`` of equal texts stays.

    A null text counts as empty. Rows that repeat a ``doc_id`` with one text share the decision; a null ``doc_id``
    stays only where all rows of its text have none. An empty table gives an empty table; other columns are ignored.
    """
    index = text_index(docs, capacity).select(F.col("hash"), F.col("text_sha256"), "keep_id", "group_size")
    rows = _keyed(docs).select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256"))
    return rows.join(index, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
