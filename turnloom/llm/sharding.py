"""Shards that all match the mixture: proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; the rank over the source's size is a fraction in (0, 1).
Sorted by that fraction, every stretch of rows holds the sources in proportion, so equal cuts give like shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import durable

#: Slices of the hash and of the fraction. Ranks are counted inside a slice, and slices are added up as a small table.
SLICES = 65536


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        key.alias("key"),
        F.substring(key, 1, 4).alias("slice"),
    )


def interleave(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, text_crc32, position, shard, slot`` for every row of ``docs``.

    Shards differ by one row at most, and slots are gapless from 0. Null sources are a source of their own, a null
    text counts as empty, rows with one ``doc_id`` stand side by side in the order of their text's checksum and size.
    Equal texts are ordinary rows and may fall into different shards. No row is gathered by source: windows run over
    slices of a source, and only slice counts are summed up. With no rows the result is empty.
    """
    keyed = _keyed(docs, seed)
    counts = keyed.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("n"))
    in_source = Window.partitionBy("source")
    starts = counts.select(
        F.col("source").alias("s"),
        F.col("slice").alias("c"),
        (F.sum("n").over(in_source.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        F.sum("n").over(in_source).alias("of"),
    )
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = (
        keyed.withColumn("nth", F.row_number().over(within))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("c")))
        .select("doc_id", "source", "size", "text_crc32", "key", ((F.col("start") + F.col("nth") - 0.5) / F.col("of")).alias("fraction"))
    )
    ranked = durable(ranked.withColumn("part", F.least(F.floor(F.col("fraction") * SLICES), F.lit(SLICES - 1))))
    parts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # at most SLICES rows
    whole = Window.partitionBy()
    parts = parts.select(
        F.col("part").alias("p"),
        (F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        F.sum("n").over(whole).alias("rows"),
    )
    within = Window.partitionBy("part").orderBy("fraction", "key", "doc_id", "text_crc32", "size", "source")
    placed = ranked.withColumn("nth", F.row_number().over(within)).join(parts, F.col("part") == F.col("p"))
    placed = placed.withColumn("position", F.col("start") + F.col("nth") - 1)
    placed = placed.withColumn("shard", F.expr(f"int(position * {shards} div rows)"))
    slot = F.expr(f"position - (shard * rows + {shards} - 1) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "position", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the rows of ``docs`` below ``path`` by shard, each in the order of its slots, with ``_shard`` and ``_slot``.

    Ids must be unique; columns of ``docs`` with these two names are replaced.
    """
    where = placed.select(F.col("doc_id").alias("id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("_shard", "_slot")]).alias("row")
    rows = docs.select(row).join(where, F.col("row.doc_id").eqNullSafe(F.col("id"))).select("row.*", "_shard", "_slot")
    rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
