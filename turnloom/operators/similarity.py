"""Maximum cosine similarity inside groups of vectors.

Groups are cut into tiles of at most ``block`` x ``block`` vectors. One matrix product per tile returns one
maximum per vector, so pairs are never rows, a tile always fits a task, and a group of any size is shared by
many tasks. Groups within one block (the usual case) are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.operators.stats import _join

BLOCK = 2048


def _unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _tile_maxima(names: list[str]):
    """Kernel over one tile: best cosine of every row against the rows of the opposite side."""

    def kernel(table: pa.Table) -> pa.Table:
        rows = _unit_rows(table["_vec"])
        left = table["_left"].to_numpy(zero_copy_only=False)
        right = table["_right"].to_numpy(zero_copy_only=False)
        at_left, at_right = np.flatnonzero(left), np.flatnonzero(right)
        best = np.full(len(rows), -1.0)
        if len(at_left) and len(at_right):
            sims = rows[at_left] @ rows[at_right].T
            same = at_left[:, None] == at_right[None, :]
            sims[same] = -1.0
            best[at_left] = np.maximum(best[at_left], sims.max(axis=1))
            best[at_right] = np.maximum(best[at_right], sims.max(axis=0))
        return table.select(names).append_column("best", pa.array(best))

    return kernel


def _blocks(rows: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Block counts of the groups that need more than one block on a side."""
    counts = rows.groupBy(*keys).agg(
        F.greatest(F.ceil(F.count_if("_left") / block), F.lit(1)).alias("_nl"),
        F.greatest(F.ceil(F.count_if("_right") / block), F.lit(1)).alias("_nr"),
    )
    return counts.where("_nl > 1 or _nr > 1")


def _run(tiled: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    names = [*keys, "_side", ident]
    schema = T.StructType([tiled.schema[c] for c in names] + [T.StructField("best", T.DoubleType())])
    return tiled.groupBy(*keys, "_tl", "_tr").applyInArrow(_tile_maxima(names), schema)


def cross_maxima(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ident: str,
    vector: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """Best cosine of every left row among the right rows of its group and the other way round.

    Output ``(keys..., side, ident, best)`` with side ``left`` or ``right``; -1 when the other side is empty.
    """
    cols = [*keys, ident, F.col(vector).cast("array<float>").alias("_vec")]
    one = left.select(*cols, F.lit("left").alias("_side"), F.lit(True).alias("_left"), F.lit(False).alias("_right"))
    two = right.select(*cols, F.lit("right").alias("_side"), F.lit(False).alias("_left"), F.lit(True).alias("_right"))
    rows = one.unionByName(two)
    sized = rows.join(_blocks(rows, keys, block), list(keys), "left").fillna(1, ["_nl", "_nr"])
    own = F.pmod(F.xxhash64(ident), F.when(F.col("_left"), F.col("_nl")).otherwise(F.col("_nr")))
    other = F.when(F.col("_left"), F.col("_nr")).otherwise(F.col("_nl"))
    sized = sized.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), other - 1)))
    tiled = sized.withColumn("_tl", F.when(F.col("_left"), F.col("_own")).otherwise(F.col("_other"))).withColumn(
        "_tr", F.when(F.col("_left"), F.col("_other")).otherwise(F.col("_own"))
    )
    best = _run(tiled, keys, ident)
    return best.groupBy(*keys, F.col("_side").alias("side"), ident).agg(F.max("best").alias("best"))


def self_maxima(
    rows: DataFrame, keys: Sequence[str], ident: str, vector: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """Best cosine of every row among the other rows of its group; -1 for a lone row."""
    cols = rows.select(
        *keys, ident, F.col(vector).cast("array<float>").alias("_vec"), F.lit("self").alias("_side"),
        F.lit(True).alias("_left"), F.lit(True).alias("_right"),
    )
    sized = cols.join(_blocks(cols, keys, block), list(keys), "left").fillna(1, ["_nl", "_nr"])
    sized = sized.withColumn("_own", F.pmod(F.xxhash64(ident), F.col("_nl"))).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nl") - 1))
    )
    # unordered tiles: a row is on the side of the tile index it owns, on both sides of its diagonal tile
    tiled = (
        sized.withColumn("_tl", F.least("_own", "_other"))
        .withColumn("_tr", F.greatest("_own", "_other"))
        .withColumn("_left", F.col("_own") == F.col("_tl"))
        .withColumn("_right", F.col("_own") == F.col("_tr"))
    )
    best = _run(tiled, keys, ident)
    return best.groupBy(*keys, ident).agg(F.max("best").alias("best"))


def self_redundancy(rows: DataFrame, group: str, ident: str, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Mean over a group's turns of the best cosine with another turn of the group."""
    best = self_maxima(rows, [group], ident, vector, block)
    return best.groupBy(group).agg(F.avg("best").alias("redundancy"), F.count("*").alias("n_turns"))


def followup_score(
    questions: DataFrame,
    turns: DataFrame,
    conv: str,
    turn: str,
    ident: str,
    vector: str = "embedding",
    threshold: float = 0.8,
    block: int = BLOCK,
) -> DataFrame:
    """Share of adjacent turn pairs with at least one question pair of cosine >= threshold; 0 for one turn.

    ``turns`` lists (conv, turn) with consecutive turn numbers and fixes the denominator; ``questions`` holds
    the vectors. A turn meets its successor under the pair number of the earlier turn.
    """
    left = questions.withColumn("_pair", F.col(turn).cast("bigint"))
    right = questions.withColumn("_pair", F.col(turn).cast("bigint") - 1)
    best = cross_maxima(left, right, [conv, "_pair"], ident, vector, block)
    # rounding keeps equal vectors at exactly the threshold on every platform
    hits = (
        best.where((F.col("side") == "left") & (F.round("best", 12) >= threshold))
        .select(conv, "_pair")
        .distinct()
        .groupBy(conv)
        .agg(F.count("*").alias("_hits"))
    )
    counts = turns.groupBy(conv).agg(F.count_distinct(turn).alias("n_turns"))
    share = F.coalesce(F.col("_hits"), F.lit(0)) / (F.col("n_turns") - 1)
    return counts.join(hits, conv, "left").select(
        conv, "n_turns", F.when(F.col("n_turns") > 1, share).otherwise(F.lit(0.0)).alias("followup")
    )


def embedding_prf(
    premise: DataFrame, claim: DataFrame, item: str, ident: str, vector: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """Precision (claim side), recall (premise side) and F of best cosines between two sets of sentence vectors."""
    best = cross_maxima(premise, claim, [item], ident, vector, block)
    side = lambda name: F.avg(F.when(F.col("side") == name, F.col("best")))
    scores = best.groupBy(item).agg(side("right").alias("precision"), side("left").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return scores.withColumn("f", F.try_divide(2 * p * r, p + r))
