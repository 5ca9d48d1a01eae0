"""Seeded splits, samples and caps.

Every choice is a function of a row's key and a seed, so it survives retries and any partitioning. Exact sizes
come from a threshold: a narrow scan finds the order number at which the size is reached, and the full rows are
then filtered against it without being shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.hashing import hash_fraction, hash_number
from turnloom.operators.ranking import range_layout, range_offsets
from turnloom.session import join_on


def _cuts(df: DataFrame, order: Column, tie: Column, size: Column, by: Sequence[str]) -> DataFrame:
    """Per group its row count ``_n``, ``_size``, and the order number and tie ``_co, _ct`` of the last row inside.

    ``size`` is an expression over ``by`` and ``_n``. The narrow keys are laid out in ranges of equal size, whatever
    their distribution; only the range in which a group's size is reached is ranked. No cut (null) means that the size
    covers the whole group or nothing. A null group is a group.
    """
    ranged = range_layout(df.select(*by, order.cast("bigint").alias("_o"), tie.alias("_tie")), by, ["_o", "_tie"])
    placed = range_offsets(ranged, by, {"_c": F.count("*")})
    placed = placed.withColumn("_n", F.sum("_c_sum").over(Window.partitionBy(*by))).withColumn("_size", size)
    room = F.col("_size") - F.col("_c_off")
    edge = placed.where((room > 0) & (room <= F.col("_c_sum")) & (F.col("_size") < F.col("_n")))
    ranked = join_on(ranged, edge.select(*by, "_range", room.alias("_room")), [*by, "_range"])
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_o", "_tie")))
    cut = ranked.where(F.col("_rank") == F.col("_room")).select(*by, F.col("_o").alias("_co"), F.col("_tie").alias("_ct"))
    if not by:
        one = F.lit(1).alias("_one")
        sizes = placed.groupBy(one).agg(F.max("_n").alias("_n"), F.max("_size").alias("_size"))
        return join_on(sizes, cut.select(one, "_co", "_ct"), ["_one"], "left").drop("_one")
    sizes = placed.groupBy(*by).agg(F.max("_n").alias("_n"), F.max("_size").alias("_size"))
    return join_on(sizes, cut, by, "left")


def within_size(df: DataFrame, order: Column, key: str, size: Column) -> Column:
    """Condition on ``order`` and ``key``: the row is among the first ``size`` rows of ``df``."""
    row = _cuts(df, order, F.col(key), size, ()).first()
    if row is None or row["_size"] >= row["_n"]:
        return F.lit(True)
    if row["_co"] is None:
        return F.lit(False)
    o = order.cast("bigint")
    return (o < row["_co"]) | ((o == row["_co"]) & (F.col(key) <= F.lit(row["_ct"])))


def _kept(df: DataFrame, order: Column, key: str, size: Column, by: Sequence[str]) -> DataFrame:
    """The first ``size`` rows of every group: a filter against one small table of cuts."""
    o = order.cast("bigint")
    inside = (F.col("_size") >= F.col("_n")) | (o < F.col("_co")) | ((o == F.col("_co")) & (F.col(key) <= F.col("_ct")))
    limits = _cuts(df, order, F.col(key), size, by)
    return join_on(df, limits, by).where(inside).drop("_n", "_size", "_co", "_ct")


def split_by_fraction(df: DataFrame, key: str, train: float = 0.9, seed: int = 123, column: str = "split") -> DataFrame:
    """Row or key split by hash threshold: no job, no shuffle; sizes are right in expectation."""
    return df.withColumn(
        column, F.when(hash_fraction(seed, F.col(key)) < train, F.lit("train")).otherwise(F.lit("test"))
    )


def train_rows(df: DataFrame, key: str, train: float, seed: int) -> Column:
    """Condition on ``key`` that holds for exactly floor(n * train) rows of ``df``; ``key`` is unique per row."""
    return within_size(df, hash_number(seed, F.col(key)), key, F.floor(F.col("_n") * F.lit(train)))


def split_rows(df: DataFrame, key: str, train: float = 0.9, seed: int = 123, column: str = "split") -> DataFrame:
    """Row split with exactly floor(n * train) training rows; ``key`` is unique per row."""
    inside = train_rows(df, key, train, seed)
    return df.withColumn(column, F.when(inside, F.lit("train")).otherwise(F.lit("test")))


def split_by_key(df: DataFrame, key: str, train: float = 0.9, seed: int = 123, column: str = "split") -> DataFrame:
    """Leak-free split: exactly floor(keys * train) distinct keys train, and all rows of a key stay together.

    Only the distinct keys are counted and ranked. The rows themselves are compared with one threshold.
    """
    return split_rows_like(df, df.select(key).distinct(), key, train, seed, column)


def split_rows_like(df: DataFrame, keys: DataFrame, key: str, train: float, seed: int, column: str) -> DataFrame:
    """Split ``df`` by the exact threshold found on a table of unique keys."""
    inside = train_rows(keys, key, train, seed)
    return df.withColumn(column, F.when(inside, F.lit("train")).otherwise(F.lit("test")))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; empty for a leak-free split."""
    return a.select(key).intersect(b.select(key))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows in hash order of a unique key, any ``n``."""
    return df.where(within_size(df, hash_number(seed, F.col(key)), key, F.lit(n)))


def head_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """First ``n`` rows of an explicit order."""
    return df.orderBy(key).limit(n)


def cap_per_group(df: DataFrame, group: str, cap: int, key: str, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows per group, drawn without replacement."""
    return _kept(df, hash_number(seed, F.col(key)), key, F.lit(cap), (group,))


def first_per_group(df: DataFrame, group: str, limit: int | float | Mapping[object, int | float], key: str) -> DataFrame:
    """The first ``limit`` rows (int) or first share of rows (float) per group in the order of a numeric key.

    A mapping gives a limit for each group, which are all found by one search; other groups are left out.
    """
    size = lambda at: F.lit(at).cast("bigint") if isinstance(at, int) else F.floor(F.col("_n") * F.lit(at))
    if isinstance(limit, Mapping):
        df = df.where(F.col(group).isin(*limit))
        wanted = F.lit(None).cast("bigint")
        for name, at in limit.items():
            wanted = F.when(F.col(group) == name, size(at)).otherwise(wanted)
    else:
        wanted = size(limit)
    return _kept(df, F.col(key), key, wanted, (group,))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Global order by hash, for writing."""
    return df.orderBy(hash_number(seed, F.col(key)), key)


def group_sizes(df: DataFrame, group: str, cap: int) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n_rows")).withColumn("n_capped", F.least("n_rows", F.lit(cap)))


def dense_index(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """Number the rows of every group 0..n-1 in hash order and add the group size; a null group is a group.

    Rows are laid out in ranges of equal size, so the largest group is spread over many sorts.
    """
    ranged = range_layout(df.withColumn("_o", hash_number(seed, F.col(key))), [group], ["_o", key])
    sizes = range_offsets(ranged, [group], {"_c": F.count("*")})
    sizes = sizes.withColumn("group_size", F.sum("_c_sum").over(Window.partitionBy(group))).drop("_c_sum")
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy("_o", key)) - 1
    placed = join_on(ranged.withColumn("_within", within), sizes, [group, "_range"])
    return placed.withColumn("index", F.col("_c_off") + F.col("_within")).drop("_o", "_range", "_within", "_c_off")


def random_peer(
    df: DataFrame, group: str, key: str, value: Column, name: str, where: Column | None = None, seed: int = 0
) -> DataFrame:
    """Give each row (or each row meeting ``where``) the ``value`` of a row drawn from its whole group.

    The draw is an index below the group size, found by an equi-join on (group, index): uniform keys, no skew.
    """
    pool = dense_index(df.select(group, key, value.alias(name)), group, key, seed)
    sizes = pool.groupBy(group).agg(F.first("group_size").alias("_size"))
    wanted = join_on(df, sizes, [group], "left").withColumn(
        "_draw",
        F.pmod(hash_number(f"{seed}-draw", F.col(key)), F.col("_size")),
    )
    if where is not None:
        wanted = wanted.withColumn("_draw", F.when(where, F.col("_draw")))
    # rows without a draw join nothing; a negative key of their own keeps them apart
    wanted = wanted.withColumn("_at", F.coalesce(F.col("_draw"), -1 - F.abs(F.xxhash64(key) % 1000003)))
    picks = pool.select(group, F.col("index").alias("_at"), name)
    return join_on(wanted, picks, [group, "_at"], "left").drop("_size", "_draw", "_at")
