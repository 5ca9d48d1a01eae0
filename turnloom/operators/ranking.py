"""Global order statistics without a global sort in one task.

Rows, usually distinct values with counts, are dealt out in key ranges of equal size and written once, so every later
step sees the same ranges. Sums inside a range are shifted by the totals of the ranges before. The layout is the same
for every size of input, and a group of any size or distribution is spread over as many ranges as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import durable, join_on


def range_layout(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` in ranges of ``by`` and ``order``, as a table with the number of the range in ``_range``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))


def range_offsets(ranged: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per group and range the totals of all ranges of the group before, ``<name>_off``, and its own, ``<name>_sum``."""
    outer = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*by, "_range").agg(*[c.alias(f"{n}_sum") for n, c in sums.items()])
    return totals.select("*", *[(F.sum(f"{n}_sum").over(outer) - F.col(f"{n}_sum")).alias(f"{n}_off") for n in sums])


def running_totals(values: DataFrame, by: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """Add ``<weight>_before`` to one-row-per-(by, value) data: the weight of all smaller values in the group."""
    ranged = range_layout(values, by, [value])
    offsets = range_offsets(ranged, by, {w: F.sum(w) for w in weights})
    inner = Window.partitionBy("_range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select("*", *[(F.sum(w).over(inner) - F.col(w)).alias(f"{w}_in") for w in weights])
    joined = join_on(inside, offsets, [*by, "_range"])
    return joined.select(*values.columns, *[(F.col(f"{w}_off") + F.col(f"{w}_in")).alias(f"{w}_before") for w in weights])


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Distinct values with their count ``n`` and average rank (ties share the mean of their places)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, by, value, ["n"])
    return ranked.select(*by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias(name))


def with_average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rows with the average rank of their value."""
    ranks = average_ranks(df, value, by, name).drop("n")
    return df.join(ranks, [*by, value], "left")


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one column ``q<percent>`` per probability."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, by, value, ["n"])
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    placed = join_on(ranked, totals, by) if by else _with_total(ranked, totals)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place <= last), F.col(value)))

    out = []
    for p in probs:
        place = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(place)
        out += [
            at(low).alias(f"_lo{p}"),
            at(F.ceil(place)).alias(f"_hi{p}"),
            F.max(place - low).alias(f"_w{p}"),
        ]
    picked = placed.groupBy(*by).agg(*out)
    return picked.select(
        *by,
        *[
            (F.col(f"`_lo{p}`") + (F.col(f"`_hi{p}`") - F.col(f"`_lo{p}`")) * F.col(f"`_w{p}`")).alias(
                f"q{round(p * 100)}"
            )
            for p in probs
        ],
    )


def _with_total(ranked: DataFrame, totals: DataFrame) -> DataFrame:
    row = totals.first()
    return ranked.withColumn("_total", F.lit(row["_total"] if row else 0).cast("bigint"))
