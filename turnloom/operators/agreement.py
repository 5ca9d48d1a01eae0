"""Agreement between annotators: kappa by annotator position, Krippendorff's alpha."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.stats import _join


def rated_units(ann: DataFrame, unit: Sequence[str], more_than: int = 2) -> DataFrame:
    """Units with more than ``more_than`` annotations."""
    return ann.groupBy(*unit).agg(F.count("*").alias("n_annotations")).where(F.col("n_annotations") > more_than)


def annotation_positions(ann: DataFrame, unit: Sequence[str], rater: str, value: str) -> DataFrame:
    """``unit, position, value``: annotations numbered from 0 in annotator order, for units of any size."""
    order = Window.partitionBy(*unit).orderBy(rater, value)
    return ann.select(*unit, (F.row_number().over(order) - 1).alias("position"), F.col(value).alias("value"))


def annotation_lists(ann: DataFrame, unit: Sequence[str], rater: str, value: str) -> DataFrame:
    """All annotations of each unit in annotator order, and how many there are."""
    item = F.struct(F.col(rater).alias("r"), F.col(value).alias("v"))
    lists = ann.groupBy(*unit).agg(F.count("*").alias("n_annotations"), F.array_sort(F.collect_list(item)).alias("_v"))
    return lists.select(*unit, "n_annotations", F.transform("_v", lambda x: x["v"]).alias("annotations"))


def cohen_kappa(
    ann: DataFrame,
    unit: Sequence[str],
    rater: str,
    value: str,
    first: int = 0,
    second: int = 1,
    by: Sequence[str] = (),
    more_than: int = 2,
) -> DataFrame:
    """Cohen's kappa of the annotators at two positions of each unit, in annotator order."""
    keys = [*by, *unit]
    order = Window.partitionBy(*keys).orderBy(rater, value)
    last = max(first, second) + 1
    ranked = ann.withColumn("_pos", F.row_number().over(order)).where(F.col("_pos") <= last)
    rated = rated_units(ann, keys, more_than)
    pick = lambda p: F.max(F.when(F.col("_pos") == p + 1, F.col(value)))
    pairs = ranked.join(rated, keys, "left_semi").groupBy(*keys).agg(pick(first).alias("_a"), pick(second).alias("_b"))
    cells = pairs.where("_a is not null and _b is not null").groupBy(*by, "_a", "_b").agg(F.count("*").alias("_n"))
    # chance agreement: sum over values of the two marginal counts multiplied
    sides = F.explode(
        F.array(
            F.struct(F.col("_a").alias("v"), F.col("_n").alias("na"), F.lit(0).cast("bigint").alias("nb")),
            F.struct(F.col("_b").alias("v"), F.lit(0).cast("bigint").alias("na"), F.col("_n").alias("nb")),
        )
    )
    margins = (
        cells.select(*by, sides.alias("_s"))
        .groupBy(*by, "_s.v")
        .agg(F.sum("_s.na").alias("na"), F.sum("_s.nb").alias("nb"))
        .groupBy(*by)
        .agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("_chance"))
    )
    agreed = cells.groupBy(*by).agg(
        F.sum("_n").alias("n_units"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same")
    )
    n = F.col("n_units").cast("double")
    po, pe = F.col("_same") / n, F.col("_chance") / (n * n)
    return _join(agreed, margins, by).select(*by, "n_units", F.try_divide(po - pe, 1 - pe).alias("kappa"))


def krippendorff_alpha(
    ann: DataFrame, unit: Sequence[str], value: str, by: Sequence[str] = (), more_than: int = 2
) -> DataFrame:
    """Nominal alpha (equal to interval alpha on 0/1 codes) from per-unit value counts."""
    keys = [*by, *unit]
    values = ann.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    units = (
        values.groupBy(*keys)
        .agg(F.sum("n").alias("m"), F.sum(n * n).alias("_sq"))
        .where((F.col("m") > more_than) & (F.col("m") > 1))
    )
    m = F.col("m").cast("double")
    observed = units.groupBy(*by).agg(
        F.sum((m * m - F.col("_sq")) / (m - 1)).alias("_do"), F.sum("m").alias("n_values")
    )
    kept = values.join(units.select(*keys), keys, "left_semi")
    expected = (
        kept.groupBy(*by, value).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(n * n).alias("_nsq"))
    )
    total = F.col("n_values").cast("double")
    de = (total * total - F.col("_nsq")) / (total - 1)
    alpha = 1 - F.try_divide(F.col("_do"), de)
    return _join(observed, expected, by).select(*by, "n_values", alpha.alias("alpha"))
