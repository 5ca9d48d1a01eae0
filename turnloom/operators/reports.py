"""Summary tables behind the printed reports and charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.operators.ranking import quantiles


def corpus_overlap(scores: DataFrame, by: str = "system", metrics: Sequence[str] = ("rouge1_f", "rougeL_f")) -> DataFrame:
    """Mean of each F score per system, three digits, half to even."""
    return scores.groupBy(by).agg(*[F.bround(F.avg(m), 3).alias(m) for m in metrics])


def mean_and_spread(scores: DataFrame, by: str | Sequence[str], value: str) -> DataFrame:
    return scores.groupBy(*([by] if isinstance(by, str) else by)).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n_rows")
    )


def box_plot(scores: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, range, whisker ends (within 1.5 quartile distances) and outlier count per group, all exact."""
    q = quantiles(scores, value, [0.25, 0.5, 0.75], [by])
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        scores.where(F.col(value).isNotNull())
        .join(q, by)
        .groupBy(by, "q25", "q50", "q75")
        .agg(
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def histogram(scores: DataFrame, by: str, value: str) -> DataFrame:
    """Counts per system over shared equal bins.

    The bin width is the smaller one of Sturges' and Freedman-Diaconis' rules (Sturges' alone when the quartile
    distance is 0); the last bin is closed.
    """
    known = scores.where(F.col(value).isNotNull())
    edges = histogram_edges(known, value)
    if edges is None:
        return known.groupBy(by, F.lit(0).alias("bin")).agg(F.count("*").alias("n_rows"))
    low, width, bins = edges
    spot = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = known.groupBy(by, spot.alias("bin")).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("bin_low", F.lit(low) + F.col("bin") * F.lit(width))


def histogram_edges(known: DataFrame, value: str) -> tuple[float, float, int] | None:
    """(low edge, bin width, number of bins) from one summary row."""
    v = F.col(value).cast("double")
    row = known.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n")).first()
    if not row["n"]:
        return None
    lo, hi, n = row["lo"], row["hi"], row["n"]
    if lo == hi:
        return lo - 0.5, 1.0, 1
    import math

    q = quantiles(known.select(v.alias("_v")), "_v", [0.25, 0.75]).first()
    sturges = (hi - lo) / (math.log2(n) + 1)
    freedman = 2 * (q["q75"] - q["q25"]) / n ** (1 / 3)
    width = min(freedman, sturges) if freedman > 0 else sturges
    bins = max(1, math.ceil((hi - lo) / width))
    return lo, (hi - lo) / bins, bins


def metric_table(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form ``(keys..., metric, value)`` of a wide metric table."""
    return wide.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def wide_metrics(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def annotation_tasks(
    dialogues: DataFrame, judge_a: DataFrame, judge_b: DataFrame, aspects: Sequence[str] = ("societal", "scientific", "clarity")
) -> DataFrame:
    """One JSON task per conversation with two judges' score texts and the dialogue.

    ``dialogues`` holds (paper_id, system, topic, paper_text, dialogue array); each judge table (paper_id, system,
    aspect, score, reasons). The second judge counts with its first row per paper and aspect.
    """

    def texts(scores: DataFrame, name: str) -> DataFrame:
        first = Window.partitionBy("paper_id", "system", "aspect").orderBy("score", "reasons")
        one = scores.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
        text = tx.judged_text(F.col("score"), F.col("reasons"))
        wide = one.groupBy("paper_id", "system").pivot("aspect", list(aspects)).agg(F.first(text))
        return wide.select("paper_id", "system", *[F.col(a).alias(f"{name}_{a}_eval") for a in aspects])

    joined = dialogues.join(texts(judge_a, "llm1"), ["paper_id", "system"]).join(
        texts(judge_b, "llm2"), ["paper_id", "system"]
    )
    fields = [f"llm{i}_{a}_eval" for i in (1, 2) for a in aspects]
    body = F.struct(
        F.col("paper_id").cast("string").alias("sc_title"), "topic", F.col("paper_text").alias("sc_abstract"),
        "dialogue", *fields, F.col("system").alias("gen_model"),
    )
    return joined.select("paper_id", "system", F.to_json(body).alias("task"))


def registry_table(tables: Mapping[str, DataFrame], column: str = "system") -> DataFrame:
    """Named tables of one schema as a single table with a name column."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn(column, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out
