"""Human annotations against judge scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.operators.agreement import cohen_kappa, krippendorff_alpha
from turnloom.sources.readers import annotations

UNIT = ("sc_title", "gen_model")


def judge_difference(ann: DataFrame, first: str, second: str, flag: str, at_least: int = 1) -> DataFrame:
    """Flag rows whose two judge score texts differ by ``at_least`` points or more."""
    gap = F.abs(tx.judged_score(F.col(first)) - tx.judged_score(F.col(second)))
    return ann.withColumn(flag, F.coalesce(gap >= at_least, F.lit(False)))


def value_counts(ann: DataFrame, column: str, flag: str | None = None) -> DataFrame:
    """Counts of a preference column, over all rows and over flagged rows only."""
    rows = ann.where(F.col(column).isNotNull())
    flagged = F.count_if(F.col(flag)) if flag else F.count("*")
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"), flagged.alias("n_flagged"))


def agreement_report(
    ann: DataFrame,
    questions: Mapping[str, str | None],
    unit: Sequence[str] = UNIT,
    positions: tuple[int, int] = (0, 1),
    models: Sequence[str] = (),
) -> DataFrame:
    """Kappa and alpha per preference question, over rows meeting the question's flag column and generator models."""
    rows = ann.where(F.col("gen_model").isin(*models)) if models else ann
    parts = [
        F.struct(F.lit(q).alias("question"), F.col(q).alias("choice"), (F.col(flag) if flag else F.lit(True)).alias("keep"))
        for q, flag in questions.items()
    ]
    long = (
        rows.select(*unit, "annotator", F.explode(F.array(*parts)).alias("_q"))
        .select(*unit, "annotator", "_q.*")
        .where("keep and choice is not null")
    )
    kappa = cohen_kappa(long, unit, "annotator", "choice", *positions, by=["question"])
    alpha = krippendorff_alpha(long, unit, "choice", by=["question"])
    return kappa.join(alpha, "question", "full")


def human_report(
    export: DataFrame, sides: Mapping[str, str], aspects: Sequence[str], prefix: str = "pw_llm_"
) -> DataFrame:
    """From the annotation export to agreement per aspect, on conversations where the judges disagree."""
    questions = [f"{prefix}{a}" for a in aspects]
    ann = annotations(export, sides, questions)
    for a in aspects:
        ann = judge_difference(ann, f"llm1_{a}_eval", f"llm2_{a}_eval", f"diff_{a}")
    return agreement_report(ann, {f"{prefix}{a}": f"diff_{a}" for a in aspects})
