"""Judging: prompt grid, cached judge stage, score tables and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import dialogue as dg
from turnloom.functions import parsing as ps
from turnloom.functions import text as tx
from turnloom.operators.rubrics import Rubric
from turnloom.operators.stages import Client, batch_stage, question_reply, rubric_reply

SCORE_KEY = ("row_id", "evaluator", "subject", "aspect")


def input_column(rubric: Rubric, columns: Sequence[str], sep: str = ": ") -> Column:
    """Labelled inputs of one rubric; an input column the table lacks prints as ``None``."""
    inputs = [(label, F.col(c) if c in columns else F.lit(None).cast("string")) for label, c in rubric.inputs]
    return dg.fill_inputs(inputs, sep)


def prompt_column(rubric: Rubric, columns: Sequence[str], sep: str = ": ") -> Column:
    """Instruction, blank line, labelled inputs."""
    return F.concat_ws("\n\n", F.lit(rubric.instruction), input_column(rubric, columns, sep))


def build_prompts(
    df: DataFrame, rubrics: Sequence[Rubric], keep: Sequence[str], sep: str = ": ", tokens: tx.TokenCounter | None = None
) -> DataFrame:
    """Every row x every rubric as ``(keep..., subject, aspect, scale, prompt)`` by exploding a literal list of rubrics.

    With ``tokens`` the token count of the inputs, without the instruction, is added as ``n_tokens``.
    """
    size = lambda r: [] if tokens is None else [tokens(input_column(r, df.columns, sep)).alias("n_tokens")]
    grid = F.array(
        *[
            F.struct(
                F.lit(r.subject).alias("subject"),
                F.lit(r.aspect).alias("aspect"),
                F.lit(r.scale).cast("int").alias("scale"),
                prompt_column(r, df.columns, sep).alias("prompt"),
                *size(r),
            )
            for r in rubrics
        ]
    )
    return df.select(*keep, F.explode(grid).alias("_p")).select(*keep, "_p.*")


def pending(prompts: DataFrame, scored: DataFrame | None, key: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Prompts without a stored score: a rerun judges only what is new."""
    if scored is None:
        return prompts
    return prompts.join(scored.select(*key), list(key), "left_anti")


def pending_prompts(df: DataFrame, rubrics: Sequence[Rubric], keep: Sequence[str], scored: DataFrame | None) -> DataFrame:
    """Prompts of ``df`` without a score in ``scored(keep..., subject, aspect)``.

    A row meets its stored scores before it becomes prompts, so its texts are shuffled once and not once per rubric.
    """
    if scored is None:
        return build_prompts(df, rubrics, keep)
    have = scored.groupBy(*keep).agg(F.collect_set(F.struct("subject", "aspect")).alias("_have"))
    prompts = build_prompts(df.join(have, list(keep), "left"), rubrics, [*keep, "_have"])
    known = F.array_contains("_have", F.struct("subject", "aspect"))
    return prompts.where(~F.coalesce(known, F.lit(False))).drop("_have")


def run_judge(
    prompts: DataFrame,
    model: Callable[[Column], Column] | Callable[[], Client] = rubric_reply,
    native: bool = True,
    parse: Callable[[Column], Column] = ps.parse_structured_reply,
) -> DataFrame:
    """Reply, then ``score``, ``reasons`` and ``parse_ok``, for every prompt."""
    if native:
        replied = prompts.withColumn("reply", model(F.col("prompt"))).withColumn("reply_error", F.lit(None).cast("string"))
    else:
        replied = batch_stage(prompts, model, F.col("prompt"), "reply")
    return replied.withColumn("_j", parse(F.col("reply"))).select(
        *replied.columns, "_j.score", "_j.reasons", "_j.parse_ok"
    )


def judge(
    df: DataFrame,
    rubrics: Sequence[Rubric],
    evaluator: str,
    keep: Sequence[str] = ("row_id", "system"),
    cache: DataFrame | None = None,
    force: bool = False,
    **how,
) -> DataFrame:
    """Newly judged rows of a systems x rubrics grid; stored scores are skipped unless ``force``."""
    prompts = build_prompts(df, rubrics, keep).withColumn("evaluator", F.lit(evaluator))
    todo = prompts if force else pending(prompts, cache)
    return run_judge(todo, **how).drop("prompt", "reply")


def gated_judge(
    df: DataFrame,
    rubrics: Sequence[Rubric],
    limit: int,
    keep: Sequence[str] = ("row_id",),
    cumulative: bool = False,
    tokens: tx.TokenCounter = tx.token_count,
    **how,
) -> DataFrame:
    """Judge prompts whose inputs hold fewer than ``limit`` tokens; longer ones stay, flagged ``skipped_too_long``.

    ``cumulative`` drops a row from every rubric that follows one it was too long for, in rubric order, and
    drops the skipped rows themselves.
    """
    prompts = build_prompts(df, rubrics, keep, tokens=tokens)
    too_long = F.col("n_tokens") >= limit
    flagged = prompts.withColumn("skipped_too_long", too_long)
    if cumulative:
        order = {r.aspect: i for i, r in enumerate(rubrics)}
        rank = F.lit(None).cast("int")
        for aspect, i in order.items():
            rank = F.when(F.col("aspect") == aspect, F.lit(i)).otherwise(rank)
        seen = Window.partitionBy(*keep).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
        flagged = flagged.withColumn("_lost", F.max(too_long).over(seen)).where("not _lost").drop("_lost")
    fit = run_judge(flagged.where("not skipped_too_long"), **how)
    rest = flagged.where("skipped_too_long")
    return fit.unionByName(rest, allowMissingColumns=True).drop("prompt", "reply")


def judge_questions(
    df: DataFrame,
    rubrics: Sequence[Rubric],
    keep: Sequence[str],
    model: Callable[[Column], Column] | Callable[[], Client] = question_reply,
    native: bool = True,
    text: str = "journalist_text",
    evaluator: str = "rule",
    cache: DataFrame | None = None,
    force: bool = False,
) -> DataFrame:
    """Share of a row's questions a judge calls good, per rubric: ``(keep..., evaluator, subject, aspect, reasons, score)``.

    The prompt holds the rubric's instruction and the questions as a JSON list. Scores in ``cache`` are not asked for
    again unless ``force``. A failed call leaves its error in ``reply_error`` and scores 0, as an unreadable reply does.
    """
    asked = tx.questions(F.col(text))
    rows = df.select(*keep, asked.alias("_asked")).withColumn("questions", F.to_json("_asked"))
    prompts = build_prompts(rows, rubrics, [*keep, "_asked"]).withColumn("evaluator", F.lit(evaluator))
    todo = prompts if force else pending(prompts, cache, [*keep, "evaluator", "subject", "aspect"])
    if native:
        replied = todo.withColumn("reply", model(F.col("prompt"))).withColumn("reply_error", F.lit(None).cast("string"))
    else:
        replied = batch_stage(todo, model, F.col("prompt"), "reply")
    judged = replied.withColumn("_q", ps.parse_question_reply(F.col("reply"), F.col("_asked")))
    return judged.select(*keep, "evaluator", "subject", "aspect", "reply_error", "_q.reasons", "_q.score")


def aspect_report(scores: DataFrame, by: Sequence[str] = ("system",), digits: int = 2) -> DataFrame:
    """Rounded mean per aspect and, over those rounded means, the harmonic mean (0 when one of them is 0)."""
    means = scores.groupBy(*by, "aspect").agg(
        F.bround(F.avg(F.coalesce(F.col("score").cast("double"), F.lit(0.0))), digits).alias("mean_score"),
        F.count("*").alias("n_rows"),
    )
    mean = F.col("mean_score")
    harmonic = F.when(F.min(mean) <= 0, F.lit(0.0)).otherwise(F.count("*") / F.sum(F.try_divide(F.lit(1.0), mean)))
    overall = means.groupBy(*by).agg(
        F.lit("overall").alias("aspect"), F.bround(harmonic, digits).alias("mean_score"), F.max("n_rows").alias("n_rows")
    )
    return means.unionByName(overall)


def wide_report(report: DataFrame, by: Sequence[str], aspects: Sequence[str], value: str = "mean_score") -> DataFrame:
    """One column per aspect."""
    return report.groupBy(*by).pivot("aspect", list(aspects)).agg(F.first(value))


def topic_report(scores: DataFrame, topic: str = "topic", system: str = "system") -> DataFrame:
    """Mean per topic x system with counts, per topic, and overall, in one pass."""
    return scores.rollup(topic, system).agg(F.avg("score").alias("mean_score"), F.count("*").alias("n_rows"))


def score_counts(scores: DataFrame, by: Sequence[str] = ("aspect",)) -> DataFrame:
    """How often each score value occurs."""
    value = F.col("score").try_cast("int").alias("score")
    return scores.groupBy(*by, value).agg(F.count("*").alias("n_rows"))


def judge_pairs(a: DataFrame, b: DataFrame, key: Sequence[str] = ("paper_id", "system", "aspect")) -> DataFrame:
    """Two judges' scores of the same item side by side."""
    one = a.select(*key, F.col("score").alias("a"))
    two = b.select(*key, F.col("score").alias("b"))
    return one.join(two, list(key))


def system_pairs(scores: DataFrame, first: str, second: str, key: Sequence[str] = ("paper_id", "aspect")) -> DataFrame:
    """Two systems' scores of the same item side by side."""
    side = lambda s, name: scores.where(F.col("system") == s).select(*key, F.col("score").alias(name))
    return side(first, "a").join(side(second, "b"), list(key))


def score_matrix(scores: DataFrame, systems: Sequence[str], key: str = "paper_id") -> DataFrame:
    """One row per paper, one column per system."""
    return scores.groupBy(key).pivot("system", list(systems)).agg(F.max("score"))


def better_system(scores: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """The best-scored system per paper; the first name wins a tie."""
    best = F.min_by(F.col("system"), F.struct(-F.col("score"), F.col("system")))
    return scores.groupBy(*key).agg(best.alias("best_system"))


def preference_agreement(a: DataFrame, b: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """How often two judges prefer the same system."""
    one = better_system(a, key).withColumnRenamed("best_system", "a")
    two = better_system(b, key).withColumnRenamed("best_system", "b")
    same = (F.col("a") == F.col("b")).cast("int")
    return one.join(two, list(key)).agg(F.avg(same).alias("agreement"), F.count("*").alias("n_items"))


def flag_ratios(rated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of answers that are not vague and of answers with complex aspects."""
    return rated.groupBy(*by).agg(
        F.avg((F.col("is_vague") == 0).cast("int")).alias("clear_share"),
        F.avg((F.size("complex_aspects") > 0).cast("int")).alias("complex_share"),
        F.count("*").alias("n_rows"),
    )
