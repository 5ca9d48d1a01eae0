"""Preference pairs: rate the last answer, choose the follow-up instruction, generate both questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import dialogue as dg
from turnloom.functions import parsing as ps
from turnloom.operators.stages import Client, batch_stage, echo_reply, quality_reply

VAGUE = "The last answer was vague. Ask one short follow-up question that seeks clarification and more depth."
COMPLEX = "The last answer holds these unexplained aspects: {}. Ask one short follow-up question about them."
CLEAR = "The last answer was clear. Ask one question about the impact of the research on society."
GENERIC = "Ask one new, generic question about the research that does not follow up on the last answer."


def follow_up_instruction(is_vague: Column, complex_aspects: Column, compat: bool = False) -> Column:
    """Instruction for the preferred question: complex aspects first, then vagueness, then a clear answer.

    With ``compat`` a vague answer without complex aspects counts as clear.
    """
    left, right = COMPLEX.split("{}")
    explain = F.concat(F.lit(left), F.array_join(complex_aspects, ", "), F.lit(right))
    some = F.coalesce(F.size(complex_aspects), F.lit(0)) > 0
    out = F.when(some, explain)
    if not compat:
        out = out.when(is_vague == 1, F.lit(VAGUE))
    return out.otherwise(F.lit(CLEAR))


def rate_answers(
    df: DataFrame, text: str, reply: Callable[[Column], Column] = quality_reply, make_client: Callable[[], Client] | None = None
) -> DataFrame:
    """Add ``is_vague`` and ``complex_aspects``. A table that already holds both is returned as it is."""
    if {"is_vague", "complex_aspects"} <= set(df.columns):
        return df
    if make_client is None:
        rated = df.withColumn("_reply", reply(F.col(text)))
    else:
        rated = batch_stage(df, make_client, F.col(text), "_reply").drop("_reply_error")
    return (
        rated.withColumn("_q", ps.parse_quality_reply(F.col("_reply")))
        .select(*df.columns, "_q.is_vague", "_q.complex_aspects")
    )


def question_prompt(paper: Column, history: Column) -> Column:
    return F.concat(
        F.lit("[PAPER]:\n"), paper, F.lit("\n\n[CONVERSATION HISTORY]:\n"), F.to_json(history)
    )


def preference_pairs(
    df: DataFrame,
    prompt: str = "prompt",
    generator: Callable[[Column], Column] = echo_reply,
    make_client: Callable[[], Client] | None = None,
    keep: tuple[str, ...] = ("row_id",),
    compat: bool = False,
    keep_skipped: bool = False,
    rater: Callable[[Column], Column] = quality_reply,
    make_rater: Callable[[], Client] | None = None,
) -> DataFrame:
    """``(keep..., chosen, rejected, is_vague, complex_aspects)`` per prompt that ends with the researcher's answer.

    Answers are rated by ``rater``, a column function, or by the client of ``make_rater``.

    Prompts without an open answer, or with an unreadable rating, hold nulls and are dropped unless
    ``keep_skipped``.
    """
    given = [c for c in ("is_vague", "complex_aspects") if c in df.columns]
    base = df.select(*keep, prompt, *given).withColumn("_answer", dg.open_answer(F.col(prompt)))
    rated = rate_answers(base, "_answer", rater, make_rater)
    usable = F.col("_answer").isNotNull() & F.col("is_vague").isNotNull()
    content = question_prompt(dg.paper_of(F.col(prompt)), dg.history_of(F.col(prompt)))
    instruction = follow_up_instruction(F.col("is_vague"), F.col("complex_aspects"), compat)
    asked = rated.withColumn("_usable", usable).withColumn("_content", F.when(usable, content))
    chosen = F.concat_ws("\n\n", instruction, F.col("_content"))
    rejected = F.concat_ws("\n\n", F.lit(GENERIC), F.col("_content"))
    ready = asked if keep_skipped else asked.where("_usable")
    if make_client is None:
        made = ready.withColumn("chosen", F.when(F.col("_usable"), generator(chosen))).withColumn(
            "rejected", F.when(F.col("_usable"), generator(rejected))
        )
    else:
        made = batch_stage(ready, make_client, chosen, "chosen").drop("chosen_error")
        made = batch_stage(made, make_client, rejected, "rejected").drop("rejected_error")
    out = made.select(
        *keep,
        F.trim("chosen").alias("chosen"),
        F.trim("rejected").alias("rejected"),
        F.when(F.col("_usable"), F.col("is_vague")).alias("is_vague"),
        F.when(F.col("_usable"), F.col("complex_aspects")).alias("complex_aspects"),
    )
    return out if keep_skipped else out.where(F.col("chosen").isNotNull())
