"""Multi-party perspective rotation of dialogues. DataFrame functions only.

Every participant of a dialogue gets a rendering with that speaker as the assistant and all others as named users.
A rendering comes as one row per message with its place in the whole, so no dialogue is gathered, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import durable

#: Turn numbers that are summed up together; a long dialogue is cut into such stretches.
STRETCH = 256


def _header(role: Column, name: Column) -> Column:
    named = F.concat(F.lit(" name="), name)
    return F.concat(F.lit("<|im_start|>"), role, F.coalesce(F.when(role == "user", named), F.lit("")), F.lit("\n"))


def rotate(messages: DataFrame) -> DataFrame:
    """``conv_id, perspective, position, turn, role, name, segment, start, mask_start, mask_end``.

    ``messages`` has ``conv_id, turn, role, text``; ``role`` names the speaker. Every speaker but ``system`` is a
    participant. In order of ``position`` the segments of one ``(conv_id, perspective)`` make the rendered dialogue and
    ``start`` is the segment's place in it, in code points. The assistant's segments carry the span to learn, text and
    closing mark; all others have a null mask.

    Turns go in ascending order, null last; messages of one turn by speaker, then text. A null speaker is a participant
    without a name and has the null perspective; a null text is empty; null ``conv_id`` is one dialogue. A dialogue of
    system messages alone has no participant and no row; repeated rows are messages of their own. Messages of one turn
    number stay in one stretch; otherwise stretches, not dialogues, are what a task sorts.
    """
    rows = messages.select(
        "conv_id", "turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit((1 << 63) - 1)).alias("stretch"),
    )
    parties = rows.where(~F.col("speaker").eqNullSafe("system")).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(parties, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(F.col("speaker").eqNullSafe("system"), "system").when(own, "assistant").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("head", _header(F.col("role"), F.col("speaker")))
    seen = seen.withColumn("segment", F.concat("head", "text", F.lit("<|im_end|>\n")))
    seen = seen.withColumn("length", F.length("segment").cast("long"))
    inside = Window.partitionBy("conv_id", "perspective", "stretch").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    seen = seen.withColumn("nth", F.row_number().over(inside).cast("long"))
    seen = seen.withColumn("ahead", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    seen = durable(seen)
    sums = seen.groupBy("conv_id", "perspective", "stretch").agg(F.sum("length").alias("chars"), F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("conv_id", "perspective").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("stretch").alias("s"),
        (F.sum("chars").over(so_far) - F.col("chars")).alias("chars_before"), (F.sum("n").over(so_far) - F.col("n")).alias("before"),
    )
    placed = seen.join(
        sums, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("perspective").eqNullSafe(F.col("p")) & (F.col("stretch") == F.col("s"))
    )
    start = F.col("chars_before") + F.col("ahead")
    learnt = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", (F.col("before") + F.col("nth") - 1).alias("position"), "turn", "role", F.when(F.col("role") == "user", F.col("speaker")).alias("name"),
        "segment", start.alias("start"),
        F.when(learnt, start + F.length("head")).alias("mask_start"),
        F.when(learnt, start + F.col("length") - 1).alias("mask_end"),
    )
