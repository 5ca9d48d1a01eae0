"""Reading judge replies into a score, reasons and a parse flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.text import drop_reasoning, strip

# fixed values: fields of a reply and the pattern of a score object
REPLY_SCHEMA = "reasons string, reason string, score string"
REASONED_REPLY = r'\{\s*"reasons": "[^"]+",\s*"score": "?\d"?\s*\}'


def _judgement(parsed: Column, default_score: int, default_reasons: str) -> Column:
    score = parsed["score"].try_cast("int")
    ok = score.isNotNull()
    return F.struct(
        F.coalesce(score, F.lit(default_score)).alias("score"),
        F.when(ok, F.coalesce(parsed["reasons"], parsed["reason"], F.lit(""))).otherwise(
            F.lit(default_reasons)
        ).alias("reasons"),
        ok.alias("parse_ok"),
    )


def parse_json_reply(reply: Column, default_score: int = 5) -> Column:
    """JSON reply, or JSON on the last line after other text."""
    body = F.when(reply.startswith("{"), reply).otherwise(F.element_at(F.split(reply, "\n"), -1))
    return _judgement(F.from_json(body, REPLY_SCHEMA), default_score, "")


def parse_reasoned_reply(reply: Column, default_score: int = 1) -> Column:
    """First score object after the reasoning part."""
    found = F.regexp_extract(strip(drop_reasoning(reply)), REASONED_REPLY, 0)
    return _judgement(F.from_json(found, REPLY_SCHEMA), default_score, "")


def parse_structured_reply(reply: Column, default_score: int = 1) -> Column:
    return _judgement(F.from_json(reply, REPLY_SCHEMA), default_score, "no reason")


def parse_question_reply(reply: Column, asked: Column) -> Column:
    """Share of the asked questions a judge called good; 0 without questions or without a readable reply."""
    good = F.from_json(reply, "high_quality_questions array<string>")["high_quality_questions"]
    share = F.try_divide(F.size(good).cast("double"), F.size(asked).cast("double"))
    return F.struct(
        F.struct(
            F.coalesce(good, F.array().cast("array<string>")).alias("good_questions"),
            asked.alias("all_questions"),
        ).alias("reasons"),
        F.when(good.isNull(), F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )


def parse_quality_reply(reply: Column) -> Column:
    """Answer rating: vague or not, and the list of aspects that need expert knowledge."""
    return F.from_json(reply, "is_vague int, complex_aspects array<string>")
