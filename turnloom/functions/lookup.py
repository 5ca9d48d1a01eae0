"""Words of one text looked up in another, in Python over Arrow batches: the text is searched, not cut into words.

Lower case beyond ASCII comes from the JVM, so that a word is the same here and there. Letters and numbers are those of
Python's Unicode tables. A search that meets a word inside other words too often gives way to cutting the text, and so
do many words at once, so the cost follows the texts' length whatever they hold.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Different words, and places inside other words, up to which a text is searched.
FEW, MISSES = 48, 256
SPACE = " \t\n\x0b\f\r"
_WORD = re.compile(f"[^{SPACE}]+")
_TOKEN = re.compile(r"[^\W_]+")


def share_held(premise: str | None, claim: str | None) -> float:
    """Share of the claim's distinct tokens found among the premise's; 0 without a token or a text."""
    asked = set(_TOKEN.findall(claim or ""))
    if not asked or not premise:
        return 0.0
    held = len(asked.intersection(_TOKEN.findall(premise))) if len(asked) > FEW else _count_held(premise, asked)
    return held / len(asked)


def _count_held(premise: str, asked: set[str]) -> int:
    held, misses, end = 0, 0, len(premise)
    for word in asked:
        at = premise.find(word)
        while at >= 0:
            after = at + len(word)
            if not (at and premise[at - 1].isalnum()) and not (after < end and premise[after].isalnum()):
                held += 1
                break
            misses += 1
            if misses > MISSES:
                return len(asked.intersection(_TOKEN.findall(premise)))
            at = premise.find(word, at + 1)
    return held


def last_spellings(context: str, low: str, asked: set[str]) -> dict[str, str]:
    """The last spelling in ``context`` of the asked lower-case words that it holds; ``low`` is it in lower case."""
    # a letter whose lower case is longer would shift the places
    if len(asked) > FEW or len(context) != len(low):
        return dict(zip(_WORD.findall(low), _WORD.findall(context)))
    text, back = f" {context} ", f" {low} "[::-1]
    found, misses, end = {}, 0, len(back)
    for word in asked:
        turned, n = word[::-1], len(word)
        at = back.find(turned)
        while at >= 0:
            if back[at - 1] in SPACE and back[at + n] in SPACE:
                found[word] = text[end - at - n : end - at]
                break
            misses += 1
            if misses > MISSES:
                return dict(zip(_WORD.findall(low), _WORD.findall(context)))
            at = back.find(turned, at + 1)
    return found


def respelt(context: str | None, low: str | None, claim: str | None, low_claim: str | None) -> str | None:
    """The claim's words, joined by blanks, in the last spelling that the context has of them."""
    if claim is None:
        return None
    words, lows = _WORD.findall(claim), _WORD.findall(low_claim)
    known = last_spellings(context, context.lower() if low is None else low, set(lows)) if context and lows else {}
    return " ".join([known.get(key, word) for key, word in zip(lows, words)])


@F.arrow_udf(DoubleType())
def token_share(premise: pa.Array, claim: pa.Array) -> pa.Array:
    """``share_held`` of lower-case texts."""
    return pa.array([share_held(p, c) for p, c in zip(premise.to_pylist(), claim.to_pylist())], pa.float64())


@F.arrow_udf(StringType())
def respelt_words(context: pa.Array, low: pa.Array, claim: pa.Array, low_claim: pa.Array) -> pa.Array:
    """``respelt`` of texts and their lower case, which a context of ASCII letters alone does without."""
    rows = zip(context.to_pylist(), low.to_pylist(), claim.to_pylist(), low_claim.to_pylist())
    return pa.array([respelt(*row) for row in rows], pa.string())
