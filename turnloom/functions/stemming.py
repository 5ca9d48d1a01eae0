"""Porter stemming (Porter 1980) of token batches, used inside a vectorised stage."""

from __future__ import annotations

import re

import pandas as pd

_C = "[^aeiou](?:[^aeiouy]*)"
_V = "[aeiouy](?:[aeiou]*)"
_M1 = re.compile(f"^(?:{_C})?{_V}{_C}")
_M1_ONLY = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_M2 = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_VOWEL = re.compile(f"^(?:{_C})?{_V}")
_CVC = re.compile("^" + _C + "[aeiouy][^aeiouwxy]$")

# fixed values: suffix tables of steps 2, 3 and 4 in the published order
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()


def _replace(word: str, table: list[tuple[str, str]]) -> str:
    """Swap the longest matching suffix when its stem holds a vowel-consonant sequence."""
    for old, new in sorted(table, key=lambda p: -len(p[0])):
        if word.endswith(old):
            base = word[: len(word) - len(old)]
            return base + new if _M1.match(base) else word
    return word


def stem(word: str) -> str:
    if len(word) <= 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _M1.match(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            base = word[: -len(end)]
            if word.endswith(end) and _VOWEL.match(base):
                if base.endswith(("at", "bl", "iz")):
                    word = base + "e"
                elif re.search(r"([^aeiouylsz])\1$", base):
                    word = base[:-1]
                elif _M1_ONLY.match(base) and _CVC.match(base):
                    word = base + "e"
                else:
                    word = base
                break
    if word.endswith("y") and _VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            if _M2.match(base) and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _M2.match(base) or (_M1_ONLY.match(base) and not _CVC.match(base)):
            word = base
    if word.endswith("ll") and _M2.match(word):
        word = word[:-1]
    return word


def stem_all(token_lists: pd.Series) -> pd.Series:
    """Stem lists of tokens; each distinct token of the batch is stemmed once."""
    known: dict[str, str] = {}

    def one(token: str) -> str:
        if token not in known:
            known[token] = stem(token)
        return known[token]

    return token_lists.map(lambda ts: None if ts is None else [one(t) for t in ts])
