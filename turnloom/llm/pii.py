"""Personal data: base patterns, and spans found by weak supervision.

Base kinds (e-mail, address of a machine, card, phone) are patterns and always stay. For other spans, names and
secrets, labelers of three sorts vote: patterns, gazetteers and context. Expectation-maximisation estimates from all
votes of the corpus how reliable each labeler is, and a classifier fitted to the resulting beliefs decides from the
features of a span alone, so it also finds spans on which few labelers vote.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "secret")

# The class of characters in front of "@" cannot hold "@", so a search needs to start at the beginning of a run or at
# the end of the last match only; the same holds for runs of digits. All patterns take time in proportion to the text.
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_HERE = re.compile(_EMAIL)
EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL)
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while (m := EMAIL_HERE.match(text, at) or EMAIL_RUN.search(text, at)) is not None:
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base kinds, leftmost without overlap per kind; failing matches are dropped."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# Candidates of the weak part: runs that mix letters and digits, and two capitalised words within a sentence.
SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{12,}+")
NAME = re.compile(r"(?<=[\w,;:=] )[A-ZÀ-Þ][\wÀ-ÿ'-]++ [A-ZÀ-Þ][\wÀ-ÿ'-]++")
# Gazetteers and cue words.
FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara maria anna thomas peter paul hans klaus"
    " julia sophie marie pierre jean luc claire carlos jose juan luis carmen ana pedro miguel sarah laura daniel martin".split()
)
PUBLIC_WORDS = frozenset(
    "license licence public general apache version mit gnu creative commons attribution international foundation university"
    " january february march april may june july august september october november december".split()
)
NAME_CUES = frozenset("mr mrs ms dr prof name named contact call from signed herr frau monsieur madame señor señora sr sra user author".split())
SECRET_CUES = frozenset("password passwd pwd token secret key apikey api_key auth bearer credential passwort contraseña clave".split())
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
KEY_ID = re.compile(r"[A-Z]{4}[A-Z0-9]{12,}")
LABELERS = ("pattern", "gazetteer", "public words", "cue word", "assignment", "mixture")
FEATURES = 10


def _left_words(text: str, start: int, most: int = 3) -> list[str]:
    return re.findall(r"\w+", text[max(0, start - 40) : start].lower())[-most:]


def candidates(text: str) -> Iterator[tuple[int, int, int, tuple[int, ...], int]]:
    """``(start, kind number, end, votes, features)``; a vote is 1 for, 0 against, 2 for none, features are bits."""
    found = [(m.start(), 5, m.end()) for m in SECRET.finditer(text)] + [(m.start(), 4, m.end()) for m in NAME.finditer(text)]
    for start, kind, end in sorted(found):
        span = text[start:end]
        words = span.lower().split()
        before = _left_words(text, start)
        secret = kind == 5
        digits = sum(c.isdigit() for c in span)
        upper = sum(c.isupper() for c in span)
        cue = any(w in (SECRET_CUES if secret else NAME_CUES) for w in before)
        assigned = text[max(0, start - 3) : start].rstrip("\"' ").endswith(("=", ":"))
        known = any(w in FIRST_NAMES for w in words)
        public = any(w.strip(".,") in PUBLIC_WORDS for w in words + before)
        shaped = secret and len(span) >= 16 and bool(HEX.fullmatch(span) or KEY_ID.fullmatch(span))
        mixed = secret and 0.15 <= digits / len(span) <= 0.85
        hyphens = secret and ("-" in span or "/" in span)
        votes = (
            1 if shaped else 2,
            (1 if known else 0) if not secret else 2,
            0 if public else 2,
            1 if cue else 2,
            1 if assigned else 2,
            (1 if mixed and not hyphens else 0) if secret else 2,
        )
        bits = (secret, len(span) >= 16, len(span) >= 24, mixed, upper > 0, upper > len(span) / 2, cue, assigned, known, public)
        yield start, kind, end, votes, sum(1 << i for i, b in enumerate(bits) if b)


@dataclass(frozen=True)
class Supervision:
    """``right``: by labeler, the share of right votes; ``weights``: of the span classifier, its bias last."""

    prior: float
    right: tuple[float, ...]
    weights: tuple[float, ...]

    def accepts(self, features: int) -> bool:
        return bool(_bits(np.array([features]))[0] @ np.array(self.weights) > 0)


def _bits(features: np.ndarray) -> np.ndarray:
    return np.hstack([(features[:, None] >> np.arange(FEATURES)) & 1, np.ones((len(features), 1), int)]).astype(float)


def _beliefs(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation for labelers that are right with one rate each and may abstain.

    The rates start at 0.8 and the prior at a half; one imaginary right vote in 0.8 of 10 keeps a rate defined where
    a labeler never votes.
    """
    right, prior = np.full(votes.shape[1], 0.8), 0.5
    cast, yes = votes != 2, votes == 1
    belief = np.full(len(votes), 0.5)
    for _ in range(rounds):
        up, down = np.log(right), np.log(1 - right)
        for_true = (np.where(yes, up, down) * cast).sum(axis=1) + np.log(prior)
        for_false = (np.where(yes, down, up) * cast).sum(axis=1) + np.log(1 - prior)
        belief = 1 / (1 + np.exp(np.clip(for_false - for_true, -50, 50)))
        agree = np.where(yes, belief[:, None], 1 - belief[:, None]) * cast * counts[:, None]
        right = np.clip((agree.sum(axis=0) + 8) / ((cast * counts[:, None]).sum(axis=0) + 10), 0.55, 0.99)
        prior = float(np.clip((belief @ counts + 1) / (counts.sum() + 2), 0.02, 0.98))
    return belief, prior, right


def supervise(docs: DataFrame) -> Supervision:
    """Reliabilities and classifier from the votes on every candidate of every text.

    Votes and features are counted by Spark; at most 3**6 x 2**10 counts come to the driver, however large the corpus.
    Without candidates nothing is accepted.
    """

    @F.pandas_udf("array<int>")
    def codes(texts: pd.Series) -> pd.Series:
        # one number per candidate: votes in base 3, then the feature bits
        return pd.Series([[sum(v * 3**i for i, v in enumerate(votes)) << FEATURES | bits for *_, votes, bits in candidates(t or "")] for t in texts])

    counted = docs.select(F.explode(codes("text")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counted:
        return Supervision(0.5, (0.8,) * len(LABELERS), (0.0,) * FEATURES + (-1.0,))
    counted.sort()
    code, n = np.array([r.code for r in counted]), np.array([r.n for r in counted], float)
    votes = (code[:, None] >> FEATURES) // 3 ** np.arange(len(LABELERS)) % 3
    belief, prior, right = _beliefs(votes, n)
    x, share = _bits(code & ((1 << FEATURES) - 1)), n / n.sum()
    weights = np.zeros(FEATURES + 1)
    for _ in range(50):  # Newton steps of a ridge-penalised logistic regression on the beliefs
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (share * (p - belief)) + 1e-3 * weights
        curvature = (x.T * (share * p * (1 - p))) @ x + 1e-3 * np.eye(FEATURES + 1)
        weights = weights - np.linalg.solve(curvature, gradient)
    return Supervision(prior, tuple(float(r) for r in right), tuple(float(w) for w in weights))


def all_spans(text: str, model: Supervision) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base with accepted spans, each by start and kind. Accepted spans never overlap a base span."""
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e in base)
    more, at = [], 0
    for start, kind, end, _, bits in candidates(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if (at == len(taken) or taken[at][0] >= end) and model.accepts(bits):
            more.append((start, kind, end))
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def span_column(text: Column, model: Supervision) -> Column:
    """``n_email, n_ip, n_card, n_phone, base_sha256, spans`` of a text; a null text counts as empty.

    Counts and digest are of the base spans; ``spans`` lists all, in code points with the end exclusive. Spans of one
    kind never overlap, those of different base kinds may.
    """

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                base, spans = all_spans(text or "", model)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found(text)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``span_column`` for every row of ``docs``, whole texts. No rows, no result."""
    rows = docs.select("doc_id", span_column(F.col("text"), supervise(docs)).alias("p"))
    return rows.select("doc_id", "p.*")
