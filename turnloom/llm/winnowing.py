"""Document fingerprints by winnowing: rolling k-gram hashes and the least of every window.

Of equal least hashes in a window the rightmost is chosen, and positions are kept. Any passage of ``WINDOW + GRAM - 1``
code points that two texts share gives both a common hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 16
WINDOW = 32
#: Grams hashed at once; bounds the memory of a task whatever the text's length.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_FIRST = -(1 << 63)


def _gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of every gram, by doubling, then mixed so that all bits count."""
    done, whole = 1, points.astype(np.uint64) + np.uint64(1)
    result, have = None, 0
    left = gram
    while left:
        if left & 1:
            # append a block of ``done`` code points to what is there
            if result is None:
                result, have = whole, done
            else:
                n = len(points) - have - done + 1
                result = result[:n] * np.uint64(pow(_BASE, done, 1 << 64)) + whole[have : have + n]
                have += done
        left >>= 1
        if left:
            whole = whole[: len(whole) - done] * np.uint64(pow(_BASE, done, 1 << 64)) + whole[done:]
            done *= 2
    result = result ^ (result >> np.uint64(31))
    result = result * np.uint64(0xBF58476D1CE4E5B9)
    return result ^ (result >> np.uint64(29))


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (44 bits) and their positions in code points, ascending.

    A text shorter than a gram is one gram at position 0; an empty text has none. A text of fewer grams than a window
    is one window.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = min(gram, len(points))
    grams = len(points) - gram + 1
    window = min(window, grams)
    low = np.uint64(SEGMENT - 1)
    hashes, places, start = [], [], 0
    while True:
        end = min(start + SEGMENT, grams)
        mixed = _gram_hashes(points[start : end + gram - 1], gram)
        # smaller hash first, and of equal ones the one further right
        key = (mixed & ~low) | (low - np.arange(end - start, dtype=np.uint64))
        span = 1
        while span < window:
            step = min(span, window - span)
            key = np.minimum(key[: len(key) - step], key[step:])
            span += step
        key = key[np.r_[True, key[1:] != key[:-1]]]
        places.append((low - (key & low)).astype(np.int64) + start)
        hashes.append(key >> np.uint64(20))
        if end == grams:
            break
        start = end - window + 1
    place, chosen = np.concatenate(places), np.concatenate(hashes)
    fresh = np.r_[True, place[1:] != place[:-1]]
    return chosen[fresh], place[fresh]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, hashes, positions`` of every row; a null text counts as empty and has empty lists."""

    @F.pandas_udf("hashes array<long>, positions array<long>")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [winnow(t or "", gram, window) for t in batch]
            yield pd.DataFrame({"hashes": [h.astype(np.int64) for h, _ in rows], "positions": [p for _, p in rows]})

    return docs.select("doc_id", marks("text").alias("m")).select("doc_id", "m.hashes", "m.positions")


def in_order(docs: DataFrame, rows_per_bucket: int = 1000, most_buckets: int = 100_000) -> DataFrame:
    """``bucket, tail, order, none, text``: whole texts dealt out by ranges of ``doc_id``, sorted within each.

    The first row of a bucket is also sent to the bucket before it (that of the first bucket to the last) and marked
    ``tail`` there, so every row finds its successor in its own partition. Bounds are approximate quantiles of the
    ids, one number per bucket; first ids are exact. ``order`` is the id, or the least number with ``none`` set where
    it is null; texts of one id follow each other.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_FIRST)).alias("order"))
    count = docs.count()
    buckets = int(min(max(1, -(-count // rows_per_bucket)), most_buckets))
    shares = [i / buckets for i in range(1, buckets)]
    found = keyed.agg(F.percentile_approx("order", shares, max(10_000, 10 * buckets)).alias("q")).first().q if shares and count else []
    bounds = np.unique(np.array(found, dtype=np.int64))

    @F.pandas_udf("long")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="right"))

    firsts = keyed.select("order").groupBy(bucket_of("order").alias("bucket")).agg(F.min("order").alias("first"))
    firsts = sorted((r.bucket, r["first"]) for r in firsts.collect())  # one number per bucket
    first_ids = np.array([f for _, f in firsts], dtype=np.int64)
    before = np.array([firsts[i - 1][0] for i in range(len(firsts))], dtype=np.int64)

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy(np.int64)
        own = np.searchsorted(bounds, ids, side="right")
        at = np.minimum(np.searchsorted(first_ids, ids), len(first_ids) - 1)
        is_first = first_ids[at] == ids
        return pd.Series([[2 * b, 2 * before[i] + 1] if f else [2 * b] for b, i, f in zip(own, at, is_first, strict=True)])

    rows = keyed.withColumn("place", F.explode(places("order")))
    rows = rows.select(F.expr("place div 2").alias("bucket"), F.expr("place % 2 = 1").alias("tail"), "order", F.col("doc_id").isNull().alias("none"), "text")
    dealt = rows.repartitionById(buckets, F.col("bucket").cast("int"))
    return dealt.sortWithinPartitions("bucket", "tail", "order", "text")

def compare_neighbours(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprint every text and its edited form: the last quarter replaced by the start of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_marks``. The last
    document's successor is the first; a lone document follows itself. A null text counts as empty. ``fingerprint``
    digests the chosen hashes with their positions; likenesses compare the sets of hashes. Texts cross the network
    once, and a task holds two texts at a time besides its batch.
    """

    def digest(marks: tuple[np.ndarray, np.ndarray]) -> str:
        return xxhash.xxh3_128_hexdigest(np.concatenate([marks[0], marks[1].view(np.uint64)]).tobytes())

    def row(doc_id, text, marks, after, after_marks):
        part = len(text) // 4
        edited = text[: len(text) - part] + after[:part]
        changed = winnow(edited, gram, window)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), digest(marks), digest(changed),
            likeness(marks[0], changed[0]), likeness(marks[0], after_marks[0]), len(marks[0]),
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_marks long"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its successor: doc_id, text, marks
        for batch in batches:
            rows = []
            for tail, order, none, text in zip(batch["tail"], batch["order"], batch["none"], batch["text"], strict=True):
                if tail and held is None:  # further rows of the id that closed this bucket
                    continue
                marks = winnow(text, gram, window)
                if held is not None:
                    rows.append(row(*held, text, marks))
                held = None if tail else (None if none else order, text, marks)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    return in_order(docs).mapInPandas(scan, schema)
