"""How document filters interact, by a Gray-code walk over all subsets of them.

Every document becomes a mask of the filters that it fails. Documents of one mask and part form a cell, so what is left
of a table of any size is at most 32 rows of counts per part. The walk turns one filter on or off at a time; each cell
keeps a counter of the active filters that it fails, and the running survivors change only where a counter leaves or
reaches zero. The 32 states are stored; a step of any order of the filters is a difference of two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import durable

FILTERS = "ABCDE"
#: The filter that compares documents; the others look at one text.
REPEATED = FILTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"


def failed(text: bytes, length: int) -> int:
    """Mask of the filters A to D that a UTF-8 text of ``length`` code points fails; filter A is the lowest bit."""
    words = text.split()  # on bytes: runs without ASCII white space
    capitals = len(text) - len(text.translate(None, CAPITALS))
    found = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * capitals > 10 * length,
        len(text.translate(None, SIGNS)) < len(text),
    )
    return sum(1 << i for i, fails in enumerate(found) if fails)


def _checked(text: Column) -> Column:
    @F.pandas_udf("mask int, digest binary")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                raw = t.encode("utf-8")
                rows.append((failed(raw, len(t)), hashlib.blake2b(raw, digest_size=16).digest()))
            yield pd.DataFrame(rows, columns=["mask", "digest"])

    return check(F.coalesce(text, F.lit("")))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: one row per part and mask that occurs.

    A document fails the last filter if its text is that of a smaller ``doc_id``; rows that repeat the least id all
    pass, a row without an id passes and makes no other fail. Labels of one id count once, good or toxic if any row
    says so.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), _checked(F.col("text")).alias("c"))
    rows = durable(rows.select("doc_id", "part", "c.mask", "c.digest"))
    # folded in the input tasks; the join below has the id in its key, so copies of one text spread over all tasks
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    joined = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    mask = F.col("mask") + F.when(repeated, 1 << REPEATED).otherwise(0)
    counted = joined.groupBy("part", mask.alias("mask"))
    return counted.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def states(found: Iterable[tuple[int, int, int, int]], filters: int = len(FILTERS)) -> np.ndarray:
    """Survivors by subset of active filters: all, good and toxic documents; ``found`` has ``mask, n, good, toxic``."""
    found = list(found)
    sizes = np.array([c[1:] for c in found], np.int64).reshape(-1, 3)
    active = [0] * len(found)
    left, at = sizes.sum(axis=0), 0
    out = np.zeros((1 << filters, 3), np.int64)
    out[0] = left
    for i in range(1, 1 << filters):
        bit = i & -i  # the bit in which two neighbouring Gray codes differ
        at ^= bit
        step = 1 if at & bit else -1
        for c, (mask, *_) in enumerate(found):
            if mask & bit:
                active[c] += step
                if step == 1 and active[c] == 1:
                    left = left - sizes[c]
                elif step == -1 and active[c] == 0:
                    left = left + sizes[c]
        out[at] = left
    return out


def shapley(kept: np.ndarray, filters: int = len(FILTERS)) -> list[int]:
    """By filter, what it removes summed over all orders: each subset before it stands for so many of them."""
    total = [0] * filters
    for before in range((1 << filters) - 1):
        size = before.bit_count()
        orders = factorial(size) * factorial(filters - 1 - size)
        for f in range(filters):
            if not before >> f & 1:
                total[f] += orders * int(kept[before] - kept[before | 1 << f])
    return total


def steps(found: Iterable[tuple[int, int, int, int]]) -> list[tuple]:
    """``filter_order, step`` and the counts of every step of every order."""
    found = list(found)
    left = states(found)
    fails = [sum(n for mask, n, *_ in found if mask >> f & 1) for f in range(len(FILTERS))]
    alone = [sum(n for mask, n, *_ in found if mask == 1 << f) for f in range(len(FILTERS))]
    worth = shapley(left[:, 0])
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone, good, toxic = (left[before] - left[after]).tolist()
            rows.append((name, step, int(left[after, 0]), gone, fails[f] - gone, alone[f], good, toxic, worth[f]))
            before = after
    return rows


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the counts of ``COUNTS`` for every part, order of the filters and step.

    ``part`` is ``lang``; null and empty are one part. A null text is empty. Parts without documents do not come, so
    no rows give no result; other columns are ignored.
    """
    each = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    names = ["filter_order", "step", *COUNTS]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, found in zip(batch["part"], batch["cells"], strict=True):
                out = pd.DataFrame(steps((c["mask"], c["n"], c["good"], c["toxic"]) for c in found), columns=names)
                out.insert(0, "part", part)
                yield out

    return each.mapInPandas(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
