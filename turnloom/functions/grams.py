"""Multisets of n-grams inside one row, as arrays of tagged grams.

The second and later occurrences of a gram get their number as a tag, so a multiset is an array without repeats: common
occurrences of two are its intersection, the larger count of each gram over several is the union.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.binding import let

TAG = "\u0001"


def ngrams(tokens: Column, n: int) -> Column:
    """Consecutive token n-grams joined by blanks."""
    if n == 1:
        return tokens
    start = lambda ts: F.sequence(F.lit(1), F.size(ts) - (n - 1))
    grams = lambda ts: F.transform(start(ts), lambda i: F.array_join(F.slice(ts, i, n), " "))
    none = F.array().cast("array<string>")
    return let(tokens, lambda ts: F.when(F.size(ts) >= n, grams(ts)).otherwise(none))


def run_starts(ordered: Column, key=lambda x: x) -> Column:
    """0-based places in a sorted array at which a new key begins."""
    fresh = lambda xs: F.filter(
        F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (key(F.get(xs, i)) != key(F.get(xs, i - 1)))
    )
    return let(ordered, lambda xs: F.when(F.size(xs) > 0, fresh(xs)).otherwise(F.array().cast("array<int>")))


def by_run(ordered: Column, starts: Column, body) -> Column:
    """``body(run)`` for each run of a sorted array; both columns are used as they are, so bind them first."""
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(ordered))
    return F.transform(starts, lambda at, k: body(F.slice(ordered, at + 1, end(k) - at)))


def tagged(grams: Column) -> Column:
    """The multiset of an array of strings."""
    number = lambda run: F.transform(run, lambda g, i: F.when(i == 0, g).otherwise(F.concat(g, F.lit(TAG), i.cast("string"))))
    whole = lambda xs: let(run_starts(xs), lambda starts: F.flatten(by_run(xs, starts, number)))
    # most sentences repeat nothing: they are a multiset as they are
    once = lambda gs: F.size(F.array_distinct(gs)) == F.size(gs)
    return let(grams, lambda gs: F.when(once(gs), gs).otherwise(let(F.sort_array(gs), whole)))


def shared(a: Column, b: Column) -> Column:
    """Occurrences that two multisets have in common: the sum of the smaller counts."""
    return F.size(F.array_intersect(a, b))


def widest(multisets: Column) -> Column:
    """The largest count of each gram over an array of multisets."""
    return F.array_distinct(F.flatten(multisets))
