"""SimHash near-duplicates by a binary trie self-join on Hamming distance.

The trie of all fingerprints is walked in node pairs: both children of both nodes are paired, a bit that differs adds
one to the pair's error, and a pair above the budget is dropped with everything below it.

On Spark the walk starts below the top of the trie. Two fingerprints within two bits agree in at least one of three
blocks of bits, so a shuffle on (block, its bits) brings each linked pair together in one group, where the walk takes
the agreed bits as done. A group with too many fingerprints is split again in the same way by blocks of its free bits,
up to three times; then at most 2**20 different fingerprints can be in it, whatever the corpus. A pair counts only in
the first block in which it agrees, so each link is found once. A group returns one row per fingerprint, not its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.components import components
from turnloom.session import durable

BUDGET = 2
#: A group above so many fingerprints is split by further blocks.
GROUP = 2048
#: Node pairs walked at once, and shingles counted at once; both bound a task's memory.
PAIRS = 1 << 19
SHINGLES = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of word shingles; A-Z are lower-cased, a word is a run without ASCII white space.

    Repeated shingles count again. Fewer words than a shingle are one shingle; no words give zero.
    """
    tokens = text.encode("utf-8").lower().split()  # on bytes both know ASCII only
    if not tokens:
        return 0
    size, last = min(words, len(tokens)), len(tokens) - min(words, len(tokens)) + 1
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, last, SHINGLES):
        stop = min(start + SHINGLES, last)
        lists = [tokens[start + i : stop + i] for i in range(size)]
        hashes = np.array([digest(b" ".join(s), 42) for s in zip(*lists, strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long; a null text has no words."""

    @F.pandas_udf("long")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t or "", words) for t in batch], dtype=np.uint64).view(np.int64))

    return signed(text)


def _blocks(free: list[int], budget: int) -> list[list[int]]:
    """``budget + 1`` blocks of nearly equal length."""
    parts = budget + 1
    return [free[len(free) * i // parts : len(free) * (i + 1) // parts] for i in range(parts)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _paths(budget: int, depth: int = 3) -> dict[int, tuple[int, list[int], list[int]]]:
    """By path number: the mask of agreed bits, the masks of earlier blocks, and the path numbers one block deeper."""
    paths: dict[int, tuple[int, list[int], list[int]]] = {}

    def grow(agreed: list[int], earlier: list[int], level: int) -> list[int]:
        free = [b for b in range(63, -1, -1) if b not in agreed]
        here, before = [], list(earlier)
        for block in _blocks(free, budget):
            number = len(paths)
            paths[number] = (_mask(agreed + block), list(before), [])
            here.append(number)
            if level + 1 < depth:
                paths[number] = (*paths[number][:2], grow(agreed + block, before, level + 1))
            before.append(_mask(block))
        return here

    paths[-1] = (0, [], [])
    paths[-1] = (0, [], grow([], [], 0))
    return paths


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def walk(values: np.ndarray, starts: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits inside each group.

    ``values`` holds the groups one after the other, each ascending and without repeats; ``starts`` their first
    indices. Chunks of node pairs are walked depth first, so at most a few times ``PAIRS`` of them are held.
    """
    ends = np.append(starts[1:], len(values))
    zero = np.zeros(len(starts), np.int64)
    stack = [(63, starts, ends, starts, ends, zero)]
    while stack:
        bit, a0, a1, b0, b1, errors = stack.pop()
        if len(a0) > PAIRS:
            half = len(a0) // 2
            stack += [(bit, a0[k], a1[k], b0[k], b1[k], errors[k]) for k in (slice(half, None), slice(half))]
            continue
        # paths without branches are taken at once
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, errors = (x[~single] for x in (a0, a1, b0, b1, errors))
        if bit < 0 or not len(a0):
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = (a0 == b0) & (a1 == b1)
        cross = ~own
        kids = (
            (a0, am, b0, bm, errors, slice(None)),
            (am, a1, bm, b1, errors, slice(None)),
            (a0, am, bm, b1, errors + 1, slice(None)),
            (am, a1, b0, bm, errors + 1, cross),
        )
        parts = [[x[pick] for x in kid] for *kid, pick in kids]
        a0, a1, b0, b1, errors = (np.concatenate([p[k] for p in parts]) for k in range(5))
        keep = (a1 > a0) & (b1 > b0) & (errors <= budget)
        stack.append((bit - 1, *(x[keep] for x in (a0, a1, b0, b1, errors))))


def _join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the trees of every pair; a root is the least index of its tree."""
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        low, high = np.minimum(parent[i], parent[j]), np.maximum(parent[i], parent[j])
        apart = low != high
        if not apart.any():
            return
        np.minimum.at(parent, high[apart], low[apart])


def linked(prints: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """``fp, root, links`` from the groups: a fingerprint, the least one that it reaches in its group, its links there.

    ``prints`` has one row per different fingerprint ``fp`` (signed long, never null). A fingerprint without links is
    absent; one with links in several groups has a row for each, and its links add up over them.
    """
    paths = _paths(budget)

    def deal(rows: DataFrame, numbers: list[int]) -> DataFrame:
        """Rows of ``fp, path`` once per block below their path, with the size ``n`` of the group they meet; no lone rows."""
        below = [
            F.when(
                F.col("path") == p,
                F.array(*[F.struct(F.lit(q).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(paths[q][0]))).alias("key")) for q in paths[p][2]]),
            )
            for p in numbers
        ]
        dealt = durable(rows.select("fp", F.explode(F.coalesce(*below)).alias("g")).select("fp", "g.path", "g.key"))
        sizes = durable(dealt.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        return durable(dealt.join(sizes, ["path", "key"]))

    numbers, groups = [-1], None
    dealt = prints.select("fp", F.lit(-1).alias("path"))
    while dealt is not None:
        dealt = deal(dealt, numbers)
        numbers = [q for p in numbers for q in paths[p][2]]
        last = not any(paths[p][2] for p in numbers)
        ready = dealt if last else dealt.where(F.col("n") <= group)
        groups = ready if groups is None else groups.unionByName(ready)
        large = dealt.where(F.col("n") > group).select("fp", "path")
        dealt = None if last or large.isEmpty() else large
    earlier = {p: [np.uint64(m) for m in before] for p, (_, before, _) in paths.items()}

    def links(path: np.ndarray, values: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        parent, count = np.arange(len(values)), np.zeros(len(values), np.int64)
        for i, j in walk(values, starts, budget):
            apart, kinds = values[i] ^ values[j], path[i]
            first = np.ones(len(i), bool)
            for p in np.unique(kinds):
                for mask in earlier[int(p)]:
                    first &= (kinds != p) | (apart & mask != 0)
            i, j = i[first], j[first]
            np.add.at(count, i, 1)
            np.add.at(count, j, 1)
            _join_roots(parent, i, j)
        has = count > 0
        return pd.DataFrame({"fp": values[has].view(np.int64), "root": values[parent[has]].view(np.int64), "links": count[has]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            path, key, order = rows["path"].to_numpy(), rows["key"].to_numpy(), rows["order"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])]) if len(rows) else np.empty(0, np.int64)
            if len(starts) > 1:
                last = starts[-1]  # the last group may go on in the next batch
                yield links(path[:last], (order[:last] ^ _LOW).view(np.uint64), starts[:-1])
                rows = rows.iloc[last:]
            held = rows
        if held is not None and len(held):
            path = held["path"].to_numpy()
            yield links(path, (held["order"].to_numpy() ^ _LOW).view(np.uint64), np.zeros(1, np.int64))

    # with the sign bit turned, signed order is the unsigned order of the trie
    ordered = groups.select("path", "key", F.col("fp").bitwiseXOR(F.lit(int(_LOW))).alias("order"))
    return ordered.repartition("path", "key").sortWithinPartitions("path", "key", "order").mapInPandas(scan, "fp long, root long, links long")


_LOW = np.int64(-(1 << 63))


def labelled(docs: DataFrame, words: int, budget: int = BUDGET, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, fp`` for every row and ``fp, least, label, links`` for every fingerprint; linked ones share a label."""
    rows = durable(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_column(F.col("text"), words).alias("fp")))
    prints = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = durable(linked(prints.select("fp"), budget, group))
    labels = components(found.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("fp").agg(F.sum("links").alias("links"))
    named = durable(
        prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
        .join(counts, "fp", "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    return rows, named


def _classes(docs: DataFrame, words: int, budget: int, group: int) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, links`` for every row."""
    rows, named = labelled(docs, words, budget, group)
    least = durable(named.groupBy("label").agg(F.min("least").alias("component_id")))
    classes = durable(named.join(least, "label").select("fp", "component_id", "links"))
    return rows.join(classes, "fp")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """``doc_id, fp, component_id, links`` for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` reachable over fingerprints that differ in ``budget`` bits or fewer, the
    row's own included; null only where every row reached has no id. ``links`` counts the other fingerprints within the
    budget. Null and wordless texts have fingerprint zero and are linked like any other. Rows of one fingerprint are
    folded into one before the join, so copies cost nothing; repeated rows come back repeated. No rows, no result.
    """
    return _classes(docs, words, budget, group).select("doc_id", "fp", "component_id", "links")


def one_per_group(docs: DataFrame, words: int = 3, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``doc_id`` is the least of its component.

    Rows that repeat an id and a text are one document and stay together; rows without an id stay only where their
    whole component has none.
    """
    return least_rows(docs, _classes(docs, words, budget, group))


def least_rows(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the ``component_id`` that ``classes(doc_id, text_hash, component_id)`` gives them."""
    keep = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = durable(keep.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_id"]) & (F.xxhash64(docs["text"]) == keep["_hash"]), "left_semi")


def hex_fingerprint(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
