"""Mix sources to target weights in fixed-length blocks.

The words of each source, its documents one after the other, are packed into blocks of equal length. A source's target
is met by slots of one block each: full passes over its blocks, then a part of one more pass. Every source's slots are
thrown over the output shards by one multinomial draw. Slot numbers go through a pseudorandom permutation of the
source's block numbers, another one for each pass, and blocks are joined to slots by number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import durable

BLOCK = 1024
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents are numbered inside slices of a source, so that no task orders a whole source.
SLICES = 4096
#: Slots that one row stands for before they are dealt out.
RUN = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources by code point, null last, take the weights in turn and share ``share`` of all sizes. A source stops at
    ``most`` times its size; the excess goes to the others by weight until none is above. With a level per unit of
    weight this is one sorted pass: sources are capped in the order of size over weight.
    """
    everything = Window.partitionBy()  # one row per source
    turn = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("rank", F.row_number().over(by_ratio))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source that its own level leaves uncapped sets the level of all behind it
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))).over(everything)
    return ranked.select("source", "source_size", F.least("cap", free["level"] * F.col("weight")).alias("target"))


def _order():
    return Window.partitionBy("source", "part").orderBy("doc_id", "size", "h")


def _numbered(rows: DataFrame, seed: int) -> DataFrame:
    """Add ``part, nth``: the same for the same row wherever it is asked; rows equal in all can change places."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SLICES)).cast("int"))
    return rows.withColumn("nth", F.row_number().over(_order()))


def placed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """``source, part, nth, doc_id, size, start``: where each document's words begin in its source; written as a table.

    ``part`` is a slice by a seeded hash of the id, ``nth`` the place in it; together with the source they name a row,
    also where ids repeat or are null.
    """
    rows = _numbered(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h")), seed)
    ahead = F.sum("size").over(_order().rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = durable(rows.withColumn("ahead", ahead).drop("h"))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    first = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), first.alias("first"))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return durable(joined.select("source", "part", "nth", "doc_id", "size", (F.col("first") + F.col("ahead")).alias("start")))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of ``range(size)`` at ``index``, another one for each key; elementwise.

    Four Feistel rounds on the least even number of bits that holds ``size``; results outside walk on until inside.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    value, size, todo = index.astype(np.uint64), size.astype(np.uint64), np.arange(len(index))
    while len(todo):
        v, h, m, k = value[todo], half[todo], low[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(4):
            mixed = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= size[todo]]
    return value.astype(np.int64)


def _seeded(*parts) -> int:
    return xxhash.xxh64_intdigest("|".join("none" if p is None else str(p) for p in parts).encode())


def slots(goals: DataFrame, shards: int = 64, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """``shard, source, slot, pass, block, words``: every slot of every source with the block it takes.

    ``words`` is how many of the block's words are taken: all of them in a full pass; in the last, partial pass the
    slot that reaches the target takes the rest, so a source's words add up to its rounded target. A source's slots
    fall on the shards by one multinomial draw seeded by its name.
    """

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, size, target in zip(batch["source"], batch["source_size"], batch["target"], strict=True):
                size, goal = int(size), round(target)
                if not size or not goal:
                    continue
                source = None if pd.isna(source) else source
                blocks = -(-size // block)
                # the partial pass may need every block, as the short one can come late
                count = goal // size * blocks + min(blocks, -(-(goal % size) // block) + 1 if goal % size else 0)
                draws = np.random.default_rng(_seeded(seed, source)).multinomial(count, [1 / shards] * shards)
                first = 0
                for shard, n in enumerate(draws.tolist()):
                    rows += [(shard, source, size, goal, at, min(RUN, first + n - at)) for at in range(first, first + n, RUN)]
                    first += n
                    if len(rows) > 10_000:
                        yield pd.DataFrame(rows, columns=["shard", "source", "size", "goal", "first", "n"])
                        rows = []
            yield pd.DataFrame(rows, columns=["shard", "source", "size", "goal", "first", "n"])

    @F.pandas_udf("pass long, block long, words long")
    def taken(source: pd.Series, size: pd.Series, goal: pd.Series, slot: pd.Series) -> pd.DataFrame:
        size, goal, slot = (s.to_numpy(np.int64) for s in (size, goal, slot))
        blocks = -(-size // block)
        turn = slot // blocks
        names = [None if pd.isna(s) else s for s in source]
        known: dict[tuple, int] = {}
        keys = []
        for name, t in zip(names, turn.tolist(), strict=True):
            if (name, t) not in known:
                known[name, t] = _seeded(seed, "pass", t, name)
            keys.append(known[name, t])
        keys = np.array(keys, dtype=np.uint64)
        at = permuted(slot % blocks, blocks, keys)
        # where the source's short last block comes in this pass: it shortens what stands behind it
        short = blocks * block - size
        length = np.where(at == blocks - 1, block - short, block)
        place = slot % blocks
        found_short = _places(blocks, keys)
        before = place * block - np.where(place > found_short, short, 0)
        rest = np.where(turn < goal // size, length, np.clip(goal % size - before, 0, length))
        return pd.DataFrame({"pass": turn, "block": at, "words": rest})

    def _places(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """By element, the place that its permutation gives to the last block: the inverse, once per pass."""
        pairs, back = np.unique(np.stack([blocks.astype(np.uint64), keys]), axis=1, return_inverse=True)
        found = [inverse(int(n) - 1, int(n), int(key)) for n, key in pairs.T]
        return np.array(found, dtype=np.int64)[back.reshape(-1)]

    dealt = goals.select("source", "source_size", "target").mapInPandas(runs, "shard int, source string, size long, goal long, first long, n long")
    dealt = dealt.repartition("source", "shard", "first")  # from here on tasks are even, whatever the sources' sizes
    each = dealt.select("shard", "source", "size", "goal", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    each = each.withColumn("t", taken("source", "size", "goal", "slot"))
    return each.select("shard", "source", "slot", "t.pass", "t.block", "t.words").where("words > 0")


def inverse(value: int, size: int, key: int) -> int:
    """The index that ``permuted`` sends to ``value``."""
    mask = (1 << 64) - 1
    bits = max(1, int(np.ceil(np.log2(max(size, 2)))))
    half = max(1, (bits + 1) // 2)
    low = (1 << half) - 1
    while True:
        left, right = value >> half, value & low
        for r in (3, 2, 1, 0):
            mixed = (left + key + r) * 0x9E3779B97F4A7C15 & mask
            mixed = (mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9 & mask
            left, right = right ^ ((mixed ^ (mixed >> 32)) & low), left
        value = (left << half) | right
        if value < size:
            return value


def mix(docs: DataFrame, shards: int = 64, block: int = BLOCK, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces of documents, and the sources' targets.

    Pieces: ``source, part, nth, doc_id, size, shard, slot, pass, from_word, to_word``, one row per document, block and
    slot, words counted from 0 with the end exclusive. A document of which nothing is taken has one row with null from
    ``shard`` on. Null text counts as empty, null is a source of its own, repeated rows are documents of their own.
    """
    at = placed(docs, seed)
    goals = durable(targets(at.groupBy("source").agg(F.sum("size").alias("source_size"))))
    last = F.expr(f"(start + size - 1) div {block}")
    spans = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), last))
    pieces = at.select("*", F.explode_outer(spans).alias("block"))
    chosen = slots(goals, shards, block, seed).select(F.col("source").alias("s"), F.col("block").alias("b"), "shard", "slot", "pass", "words")
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    joined = pieces.join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    return joined.select(
        "source", "part", "nth", "doc_id", "size", "shard", "slot", "pass",
        F.when(F.col("slot").isNotNull(), low - F.col("start")).alias("from_word"),
        F.when(F.col("slot").isNotNull(), F.greatest(low, high) - F.col("start")).alias("to_word"),
    ), goals


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, pieces`` for every row of ``docs``; see ``mix``."""
    pieces, goals = mix(docs, **options)
    sums = pieces.groupBy("source", "part", "nth", "doc_id", "size").agg(
        F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).alias("taken"), F.count("slot").alias("pieces")
    )
    goals = goals.withColumnRenamed("source", "s")  # one row per source, a stored table: small ones are broadcast by their size
    return sums.join(goals, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", "taken", "pieces")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, ranges: list[tuple[int, int]], size: int) -> str:
    """The words in ``ranges`` (ascending) as they stand in the text; parts that do not touch are joined by a space."""
    merged: list[list[int]] = []
    for low, high in ranges:
        if merged and merged[-1][1] == low:
            merged[-1][1] = high
        elif high > low:
            merged.append([low, high])
    if merged == [[0, size]]:
        return text
    words = [m.span() for m in WORD.finditer(text)]
    return " ".join(text[words[low][0] : words[high - 1][1]] for low, high in merged)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns of ``docs``: a row per document and pass with the words taken, ``n_chars`` set anew.

    A document taken twice comes twice; one of which nothing is taken, as of one without words, does not come.
    """
    seed = options.get("seed", 11)
    pieces, _ = mix(docs, **options)
    pieces = pieces.where("to_word > from_word").groupBy("source", "part", "nth", "pass")
    pieces = pieces.agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("ranges"))  # blocks of one document
    pieces = pieces.select(F.col("source").alias("s"), F.col("part").alias("p"), F.col("nth").alias("k"), "ranges")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    rows = _numbered(whole, seed).join(
        pieces, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")) & (F.col("nth") == F.col("k"))
    )

    @F.pandas_udf("string")
    def text_of(text: pd.Series, ranges: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([cut(t, [(r["from_word"], r["to_word"]) for r in rs], n) for t, rs, n in zip(text, ranges, size, strict=True)])

    rows = rows.select("row", text_of("row.text", "ranges", "size").alias("taken"))
    kept = {"text": F.col("taken"), "n_chars": F.length("taken").cast("long")}
    return rows.select(*[kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
