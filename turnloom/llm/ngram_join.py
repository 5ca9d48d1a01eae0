"""Self-join of documents by the Jaccard similarity of their word n-grams, exact.

Candidates come from prefixes: with all shingles in one global order, rarest first, two sets alike enough share one of
the first ``n - ceil(0.8 n) + 1`` of each. How many sets hold a shingle is counted in ranges of hashes, where shingles
travel packed, and only shingles of several sets come back; a set with enough shingles of its own meets nobody, whatever
it shares with a template. Sets are compared inside size bands, a set also in the band below if partners can be there.

What meets is compared in tiles. Each set has a bitmap of hashed shingles whose width follows its band; bits of one
bitmap that the other lacks bound the overlap from above, and what passes is intersected exactly as sorted arrays. A
first round checks every set against one leader per shared shingle, so a large group of copies costs a few checks per
member. Sets that meet and are not yet in one component form clusters; a cluster is cut in blocks of bounded size and
tiles of two blocks return no pairs but links that unite components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.unions import united
from turnloom.session import durable

WORDS = 5
#: Shared shingles, of all shingles of a pair, so many of each so many.
ALIKE, OF = 4, 5
#: Bytes of text for one range of shingle hashes, shingles sent at once, and shingles in a block of a tile.
RANGE_BYTES = 1 << 24
SENT = 1 << 20
CELLS = 1 << 17
#: Bits of a bitmap per shingle, at least.
BITS = 4
#: Bits of the bitmap by which texts are found again: four megabytes.
FILTER = 1 << 25

_FACTORS = np.random.default_rng(11).integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the different word shingles, ascending; A-Z are lower-cased, few words are one shingle, no words none."""
    tokens = (text or "").encode("utf-8").lower().split()  # on bytes both know ASCII only
    if not tokens:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    total = np.full(len(tokens) - size + 1, size, np.uint64)
    for i in range(size):
        total += each[i : len(tokens) - size + 1 + i] * _FACTORS[i]
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(32)))


def least_shared(size: int) -> int:
    """Shingles of a set of ``size`` that a partner holds at least."""
    return -(-ALIKE * size // OF)


def band(size: int) -> int:
    return size.bit_length() - 1


def width(level: int) -> int:
    """Bits of the bitmaps of a band."""
    return max(64, BITS << (level + 1))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The set's bitmap as words of 64 bits."""
    bits = width(band(len(hashes)))
    out = np.zeros(bits, bool)
    out[hashes & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A wider bitmap in ``words`` words: what the set's bitmap of that width would be."""
    return bits if len(bits) <= words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def most_shared(left: np.ndarray, sizes: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Upper bounds of the overlap of each bitmap of ``left`` with ``bits``: each bit that one lacks is a shingle that it lacks."""
    missing = np.bitwise_count(left & ~bits).sum(axis=1, dtype=np.int64)
    lacking = np.bitwise_count(bits & ~left).sum(axis=1, dtype=np.int64)
    return np.minimum(sizes - missing, size - lacking)


def alike(shared, a, b):
    """Whether a pair with so many shared shingles is a link; sizes as numbers or arrays."""
    return (OF + ALIKE) * shared >= ALIKE * (a + b)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(x) else 0


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text_hash, node, size`` for every row: ``node`` is a digest of the set, 16 bytes; equal sets are one node."""

    @F.pandas_udf("node binary, size int")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                own = shingles(text, words)
                rows.append((xxhash.xxh3_128_digest(own.tobytes()), len(own)))
            yield pd.DataFrame(rows, columns=["node", "size"])

    rows = _keyed(docs).select("doc_id", "text_hash", digest("text").alias("s"))
    return rows.select("doc_id", "text_hash", "s.node", "s.size")


def _short(node: bytes) -> int:
    """The number under which a set is sent; sets that share one are only compared needlessly."""
    return int.from_bytes(node[:8], "little")


def _postings(docs: DataFrame, ranges: int, words: int) -> DataFrame:
    """``part, slots, at, nodes, sizes``: shingles by range of their hashes, packed.

    ``slots`` are places inside the range, ascending, ``at`` says which of ``nodes`` holds each. Equal sets of a batch
    are sent once.
    """
    names = ["part", "slots", "at", "nodes", "sizes"]

    def packed(held: dict[int, np.ndarray]) -> pd.DataFrame:
        nodes = np.fromiter(held, np.uint64, len(held))
        sizes = np.array([len(s) for s in held.values()], np.uint32)
        hashes, owner = np.concatenate(list(held.values())), np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        part, slot = place(hashes, ranges)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows = []
        for s, e in zip(starts, np.append(starts[1:], len(part)), strict=True):
            few, at = np.unique(owner[s:e], return_inverse=True)
            rows.append((int(part[s]), slot[s:e].tobytes(), packed_places(at, len(few)), nodes[few].tobytes(), sizes[few].tobytes()))
        return pd.DataFrame(rows, columns=names)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        count = 0
        for batch in batches:
            for text in batch["text"]:
                own = shingles(text, words)
                node = _short(xxhash.xxh3_128_digest(own.tobytes()))
                if len(own) and node not in held:
                    held[node] = own
                    count += len(own)
                if count >= SENT:
                    yield packed(held)
                    held, count = {}, 0
        if held:
            yield packed(held)

    kinds = "part int, slots binary, at binary, nodes binary, sizes binary"
    return docs.select("text").where("text is not null").mapInPandas(cut, kinds)


def packed_places(at: np.ndarray, of: int) -> bytes:
    """Places in a list of ``of`` entries, two bytes each if they fit."""
    return at.astype(np.uint16 if of <= 1 << 16 else np.uint32).tobytes()


def places(packed: bytes, of: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint16 if of <= 1 << 16 else np.uint32)


def place(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range and 32-bit place inside it for ascending hashes; order is kept."""
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    scaled = high * np.uint64(ranges) + ((low * np.uint64(ranges)) >> np.uint64(32))
    return (scaled >> np.uint64(32)).astype(np.int64), (scaled & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _recurring(postings: DataFrame, ranges: int) -> DataFrame:
    """``bucket, at, nodes, sizes, keys, counts``: shingles that several sets hold, packed by bucket of sets.

    A task holds one range at a time: about as many shingles as ``RANGE_BYTES`` of text have, and of a shingle that
    very many sets hold what remains after each sender has folded its copies.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, rows in _groups(batches, ["part"]):
            slots = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["slots"]])
            nodes, sizes = [], []
            for at, n, s in zip(rows["at"], rows["nodes"], rows["sizes"], strict=True):
                pick = places(at, len(n) // 8)
                nodes.append(np.frombuffer(n, np.uint64)[pick])
                sizes.append(np.frombuffer(s, np.uint32)[pick])
            nodes, sizes = np.concatenate(nodes), np.concatenate(sizes)
            order = np.lexsort((nodes, slots))
            slots, nodes, sizes = slots[order], nodes[order], sizes[order]
            first = np.r_[True, (slots[1:] != slots[:-1]) | (nodes[1:] != nodes[:-1])]
            slots, nodes, sizes = slots[first], nodes[first], sizes[first]
            starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
            each = np.diff(np.append(starts, len(slots)))
            counts = np.repeat(each, each)
            several = counts > 1
            slots, nodes, sizes, counts = slots[several], nodes[several], sizes[several], counts[several]
            keys = np.uint64(part[0]) << np.uint64(32) | slots
            bucket, _ = place(nodes, ranges)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(ranges + 1))
            out = []
            for b in range(ranges):
                own = order[ends[b] : ends[b + 1]]
                if len(own):
                    few, first, at = np.unique(nodes[own], return_index=True, return_inverse=True)
                    # beyond two bytes counts say "many": all of these come last
                    many = np.minimum(counts[own], (1 << 16) - 1).astype(np.uint16)
                    out.append((b, packed_places(at, len(few)), few.tobytes(), sizes[own][first].tobytes(), keys[own].tobytes(), many.tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "at", "nodes", "sizes", "keys", "counts"])

    sorted_parts = postings.repartition("part").sortWithinPartitions("part")
    return sorted_parts.mapInPandas(count, "bucket int, at binary, nodes binary, sizes binary, keys binary, counts binary")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of equal keys, which stand together, whole: a group may go on in the next batch."""
    held: list[pd.DataFrame] = []
    name: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        new = batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy()
        new[0] = True
        starts = np.flatnonzero(new)
        for s, e in zip(starts, np.append(starts[1:], len(batch)), strict=True):
            here = tuple(batch[keys].iloc[s])
            if name is not None and here != name:
                yield name, pd.concat(held, ignore_index=True)
                held = []
            name = here
            held.append(batch.iloc[s:e])
    if name is not None:
        yield name, pd.concat(held, ignore_index=True)


def prefixes(docs: DataFrame, ranges: int, words: int = WORDS) -> DataFrame:
    """``short, size, keys``: the sets that can have a partner, each with the shingles of its prefix that others hold too.

    The order is that of ``(number of sets, hash)``; shingles of one set only come first and are left out.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _groups(batches, ["bucket"]):
            pick = [places(at, len(n) // 8) for at, n in zip(rows["at"], rows["nodes"], strict=True)]
            each = lambda c, kind: np.concatenate([np.frombuffer(b, kind)[at] for b, at in zip(rows[c], pick, strict=True)])
            whole = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in rows[c]])
            nodes, sizes = each("nodes", np.uint64), each("sizes", np.uint32)
            keys, counts = whole("keys", np.uint64), whole("counts", np.uint16)
            order = np.lexsort((keys, counts, nodes))
            nodes, sizes, keys = nodes[order], sizes[order], keys[order]
            starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else np.empty(0, np.int64)
            out = []
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(nodes)).tolist(), strict=True):
                size = int(sizes[s])
                if e - s >= least_shared(size):  # the rest of the set, which nobody else holds, stands before these
                    long = size - least_shared(size) + 1 - (size - (e - s))
                    out.append((nodes[s : s + 1].view(np.int64)[0], size, np.unique(_signed(keys[s : s + long]))))
            yield pd.DataFrame(out, columns=["short", "size", "keys"])

    packed = _recurring(_postings(docs, ranges, words), ranges)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(pick, "short long, size int, keys array<long>")


def members(found: DataFrame) -> DataFrame:
    """``band, key, short, size``: sets under the keys that they share with another set of the band.

    A set is in its own band, and in the band below if a partner can be there.
    """
    own = F.length(F.bin("size")) - 1
    below = F.expr("shiftleft(1, length(bin(size)) - 1) - 1")
    lower = F.when(ALIKE * F.col("size") <= OF * below, F.array(own, own - 1)).otherwise(F.array(own))
    each = durable(found.select(F.explode(lower).alias("band"), "short", "size", "keys").select("band", F.explode("keys").alias("key"), "short", "size"))
    shared = each.groupBy("band", "key").agg(F.min("short").alias("a"), F.max("short").alias("b")).where("a < b").select("band", "key")
    return durable(each.join(durable(shared), ["band", "key"]))


def marks(hashes: DataFrame, bits: int = FILTER) -> np.ndarray:
    """Bitmap of ``bits`` places with the places of all hashes of the column ``h`` set: of this size for any table."""
    place = F.pmod(F.col("h"), F.lit(bits))
    words = hashes.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy()
    return out.view(np.uint64)


def contents(docs: DataFrame, rows: DataFrame, wanted: DataFrame, words: int = WORDS, sign: Callable[[np.ndarray], np.ndarray] = bitmap) -> DataFrame:
    """``node, short, size, bits, content`` for the sets numbered in ``wanted``: signature and sorted shingles.

    One row of each set is cut again where it is read: a bitmap of bounded size tells which rows these are. The few
    others that it lets through come too and meet nobody. A node comes once.
    """

    @F.pandas_udf("long")
    def short(nodes: pd.Series) -> pd.Series:
        return pd.Series(np.array([_short(n) for n in nodes], np.uint64).view(np.int64))

    one = rows.where("size > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    one = one.withColumn("short", short("node")).join(wanted.select("short").distinct(), "short", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(marks(one.select(F.xxhash64("one.doc_id", "one.text_hash").alias("h"))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["h"].to_numpy() % FILTER
            known = (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch[known == 1]
            for start in range(0, len(batch), 256):
                own = [s for s in (shingles(t, words) for t in batch["text"].iloc[start : start + 256]) if len(s)]
                node = [xxhash.xxh3_128_digest(s.tobytes()) for s in own]
                yield pd.DataFrame({
                    "node": node, "short": np.array([_short(n) for n in node], np.uint64).view(np.int64), "size": [len(s) for s in own],
                    "bits": [sign(s).tobytes() for s in own], "content": [_signed(s) for s in own],
                })

    texts = docs.where("text is not null").select(F.xxhash64("doc_id", F.xxhash64("text")).alias("h"), "text")
    kinds = "node binary, short long, size int, bits binary, content array<long>"
    return durable(texts.mapInPandas(cut, kinds).dropDuplicates(["node"]))


Near = Callable[[int, np.ndarray, int, np.ndarray], bool]


def led(meeting: DataFrame, held: DataFrame, near: Near | None = None) -> DataFrame:
    """``a, b``: links of sets with the leader of a key that they share; a leader is the least number of its key.

    ``near`` tells by sizes and signatures whether a pair is to be intersected; by default bitmaps bound the overlap.
    """
    near = near or bounded
    leaders = durable(meeting.groupBy("band", "key").agg(F.min(F.struct("short", "size")).alias("l")).select("band", "key", "l.short", "l.size"))
    pairs = meeting.join(leaders.withColumnsRenamed({"short": "other", "size": "other_size"}), ["band", "key"])
    sized = OF * F.least("size", "other_size").cast("long") >= ALIKE * F.greatest("size", "other_size").cast("long")
    pairs = durable(pairs.where((F.col("short") != F.col("other")) & sized).select("short", "other").distinct())
    left = held.select("short", F.col("node").alias("a"), F.col("size").alias("n"), F.col("bits").alias("p"), F.col("content").alias("x"))
    right = held.select(F.col("short").alias("other"), F.col("node").alias("b"), F.col("size").alias("m"), F.col("bits").alias("q"), F.col("content").alias("y"))

    @F.pandas_udf("boolean")
    def linked(n: pd.Series, p: pd.Series, x: pd.Series, m: pd.Series, q: pd.Series, y: pd.Series) -> pd.Series:
        found = []
        for n_, p_, x_, m_, q_, y_ in zip(n, p, x, m, q, y, strict=True):
            meets = near(n_, np.frombuffer(p_, np.uint64), m_, np.frombuffer(q_, np.uint64))
            # ascending as unsigned numbers
            found.append(bool(meets and alike(overlap(x_.view(np.uint64), y_.view(np.uint64)), n_, m_)))
        return pd.Series(found, dtype=bool)

    both = pairs.join(left, "short").join(right, "other")
    return durable(both.where(linked("n", "p", "x", "m", "q", "y")).select("a", "b"))


def bounded(n: int, p: np.ndarray, m: int, q: np.ndarray) -> bool:
    """Whether bitmaps leave room for a link."""
    words = min(len(p), len(q))
    return bool(alike(most_shared(folded(p, words)[None], np.array([n]), folded(q, words), m)[0], n, m))


def compare(label: list, side: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], content: list[np.ndarray], inner: bool) -> list[tuple[int, int]]:
    """Links inside a tile that unite sets of different labels: all pairs if ``inner``, else pairs of both sides."""
    words = min(map(len, bits))
    table = np.stack([folded(b, words) for b in bits])
    root = np.unique(np.array(label, object), return_inverse=True)[1]
    links = []
    for i in range(len(sizes)):
        other = root != root[i]
        other[: i + 1] = False
        if not inner:
            other &= side != side[i]
        low, high = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        at = np.flatnonzero(other & (OF * low >= ALIKE * high))
        if not len(at):
            continue
        bound = most_shared(table[at], sizes[at], table[i], int(sizes[i]))
        for j in at[alike(bound, sizes[at], sizes[i])].tolist():
            if root[j] != root[i] and alike(overlap(content[i], content[j]), sizes[i], sizes[j]):
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


Find = Callable[[list, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], bool], list[tuple[int, int]]]


def tiled(meeting: DataFrame, held: DataFrame, labels: DataFrame, cells: int = CELLS, find: Find = compare) -> DataFrame:
    """``a, b``: links between components that still meet under a key, one per union and tile; ``find`` works on a tile.

    The sets and keys of a band in which several components meet form clusters. Inside a cluster the largest component
    is the main side and all others are the rest; each is cut in blocks of about ``cells`` shingles, and tiles are two
    blocks of the rest or one of each side, never two of the main side.
    """
    named = meeting.join(held.select("short", "node"), "short").join(labels, "node", "left")
    named = durable(named.select("band", "key", "node", "size", F.coalesce("component", "node").alias("label")))
    mixed = named.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band", "key", "x")
    open_ = durable(named.join(mixed, ["band", "key"]))
    # components that meet: one edge for each two, not for each set and key
    met = open_.where("label <> x").select("band", "label", "x").distinct()
    edges = met.select(F.xxhash64("band", "label").alias("a"), F.xxhash64("band", "x").alias("b"))
    parts = durable(united(edges))
    nodes = open_.select("band", "node", "size", "label").distinct().withColumn("a", F.xxhash64("band", "label"))
    nodes = nodes.join(parts.withColumnRenamed("node", "a"), "a", "left")
    nodes = durable(nodes.select("band", "node", "size", "label", F.coalesce("component", "a").alias("cluster")))
    sums = nodes.groupBy("cluster", "label").agg(F.sum("size").alias("n"))
    sums = sums.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("n"))
    blocks = [F.greatest(F.ceil(c / cells), F.lit(1)).cast("int") for c in (F.col("main_n"), F.col("n") - F.col("main_n"))]
    sums = durable(sums.select("cluster", "main", blocks[0].alias("mains"), blocks[1].alias("rests")))
    spread = nodes.join(sums, "cluster").withColumn("side", (F.col("label") == F.col("main")).cast("int"))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("side") == 1, F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("rests") - 1))
    spread = spread.select("*", other.alias("j"))
    # a block of the rest also meets every block of the main side, once for each
    against = F.when(F.col("j") == 0, F.sequence(F.lit(0), F.col("mains") - 1))
    tile = F.struct(F.lit(1).alias("kind"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("at"))
    main_tile = F.array(F.struct(F.lit(1).alias("kind"), F.col("own").alias("x"), F.col("j").alias("y"), F.lit(1).alias("at")))
    rest_tile = F.array(F.struct(
        F.lit(0).alias("kind"), F.least("own", "j").alias("x"), F.greatest("own", "j").alias("y"), (F.col("own") > F.col("j")).cast("int").alias("at")
    ))
    rest_main = F.transform(F.coalesce(against, F.array().cast("array<int>")), lambda m: tile.withField("x", m).withField("y", F.col("own")))
    tiles = F.when(F.col("side") == 1, main_tile).otherwise(F.concat(rest_tile, rest_main))
    placed = spread.select("band", "cluster", "node", "label", F.explode(tiles).alias("t"))
    placed = placed.select("band", "cluster", "t.kind", "t.x", "t.y", "t.at", "node", "label")
    full = placed.join(held.select("node", "size", "bits", "content"), "node")
    keys = ["band", "cluster", "kind", "x", "y"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, _, kind, x, y), rows in _groups(batches, keys):
            if len(rows) < 2:
                continue
            bits = [np.frombuffer(b, np.uint64) for b in rows["bits"]]
            content = [c.view(np.uint64) for c in rows["content"]]
            found = find(rows["label"].to_list(), rows["at"].to_numpy(), rows["size"].to_numpy(np.int64), bits, content, kind == 0 and x == y)
            node = rows["node"].to_list()
            yield pd.DataFrame([(node[i], node[j]) for i, j in found], columns=["a", "b"])

    return durable(full.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(scan, "a binary, b binary"))


def nodes_with_labels(docs: DataFrame, words: int, cells: int, range_bytes: int, sign=bitmap, near: Near | None = None, find: Find = compare) -> tuple[DataFrame, DataFrame]:
    """The sets of ``docs`` by row, and ``node, component`` for linked nodes that are not the least of their component."""
    rows = durable(sets(docs, words))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = durable(prefixes(docs, max(1, -(-size // range_bytes)), words))
    meeting = members(found)
    held = contents(docs, rows, meeting, words, sign)
    links = led(meeting, held, near)
    labels = durable(united(links))
    more = tiled(meeting, held, labels, cells, find)
    if not more.isEmpty():
        labels = durable(united(links.unionByName(more)))
    return rows, labels


def named_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text_hash, size, component_id`` for every row of ``sets``; rows with an empty set are one node here."""
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = durable(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("label")))
    least = durable(nodes.groupBy("label").agg(F.min("least").alias("component_id")))
    named = durable(nodes.join(least, "label").select("node", "component_id"))
    return rows.join(named, "node").select("doc_id", "text_hash", "size", "component_id")


def linked_documents(docs: DataFrame, words: int = WORDS, cells: int = CELLS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` reachable by links, the row's own included; null only where no row reached
    has an id. Sets of equal shingles are one node. A null text or one without words has an empty set, is linked with
    nothing and is its own component. Repeated rows come back repeated; no rows, no result.
    """
    named = named_rows(*nodes_with_labels(docs, words, cells, range_bytes))
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))
