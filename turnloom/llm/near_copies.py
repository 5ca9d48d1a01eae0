"""Near copies by SimHash: the trie self-join of all fingerprints, and wider pairs that an exact check confirms.

All texts go through the trie self-join of ``simhash`` over five-word shingles, which links fingerprints within two
bits. Pairs with a Jaccard similarity of 0.8 differ in about ten bits, which is far too many for the blocks of bits by
which ``simhash`` brings fingerprints together: blocks of five bits are everything with everything. So sets also meet if
they share one of their rarest shingles, which every pair of that similarity does (see ``ngram_join``). Among sets that
meet, the binary trie of their fingerprints is walked in node pairs with a wide error budget, and what is left is
intersected exactly. Links of both kinds make the components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import ngram_join
from turnloom.llm.ngram_join import alike, overlap
from turnloom.llm.simhash import labelled, least_rows, walk
from turnloom.llm.unions import united
from turnloom.session import durable

WORDS = 5
#: Bits in which linked pairs may differ: at a similarity of 0.8 ten on average with a deviation of three.
BUDGET = 24
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes, one number: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[start : start + CHUNK], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def within(n: int, p: np.ndarray, m: int, q: np.ndarray) -> bool:
    return int(np.bitwise_count(p[0] ^ q[0])) <= BUDGET


def trie_links(
    label: list, side: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], content: list[np.ndarray], inner: bool
) -> list[tuple[int, int]]:
    """Links inside a tile that unite sets of different labels: all pairs if ``inner``, else pairs of both sides."""
    prints, at = np.unique(np.concatenate(bits), return_inverse=True)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(len(prints) + 1))
    with_print = [order[ends[i] : ends[i + 1]] for i in range(len(prints))]
    root = np.unique(np.array(label, object), return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def check(i: int, others: np.ndarray) -> None:
        others = others[(others != i) & (root[others] != root[i])]
        if not inner:
            others = others[side[others] != side[i]]
        for j in others.tolist():
            if root[j] != root[i] and alike(overlap(content[i], content[j]), sizes[i], sizes[j]):
                links.append((min(i, j), max(i, j)))
                root[root == root[j]] = root[i]

    for own in with_print:  # different sets of one fingerprint
        for i in own.tolist() if len(own) > 1 else ():
            check(i, own)
    several = np.array([len(own) > 1 for own in with_print])
    lead = np.array([own[0] for own in with_print])
    for left, right in walk(prints, np.zeros(1, np.int64), BUDGET):
        apart = several[left] | several[right] | (root[lead[left]] != root[lead[right]])
        left, right = left[apart], right[apart]
        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            for i in with_print[x].tolist():
                check(i, with_print[y])
    return links


def print_links(docs: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b``: nodes that the trie self-join of all fingerprints links and ``labels`` does not, each with the least of them."""
    prints, named = labelled(docs, WORDS)
    label = prints.join(named.select("fp", "label"), "fp").select("text_hash", "label").distinct()
    texts = rows.select("text_hash", "node").distinct().join(labels, "node", "left")
    met = durable(texts.select("text_hash", F.coalesce("component", "node").alias("a")).join(label, "text_hash").select("label", "a").distinct())
    least = met.groupBy("label").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return durable(met.join(least, "label").where("a <> b").select("a", "b"))


def classes(docs: DataFrame, cells: int = ngram_join.CELLS, range_bytes: int = ngram_join.RANGE_BYTES) -> DataFrame:
    """``doc_id, text_hash, component_id`` for every row; null and wordless texts are one class, no rows give none."""
    rows, labels = ngram_join.nodes_with_labels(docs, WORDS, cells, range_bytes, fingerprint, within, trie_links)
    more = print_links(docs, rows, labels)
    if not more.isEmpty():
        labels = durable(united(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    return ngram_join.named_rows(rows, labels).select("doc_id", "text_hash", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``doc_id`` is the least of its component; rows as in ``simhash``."""
    return least_rows(docs, classes(docs))
