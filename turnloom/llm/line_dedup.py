"""Recurring lines by a log-template tree of fixed depth.

A line's place in the tree is its number of words and then its leading words; digits stand for variable fields. A leaf
has one template, the word most of its lines have at each position, and a line that agrees with it in enough positions
is generalised to it; any other line is a template of its own. Templates that recur across documents are dropped from
all documents but for their first occurrence, so that a text and its copies do not vanish together.

Lines are cut and hashed where they are read; hashes of lines and leaves move, and the words of one line of each kind
that shares a leaf with another kind. No leaf, template or document is gathered; everything is counts, minima and joins
that fold before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import durable

#: Positions, of each so many, in which a line agrees with its leaf's template.
ALIKE, OF = 4, 5

#: Leading words on the way to a leaf.
DEPTH = 3
#: Lines returned at once.
ROWS = 20_000

DIGIT = re.compile(rb"[0-9]")
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
FIELD = b"<*>"
_LAST = (1 << 63) - 1


def parse(line: bytes, depth: int = DEPTH) -> tuple[list[bytes], bytes | None]:
    """Words of a line, runs without ASCII white space, and its leaf, a digest of 16 bytes.

    Words with digits become variable fields; where no word with a letter is left beside them, the line has no leaf and
    stands for itself, as does one without words.
    """
    words = line.split()
    if not words:
        return words, None
    if DIGIT.search(line) or FIELD in words:
        masked = [FIELD if DIGIT.search(w) else w for w in words]
        if not any(LETTER.search(w) for w in masked if w != FIELD):
            return words, None
        words = masked
    return words, xxhash.xxh3_128_digest(b" ".join([str(len(words)).encode(), *words[:depth]]))


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """``id, doc, pos, line, leaf`` for every line with a word; ``doc``, ``line`` and ``leaf`` are digests of 16 bytes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "doc", "pos", "line", "leaf"]
        for batch in batches:
            rows = []
            for ident, doc, text in zip(batch["id"], batch["doc"], batch["text"], strict=True):
                for pos, raw in enumerate(text.encode("utf-8").split(b"\n")):
                    words, leaf = parse(raw, depth)
                    if words:
                        rows.append((ident, doc, pos, xxhash.xxh3_128_digest(b" ".join(words)), leaf))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return _identified(docs).where("text is not null").mapInPandas(cut, "id long, doc binary, pos int, line binary, leaf binary")


def _named(ident: Column, text: Column) -> Column:
    """16 bytes that name an id and text: two hashes that do not depend on one another."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), ident, text)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), _named(F.col("doc_id"), F.col("text")).alias("doc"), "text")


def generalised(docs: DataFrame, kinds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``line, leaf`` for every kind of line that stands for its leaf's template; kinds alone in their leaf are left out.

    ``kinds`` has one row per different line: ``line, leaf, first, last``.
    """
    leaves = kinds.where("leaf is not null").groupBy("leaf")
    leaves = leaves.agg(F.count(F.lit(1)).alias("n"), F.min("first.id").alias("a"), F.max("last").alias("b"))
    leaves = durable(leaves.where("n > 1 and a < b").select("leaf"))
    wanted = kinds.join(leaves, "leaf").select("first.doc", F.struct("first.pos", "line", "leaf").alias("at"))
    wanted = wanted.groupBy("doc").agg(F.collect_list("at").alias("at"))  # at most the lines of one text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, places in zip(batch["text"], batch["at"], strict=True):
                lines = text.encode("utf-8").split(b"\n")
                rows += [(p["leaf"], p["line"], [w.decode("utf-8") for w in parse(lines[p["pos"]], depth)[0]]) for p in places]
            yield pd.DataFrame(rows, columns=["leaf", "line", "words"])

    texts = _identified(docs).join(wanted, "doc").select("text", "at")
    words = durable(texts.mapInPandas(cut, "leaf binary, line binary, words array<string>").dropDuplicates(["line"]))
    each = words.select("leaf", F.posexplode("words").alias("place", "word")).groupBy("leaf", "place", "word")
    each = each.agg(F.count(F.lit(1)).alias("n"))
    # the most frequent word of a position, of equally frequent ones the first by code point
    best = each.groupBy("leaf", "place").agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("best"))
    template = best.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", "best.word"))).alias("best"))  # one line's words
    template = durable(template.select("leaf", F.col("best.word").alias("best")))

    @F.pandas_udf("boolean")
    def agrees(own: pd.Series, best: pd.Series) -> pd.Series:
        return pd.Series([OF * sum(a == b for a, b in zip(x, y, strict=True)) >= ALIKE * len(x) for x, y in zip(own, best, strict=True)], dtype=bool)

    return durable(words.join(template, "leaf").where(agrees("words", "best")).select("line", "leaf"))


def recurring_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc, pos``: the line occurrences to drop, in narrow rows."""
    docs = docs.select("doc_id", "text")
    lines = durable(_lines(docs, depth))
    kinds = lines.groupBy("line", "leaf").agg(F.min(F.struct("id", "pos", "doc")).alias("first"), F.max("id").alias("last"))
    kinds = durable(kinds)
    general = generalised(docs, kinds, depth)
    members = durable(kinds.drop("leaf").join(general, "line"))
    templates = members.groupBy("leaf").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first.id < last")
    again = members.select("line", "leaf").join(templates.select("leaf", "first"), "leaf").select("line", "first")
    alone = kinds.where("first.id < last").join(general, "line", "left_anti").select("line", "first")
    again = durable(again.unionByName(alone))
    gone = lines.select("id", "doc", "pos", "line").join(again, "line").where(F.struct("id", "pos", "doc") != F.col("first"))
    return gone.select("doc", "pos").distinct()


def drop_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``row, text, n_lines, n_dropped`` for every row: the row of ``docs`` as it was, and its text without recurring lines.

    A line recurs if its template is in documents of different ids. Its occurrence in the least id, of those the least
    position, stays. A text of which nothing is left becomes empty; a null text stays null and has no lines. Rows
    without an id count as one document behind all others; rows that repeat an id and a text are treated alike.
    """
    drops = recurring_lines(docs, depth).groupBy("doc").agg(F.collect_list("pos").alias("places"))  # at most the lines of one text

    @F.pandas_udf("string")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places in batches:
            kept = []
            for text, gone in zip(texts, places, strict=True):
                gone = set(gone.tolist())
                kept.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone) if gone else text)
            yield pd.Series(kept, dtype=object)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), _named(F.col("doc_id"), F.col("text")).alias("doc")).join(drops, "doc", "left")
    rows = rows.withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    whole = F.coalesce("row.text", F.lit(""))
    text = F.when(F.size("places") == 0, F.col("row.text")).otherwise(rest(whole, F.col("places")))
    lines = F.coalesce(F.regexp_count("row.text", F.lit("\n")) + 1, F.lit(0))
    return rows.select("row", text.alias("text"), lines.cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_dropped"))
