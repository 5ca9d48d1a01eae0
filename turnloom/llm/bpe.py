"""Byte-level BPE with the tiktoken library and a local rank file.

The rank file is read once by the driver and broadcast (its size is that of the vocabulary, about a megabyte); every
Python worker builds its encoder once. Long texts are cut at safe boundaries first, so memory follows the piece, not
the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Texts above so many characters are cut; the cuts never change the ids.
PIECE = 1 << 16
# A lone space between two visible characters always starts a match of the split pattern: no match can hold a
# space behind a visible character, and none looks behind.
SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary at or after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def chunks(batch: pd.Series, rows: int = 256) -> Iterator[pd.Series]:
    """A batch in parts: ids are returned before the next part is begun."""
    for start in range(0, len(batch), rows):
        yield batch.iloc[start : start + rows]


@cache
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(text: Column, spark: SparkSession, path: str, pattern: str) -> Column:
    """Token ids of a text column; a null text counts as empty."""
    held = spark.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(held.value, pattern)
        for batch in batches:
            for few in chunks(batch):
                yield pd.Series([[i for piece in pieces(t or "") for i in enc.encode_ordinary(piece)] for t in few])

    return ids(text)


def decode(ids: Column, spark: SparkSession, path: str, pattern: str) -> Column:
    """The raw bytes of a token column: they need not be whole characters. Null ids give null bytes."""
    held = spark.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(held.value, pattern)
        for batch in batches:
            for few in chunks(batch):
                yield pd.Series([None if row is None else enc.decode_bytes(row) for row in few], dtype=object)

    return raw(ids)


def round_trip(text: Column, spark: SparkSession, path: str, pattern: str, keep_ids: bool = False) -> Column:
    """Encode and decode in one pass: ``n_tokens, ids_sha256, decoded_sha256``, with ``keep_ids`` also ``token_ids``.

    The ids are digested in decimal joined by commas, the decoded bytes as they are. A null text counts as empty: no
    tokens and the digest of nothing.
    """
    held = spark.sparkContext.broadcast(read_ranks(path))
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * keep_ids

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(held.value, pattern)
        for text_batch in (few for batch in batches for few in chunks(batch)):
            rows = []
            for text in text_batch:
                n, kept, of_ids, of_bytes = 0, [], hashlib.sha256(), hashlib.sha256()
                for piece in pieces(text or ""):
                    ids = enc.encode_ordinary(piece)
                    if ids:
                        of_ids.update((("," if n else "") + ",".join(map(str, ids))).encode())
                        of_bytes.update(enc.decode_bytes(ids))
                        n += len(ids)
                        if keep_ids:
                            kept.append(np.array(ids, dtype=np.int32))
                row = (n, of_ids.hexdigest(), of_bytes.hexdigest())
                rows.append((*row, np.concatenate(kept) if kept else np.empty(0, np.int32)) if keep_ids else row)
            yield pd.DataFrame(rows, columns=columns)

    return digests(text)
