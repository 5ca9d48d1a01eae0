"""Seeded, reproducible pseudo-random numbers derived from row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: object, *keys: Column) -> Column:
    """Hex digest of ``seed|key|...``: one fixed order per seed, whatever the partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_number(seed: object, *keys: Column) -> Column:
    """60-bit integer from the digest; orders rows like the digest itself."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 15), 16, 10).cast("bigint")


def hash_fraction(seed: object, *keys: Column) -> Column:
    """Uniform number in [0, 1)."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def hash_index(seed: object, size: Column, *keys: Column) -> Column:
    """Uniform index below ``size``."""
    return F.pmod(hash_number(seed, *keys), size.cast("bigint"))
