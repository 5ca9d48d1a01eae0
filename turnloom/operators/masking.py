"""Random token masking inside a text, reproducible from the row key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.functions.binding import let
from turnloom.functions.hashing import hash_index, hash_key

MASK = "[MASK]"


def mask_share(text: Column, key: Column, share: float = 0.25, seed: object = 0, mask: str = MASK) -> Column:
    """Replace exactly int(share * n) of the n words by the mask, chosen by hash order."""

    def cut(ws: Column) -> Column:
        digests = F.transform(ws, lambda _, i: hash_key(seed, key, i))
        n = F.floor(F.size(ws) * F.lit(share)).cast("int")
        masked = lambda d: F.when(
            n > 0,
            let(
                F.get(F.array_sort(d), n - 1),
                lambda last: F.array_join(
                    F.zip_with(ws, d, lambda w, h: F.when(h <= last, F.lit(mask)).otherwise(w)), " "
                ),
            ),
        ).otherwise(F.array_join(ws, " "))
        return let(digests, masked)

    return let(tx.words(text), cut)


def infill_next_word(original: Column, masked: Column, mask: str = MASK) -> Column:
    """Stand-in for a mask filler: each masked word becomes the text's following word."""

    def fill(ws: Column) -> Column:
        following = lambda i: F.get(ws, F.pmod(i + 1, F.size(ws)))
        return F.array_join(
            F.transform(F.split(masked, " "), lambda w, i: F.when(w == mask, following(i)).otherwise(w)), " "
        )

    return let(tx.words(original), fill)


def draw_below(share: float) -> str:
    """The least digest prefix of eight hex digits that a draw of probability ``share`` does not take."""
    return f"{min(int(share * 2**32), 2**32 - 1):08x}"


def language_model_mask(
    text: Column, key: Column, share: float = 0.15, seed: object = 0, mask: str = MASK
) -> Column:
    """Masked tokens and labels: ``share`` of the tokens are labelled; 80% of those masked, 10% swapped, 10% kept.

    A swapped token is replaced by another token of the text. Unlabelled positions hold null.
    """

    def below(part: float) -> Column:
        return F.lit(draw_below(share * part))

    def run(ws: Column) -> Column:
        other = lambda i: F.get(ws, hash_index(f"{seed}-swap", F.size(ws), key, i).cast("int"))
        token = lambda h, i: F.when(h < below(0.8), F.lit(mask)).when(h < below(0.9), other(i)).otherwise(F.get(ws, i))
        # the draw of a token is its digest's first eight hex digits, compared as text
        draws = F.transform(ws, lambda w, i: F.substring(hash_key(seed, key, i), 1, 8))
        return let(
            draws,
            lambda ds: F.struct(
                F.transform(ds, token).alias("tokens"),
                F.zip_with(ws, ds, lambda w, h: F.when(h < below(1.0), w)).alias("labels"),
            ),
        )

    return let(tx.words(text), run)
