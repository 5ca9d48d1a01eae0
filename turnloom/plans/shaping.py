"""From training pairs to model samples: augmentation, choice of positives and negatives, label routing, mixing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.hashing import hash_fraction, hash_index
from turnloom.operators import sampling as sm

# fixed values: tasks by label kind
THREE_WAY = ("nli", "fact_checking")
BINARY = ("bin_nli", "paraphrase", "qa", "coreference", "ir", "summarization", "multiple_choice_qa", "extractive_qa")
REGRESSION = ("wmt", "sts", "ctc")
DRAWN = ("summarization", "multiple_choice_qa", "extractive_qa")
IGNORED = -100


def training_samples(pairs: DataFrame, seed: object = 0, key: str = "row_id") -> DataFrame:
    """One (text_a, text_b) sample with label columns per pair row; unused label heads hold -100.

    ``key`` is unique over the table. Draws are hashes of it. A drawn negative comes from the row's own wrong
    texts or, without any, from a random row of the same task.
    """
    draw = lambda name: hash_fraction(f"{seed}-{name}", F.col(key))
    task = F.col("task")
    needs_peer = task.isin(*DRAWN) & (F.size("text_c") == 0) & (draw("positive") <= 0.5)
    peers = sm.random_peer(pairs, "task", key, F.get("text_b", F.lit(0)), "_peer", needs_peer, f"{seed}-peer")

    first_b = F.get("text_b", F.lit(0))
    aligned = draw("align") > 0.95
    swapped = ~aligned & (draw("swap") > 0.95)
    swap = F.when(task.isin(*THREE_WAY), swapped & (F.col("orig_label") == 2)).when(task == "paraphrase", swapped)
    swap = F.coalesce(swap, F.lit(False))
    align = aligned & task.isin(*THREE_WAY, "paraphrase")
    positive = draw("positive") > 0.5
    any_of = lambda texts, name: F.get(texts, hash_index(f"{seed}-{name}", F.size(texts), F.col(key)).cast("int"))
    # multiple choice always takes the first right text, the other drawn tasks any of them
    right = F.when(task == "multiple_choice_qa", first_b).otherwise(any_of("text_b", "right"))
    wrong = F.when(F.size("text_c") > 0, any_of("text_c", "wrong")).otherwise(F.col("_peer"))
    first_c = F.get("text_c", F.lit(0))
    answered = F.when(first_c.isNotNull(), F.concat(first_b, F.lit(" "), first_c)).otherwise(first_b)

    text_b = (
        F.when(task.isin(*DRAWN), F.when(positive, right).otherwise(wrong))
        .when(task.isin("qa", "coreference"), answered)
        .when(task == "ir", any_of("text_b", "query"))
        .when(align | swap, F.col("text_a"))
        .otherwise(first_b)
    )
    label = F.col("orig_label")
    three = F.when(align, F.lit(0.0)).when(label == -1, F.lit(1.0)).otherwise(label)
    binary = F.when(task.isin(*DRAWN), positive.cast("double")).when(align, F.lit(1.0)).otherwise(label)
    other = F.lit(IGNORED)
    return peers.select(
        key,
        *[c for c in ("dataset",) if c in pairs.columns],
        "task",
        F.when(swap, first_b).otherwise(F.col("text_a")).alias("text_a"),
        text_b.alias("text_b"),
        F.when(task.isin(*BINARY), binary.cast("int")).otherwise(other).alias("align_label"),
        F.when(task.isin(*THREE_WAY), three.cast("int")).otherwise(other).alias("tri_label"),
        F.when(task.isin(*REGRESSION), label).otherwise(other.cast("double")).alias("reg_label"),
    )


def mixed_corpus(
    pairs: DataFrame,
    limits: Mapping[str, int | float] | None = None,
    cap: int = 500_000,
    train: float = 0.95,
    seed: int = 0,
    key: str = "row_no",
) -> DataFrame:
    """Capped mix of datasets as shaped samples with a ``split`` column.

    With ``limits`` each dataset gives its first rows (a count, or a share of its rows); otherwise each gives at
    most ``cap`` rows drawn by hash. ``key`` is a numeric row number, unique over the table.
    """
    if limits:
        mixed = sm.first_per_group(pairs, "dataset", limits, key)
    else:
        mixed = sm.cap_per_group(pairs, "dataset", cap, key, seed)
    inside = sm.train_rows(mixed, key, train, seed)
    samples = training_samples(mixed, seed, key)
    return samples.withColumn("split", F.when(inside, F.lit("train")).otherwise(F.lit("test")))
