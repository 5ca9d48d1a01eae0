"""Document-level alignment of a claim with a premise from sentence-level scores.

A pair of texts has a grid: parts of the premise against sentences of the claim. The built-in scorer evaluates it
inside the row. A plugged-in scorer gets one row per cell, so its batches are full whatever the size of the texts and
cross items; a cell that cannot be scored keeps its error and leaves the other cells alone. Cells are folded back to
their item by maxima and means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.operators.budget import sentence_chunks
from turnloom.operators.lexical import mean_of
from turnloom.operators.stages import BATCH, Client, batch_stage, containment, named_heads, token_set
from turnloom.session import durable

HEADS = ("reg", "bin", "nli")


def _token_sets(parts: Column) -> Column:
    return F.transform(parts, token_set)


def cell_scores(
    grids: DataFrame, make_client: Callable[[], Client], head: str = "bin", batch: int = BATCH, keys: tuple[str, ...] = ("cell",)
) -> DataFrame:
    """``keys..., i, j, score, error`` for every cell of ``grids(keys..., _p, _c)``: part ``i`` of ``_p`` against ``j`` of ``_c``.

    Cells are dealt over the tasks anew, so that one item with long texts is scored by many. A cell has a score or an
    error, never both.
    """
    if head not in HEADS:
        raise ValueError(f"unknown head {head!r}, not one of {HEADS}")
    cells = grids.select(*keys, "_c", F.posexplode("_p").alias("i", "premise")).select(
        *keys, "i", "premise", F.posexplode("_c").alias("j", "hypothesis")
    )
    # written first: a model stage takes stored columns, and a rerun does not split texts again
    cells = durable(cells.repartition(*keys, "i", "j"))
    both = F.to_json(F.struct("premise", "hypothesis"))
    scored = batch_stage(cells, lambda: named_heads(make_client()), both, "_heads", "string", batch)
    heads = F.from_json("_heads", "reg double, bin double, tri array<double>")
    value = F.get(heads["tri"], F.lit(0)) if head == "nli" else heads[head]
    return durable(scored.select(*keys, "i", "j", value.alias("score"), F.col("_heads_error").alias("error")))


def _grids(pairs: DataFrame, premise: Column, claim: Column) -> DataFrame:
    """The pairs with the parts to compare and a number for each row; written, so the number stays the same."""
    return durable(pairs.withColumns({"_p": premise, "_c": claim, "cell": F.monotonically_increasing_id()}))


def _best(cells: DataFrame, per: str) -> DataFrame:
    """``cell, mean, error``: the mean over parts ``per`` of the best score of each.

    A part of which no cell was scored does not count; where no part was, the mean is null. ``error`` is that of the
    first failed cell.
    """
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("i", "j")))
    each = cells.groupBy("cell", per).agg(F.max("score").alias("best"))
    errors = cells.where("error is not null").groupBy("cell").agg(first.alias("error"), F.count("*").alias("n_failed"))
    return each.groupBy("cell").agg(F.avg("best").alias("mean")).join(errors, "cell", "left")


def alignment_score(
    pairs: DataFrame,
    item: str = "item_id",
    premise: str = "premise",
    claim: str = "hypothesis",
    make_client: Callable[[], Client] | None = None,
    head: str = "bin",
    output: str = "alignment",
    batch: int = BATCH,
) -> DataFrame:
    """Mean over claim sentences of the best score over premise chunks; 0 for an empty claim or premise.

    With a client there are also ``<output>_error``, the error of the first failed cell or null, and ``n_failed``, the
    number of failed cells. The score is then that of the other cells, and null only where none was scored.
    """
    chunks, sents = sentence_chunks(F.col(premise)), tx.sentences(F.col(claim))
    if make_client is None:
        grid = pairs.withColumn("_p", _token_sets(chunks)).withColumn("_c", _token_sets(sents))
        best = lambda c: F.array_max(F.transform(F.col("_p"), lambda p: containment(p, c)))
        return grid.withColumn(output, mean_of(F.transform(F.col("_c"), best))).drop("_p", "_c")
    grid = _grids(pairs, chunks, sents)
    found = _best(cell_scores(grid, make_client, head, batch), "j").withColumnRenamed("error", f"{output}_error")
    joined = grid.drop("_p", "_c").join(found.withColumn("_known", F.lit(True)), "cell", "left")
    value = F.when(F.col("_known"), F.col("mean")).otherwise(F.lit(0.0))
    return joined.select(*pairs.columns, value.alias(output), f"{output}_error", F.coalesce("n_failed", F.lit(0)).alias("n_failed"))


def smart_n(
    pairs: DataFrame,
    item: str = "item_id",
    premise: str = "premise",
    claim: str = "hypothesis",
    make_client: Callable[[], Client] | None = None,
    head: str = "bin",
    batch: int = BATCH,
) -> DataFrame:
    """Sentence-unit precision, recall and F: best match per sentence, averaged, in both directions.

    A client scores every cell once in each direction; then there are also ``error`` and ``n_failed``.
    """
    p, r = F.col("precision"), F.col("recall")
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f")
    sides = tx.sentences(F.col(premise)), tx.sentences(F.col(claim))
    if make_client is None:
        grid = pairs.select(item, _token_sets(sides[0]).alias("_p"), _token_sets(sides[1]).alias("_c"))
        best = lambda others: lambda s: F.coalesce(
            F.array_max(F.transform(F.col(others), lambda o: containment(o, s))), F.lit(0.0)
        )
        scored = grid.select(
            item,
            mean_of(F.transform(F.col("_c"), best("_p"))).alias("precision"),
            mean_of(F.transform(F.col("_p"), best("_c"))).alias("recall"),
        )
        return scored.select("*", f)
    grid = _grids(pairs, *sides)
    found = _best(cell_scores(grid, make_client, head, batch), "j")
    turned = grid.select("cell", F.col("_c").alias("_p"), F.col("_p").alias("_c"))
    back = _best(cell_scores(turned, make_client, head, batch), "j")
    back = back.select("cell", F.col("mean").alias("_back"), F.col("error").alias("_error"), F.col("n_failed").alias("_failed"))
    joined = grid.select("cell", item, (F.size("_p") * F.size("_c") > 0).alias("_known")).join(found, "cell", "left").join(back, "cell", "left")
    value = lambda c: F.when(F.col("_known"), F.col(c)).otherwise(F.lit(0.0))
    failed = F.coalesce("n_failed", F.lit(0)) + F.coalesce("_failed", F.lit(0))
    scored = joined.select(item, value("mean").alias("precision"), value("_back").alias("recall"), F.coalesce("error", "_error").alias("error"), failed.alias("n_failed"))
    return scored.select(item, "precision", "recall", f, "error", "n_failed")


def _soft_length(rows: Column, width: Column) -> Column:
    """Last cell of the soft longest common subsequence over a grid of scores: an array of rows of ``width`` cells."""

    def next_row(prev: Column, scores: Column) -> Column:
        def cell(acc: Column, s: Column) -> Column:
            # the last two cells above and the one to the left are all that a cell needs
            above = F.get(prev, acc["at"])
            value = F.greatest(acc["diag"] + s, above + s, acc["left"])
            return F.struct(F.concat(acc["row"], F.array(value)).alias("row"), above.alias("diag"), value.alias("left"), (acc["at"] + 1).alias("at"))

        start = F.struct(F.array().cast("array<double>").alias("row"), F.lit(0.0).alias("diag"), F.lit(0.0).alias("left"), F.lit(0).alias("at"))
        return F.aggregate(scores, start, cell, lambda acc: acc["row"])

    return F.aggregate(rows, F.array_repeat(F.lit(0.0), width), next_row, lambda row: F.coalesce(F.get(row, width - 1), F.lit(0.0)))


def smart_l(
    pairs: DataFrame,
    item: str = "item_id",
    premise: str = "premise",
    claim: str = "hypothesis",
    make_client: Callable[[], Client] | None = None,
    head: str = "bin",
    batch: int = BATCH,
) -> DataFrame:
    """Soft longest common subsequence over the sentence grid, divided by the number of premise sentences.

    With a client a cell that cannot be scored counts as 0, and there are also ``error`` and ``n_failed``.
    """
    sides = tx.sentences(F.col(premise)), tx.sentences(F.col(claim))
    share = lambda total: F.coalesce(F.try_divide(total, F.size("_p").cast("double")), F.lit(0.0)).alias("score")
    if make_client is None:
        grid = pairs.select(item, _token_sets(sides[0]).alias("_p"), _token_sets(sides[1]).alias("_c"))
        rows = F.transform("_p", lambda p: F.transform(F.col("_c"), lambda c: containment(p, c)))
        return grid.select(item, share(_soft_length(rows, F.size("_c"))))
    grid = _grids(pairs, *sides)
    cells = cell_scores(grid, make_client, head, batch)
    rows = cells.groupBy("cell", "i").agg(  # the cells of two texts
        F.transform(F.array_sort(F.collect_list(F.struct("j", F.coalesce("score", F.lit(0.0)).alias("s")))), lambda c: c["s"]).alias("row"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("j"))).alias("error"), F.count("error").alias("n"),
    )
    rows = rows.groupBy("cell").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda r: r["row"]).alias("rows"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("i"))).alias("error"), F.sum("n").alias("n"),
    )
    joined = grid.join(rows, "cell", "left")
    return joined.select(item, share(F.coalesce(_soft_length(F.col("rows"), F.size("_c")), F.lit(0.0))), "error", F.coalesce("n", F.lit(0)).alias("n_failed"))
