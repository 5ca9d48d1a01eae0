"""Evaluation statistics over scored pairs ``(by..., label, pred)``; every function takes grouping columns.

All of them first shrink the pairs to counts (per confusion cell, per distinct value or per cell of two values),
so a group of any size is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.ranking import running_totals
from turnloom.session import durable

THRESHOLD_STEPS = 1000
DIGIT_BITS = 3


def _join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Combine per-group result rows; without groups both sides are single rows."""
    if by:
        return a.join(b, list(by))
    key = F.lit(1)
    return a.withColumn("_k", key).join(b.withColumn("_k", key), "_k").drop("_k")


def _num(c: Column) -> Column:
    return c.cast("double")


def class_metrics(
    pairs: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred", threshold: float | Column = 0.5
) -> DataFrame:
    """Accuracy, balanced accuracy, F1 and Matthews correlation with ``pred > threshold`` as the positive call."""
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    truth, call = F.col(label) == 1, F.col(pred) > limit
    cells = pairs.groupBy(*by).agg(
        F.count_if(truth & call).alias("tp"),
        F.count_if(~truth & call).alias("fp"),
        F.count_if(truth & ~call).alias("fn"),
        F.count_if(~truth & ~call).alias("tn"),
    )
    return cells.select(*by, *confusion_metrics())


def balanced_accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean recall over the classes that occur."""
    pos, neg = F.try_divide(_num(tp), _num(tp + fn)), F.try_divide(_num(tn), _num(tn + fp))
    return F.when(pos.isNull(), neg).when(neg.isNull(), pos).otherwise((pos + neg) / 2)


def confusion_metrics() -> list[Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    spread = F.sqrt(_num(tp + fp) * _num(tp + fn) * _num(tn + fp) * _num(tn + fn))
    return [
        F.try_divide(_num(tp + tn), _num(tp + fp + fn + tn)).alias("accuracy"),
        balanced_accuracy(tp, fp, fn, tn).alias("balanced_accuracy"),
        F.coalesce(F.try_divide(_num(2 * tp), _num(2 * tp + fp + fn)), F.lit(0.0)).alias("f1"),
        F.coalesce(F.try_divide(_num(tp) * _num(tn) - _num(fp) * _num(fn), spread), F.lit(0.0)).alias("mcc"),
    ]


def argmax(scores: Column) -> Column:
    """0-based position of the first maximum of an array."""
    return F.array_position(scores, F.array_max(scores)) - 1


def three_way_accuracy(
    pairs: DataFrame, by: Sequence[str] = (), label: str = "label", scores: str = "tri"
) -> DataFrame:
    """Accuracy of the best of three class scores; the micro-averaged F1 is the same number."""
    hit = (argmax(F.col(scores)) == F.col(label)).cast("int")
    return pairs.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.avg(hit).alias("micro_f1"))


def pearson(pairs: DataFrame, by: Sequence[str] = (), x: str = "label", y: str = "pred") -> DataFrame:
    """Pearson correlation; null for a constant column, where the built-in ``corr`` fails in ANSI mode."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = _num(F.col(x)), _num(F.col(y))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return both.groupBy(*by).agg(r.alias("pearson"))


def _cells(pairs: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by, _num(F.col(x)).alias("_x"), _num(F.col(y)).alias("_y")).agg(F.count("*").alias("_n"))


def spearman(pairs: DataFrame, by: Sequence[str] = (), x: str = "label", y: str = "pred") -> DataFrame:
    """Pearson correlation of average ranks, over cells of equal (x, y) weighted by their count."""
    cells = durable(_cells(pairs, by, x, y))
    sides = []
    for col, rank in (("_x", "_rx"), ("_y", "_ry")):
        counts = cells.groupBy(*by, col).agg(F.sum("_n").alias("n"))
        ranked = running_totals(counts, by, col, ["n"])
        sides.append(ranked.select(*by, col, (F.col("n_before") + (F.col("n") + 1) / 2).alias(rank)))
    totals = cells.groupBy(*by).agg(((F.sum("_n") + 1) / 2).alias("_mid"))
    joined = cells.join(sides[0], [*by, "_x"]).join(sides[1], [*by, "_y"])
    centred = _join(joined, totals, by) if by else joined.withColumn("_mid", F.lit(totals.first()["_mid"]))
    dx, dy, n = F.col("_rx") - F.col("_mid"), F.col("_ry") - F.col("_mid"), F.col("_n")
    rho = F.try_divide(F.sum(n * dx * dy), F.sqrt(F.sum(n * dx * dx) * F.sum(n * dy * dy)))
    return centred.groupBy(*by).agg(rho.alias("spearman"))


def kendall(pairs: DataFrame, by: Sequence[str] = (), x: str = "label", y: str = "pred") -> DataFrame:
    """Kendall tau-b by counting inversions digit by digit.

    The column with fewer distinct values is numbered in order. Two different numbers first differ in exactly one
    base-8 digit. Per digit position and common higher digits, running sums over the other column give the
    concordant and discordant pairs. All positions are one aggregation of cells x digits rows, and no pair of rows
    is ever formed.
    """
    cells = durable(_cells(pairs, by, x, y))
    side = lambda c: cells.groupBy(*by, c).agg(F.sum("_n").alias("n"), F.lit(1).cast("bigint").alias("one"))
    x_counts, y_counts = durable(side("_x")), durable(side("_y"))
    placed_by, swept_by, counts = ("_y", "_x", y_counts)
    if x_counts.count() < y_counts.count():
        placed_by, swept_by, counts = ("_x", "_y", x_counts)
    places = running_totals(counts, by, placed_by, ["one"]).select(*by, placed_by, F.col("one_before").alias("_place"))
    last = places.agg(F.max("_place")).first()[0] or 0
    positions = max(1, -(-int(last).bit_length() // DIGIT_BITS))
    levels = cells.join(places, [*by, placed_by]).withColumn(
        "_shift", F.explode(F.array(*[F.lit(i * DIGIT_BITS) for i in range(positions)]))
    )
    shifted = F.call_function("shiftright", F.col("_place"), F.col("_shift"))
    base = 1 << DIGIT_BITS
    levels = levels.withColumn("_digit", F.pmod(shifted, F.lit(base))).withColumn("_prefix", F.floor(shifted / base))
    keys = [*by, "_shift", "_prefix"]
    digits = [f"d{v}" for v in range(base)]
    sums = levels.groupBy(*keys, swept_by).agg(
        *[F.sum(F.when(F.col("_digit") == v, F.col("_n")).otherwise(0)).alias(c) for v, c in enumerate(digits)]
    )
    swept = running_totals(sums, keys, swept_by, digits)

    def crossings(lower: bool) -> Column:
        total = F.lit(0.0)
        for v, c in enumerate(digits):
            others = digits[:v] if lower else digits[v + 1 :]
            if others:
                total = total + _num(F.col(c)) * sum((_num(F.col(f"{o}_before")) for o in others), F.lit(0.0))
        return F.sum(total)

    order = swept.groupBy(*by).agg(crossings(True).alias("_con"), crossings(False).alias("_dis"))
    pairs_of = lambda c: F.sum(_num(c) * (_num(c) - 1) / 2)
    tx = x_counts.groupBy(*by).agg(pairs_of(F.col("n")).alias("_tx"), F.sum("n").alias("_total"))
    ty = y_counts.groupBy(*by).agg(pairs_of(F.col("n")).alias("_ty"))
    joined = _join(_join(tx, ty, by), order, by)
    n0 = _num(F.col("_total")) * (_num(F.col("_total")) - 1) / 2
    tau = F.try_divide(F.col("_con") - F.col("_dis"), F.sqrt((n0 - F.col("_tx")) * (n0 - F.col("_ty"))))
    return joined.select(*by, tau.alias("kendall"))


def correlations(pairs: DataFrame, by: Sequence[str] = (), x: str = "label", y: str = "pred") -> DataFrame:
    """Pearson, Spearman and Kendall side by side."""
    out = _join(pearson(pairs, by, x, y), spearman(pairs, by, x, y), by)
    return _join(out, kendall(pairs, by, x, y), by)


def auc(pairs: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Area under the ROC curve; tied predictions count half. Null when a class is missing."""
    known = pairs.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(*by, _num(F.col(pred)).alias("_p")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    swept = running_totals(counts, by, "_p", ["neg"])
    wins = F.sum(_num(F.col("pos")) * (_num(F.col("neg_before")) + _num(F.col("neg")) / 2))
    return swept.groupBy(*by).agg(
        F.try_divide(wins, _num(F.sum("pos")) * _num(F.sum("neg"))).alias("auc")
    )


def tune_threshold(
    pairs: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred", steps: int = THRESHOLD_STEPS
) -> DataFrame:
    """The threshold i/steps, i = 0..steps, with the best balanced accuracy; the smallest one wins ties.

    Rows without a prediction or label take no part, as in the other metrics. Each prediction is reduced to the number of thresholds it exceeds, so one pass leaves at most
    2 x (steps + 2) counts per group for the sweep.
    """
    p = _num(F.col(pred))
    guess = F.least(F.greatest(F.ceil(p * steps), F.lit(0)), F.lit(steps + 1))
    # correct the rounding of p * steps against the exact boundary i / steps
    down = F.when((guess > 0) & ~(p > (guess - 1) / F.lit(float(steps))), guess - 1).otherwise(guess)
    passed = F.when((down <= steps) & (p > down / F.lit(float(steps))), down + 1).otherwise(down)
    known = pairs.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(*by, passed.cast("int").alias("_passed")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    # threshold i is exceeded by rows that pass more than i thresholds
    grid = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_passed", F.struct("pos", "neg")))).alias("_m"),
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
    )
    grid = grid.select(*by, "_m", "_pos", "_neg", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    here = F.try_element_at(F.col("_m"), F.col("i"))
    low = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    swept = grid.withColumn("fn", F.sum(F.coalesce(here["pos"], F.lit(0))).over(low)).withColumn(
        "tn", F.sum(F.coalesce(here["neg"], F.lit(0))).over(low)
    )
    score = F.round(
        balanced_accuracy(F.col("_pos") - F.col("fn"), F.col("_neg") - F.col("tn"), F.col("fn"), F.col("tn")), 12
    )
    best = F.max_by(F.struct("i", score.alias("score")), F.struct(score, -F.col("i")))
    return (
        swept.groupBy(*by)
        .agg(best.alias("_b"))
        .select(*by, (F.col("_b.i") / F.lit(float(steps))).alias("threshold"), F.col("_b.score").alias("tuned_score"))
    )


def apply_threshold(
    pairs: DataFrame, tuned: DataFrame, by: Sequence[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Metrics at each group's tuned threshold."""
    joined = pairs.join(tuned.select(*by, "threshold"), list(by))
    return class_metrics(joined, [*by, "threshold"], label, pred, F.col("threshold"))


def wilcoxon(pairs: DataFrame, by: Sequence[str] = (), a: str = "a", b: str = "b", alpha: float = 0.05) -> DataFrame:
    """Wilcoxon signed-rank test of paired scores: W statistic, two-sided normal p-value with tie correction."""
    diff = _num(F.col(a)) - _num(F.col(b))
    diffs = pairs.select(*by, F.round(diff, 12).alias("_d")).where("_d <> 0")
    counts = diffs.groupBy(*by, F.abs("_d").alias("_abs")).agg(
        F.count("*").alias("n"), F.count_if(F.col("_d") > 0).alias("up")
    )
    swept = running_totals(counts, by, "_abs", ["n"])
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    n = _num(F.col("n"))
    sums = swept.groupBy(*by).agg(
        F.sum(F.col("up") * rank).alias("w_plus"),
        F.sum((F.col("n") - F.col("up")) * rank).alias("w_minus"),
        _num(F.sum("n")).alias("_n"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    total = F.col("_n")
    mean = total * (total + 1) / 4
    sd = F.sqrt((total * (total + 1) * (2 * total + 1) - F.col("_ties") / 2) / 24)
    stat = F.least("w_plus", "w_minus")
    z = F.try_divide(stat - mean, sd)
    p = F.least(F.lit(1.0), 2 * normal_cdf(-F.abs(z)))
    return sums.select(
        *by, F.col("_n").cast("bigint").alias("n_nonzero"), stat.alias("statistic"), p.alias("p_value")
    ).withColumn("significant", F.col("p_value") < alpha)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution for z <= 0 from the complementary error function.

    Rational Chebyshev fit of erfc (Press et al., Numerical Recipes), relative error below 1.2e-7.
    """
    # fixed values: coefficients of the published fit, lowest power first
    fit = [
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    ]
    x = -z / F.lit(2.0**0.5)
    t = 1 / (1 + x / 2)
    poly = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly) / 2


def choice_accuracy(
    candidates: DataFrame, item: str, by: Sequence[str] = (), pos: str = "pos", score: str = "score", answer: str = "is_answer"
) -> DataFrame:
    """Share of items whose best-scored candidate (first maximum) is the answer."""
    best = F.max_by(F.col(answer).cast("int"), F.struct(F.col(score), -F.col(pos)))
    return (
        candidates.groupBy(*by, item)
        .agg(best.alias("_hit"))
        .groupBy(*by)
        .agg(F.avg("_hit").alias("accuracy"), F.count("*").alias("n_items"))
    )


def pair_preference(pairs: DataFrame, pair: str, side: str = "side", pred: str = "pred") -> DataFrame:
    """Turn two predictions per pair into 0/1 preferences; the first wins a tie."""
    first = F.max(F.when(F.col(side) == 0, F.col(pred)))
    second = F.max(F.when(F.col(side) == 1, F.col(pred)))
    verdict = pairs.groupBy(pair).agg((second > first).cast("int").alias("_second"))
    return (
        pairs.join(verdict, pair)
        .withColumn("preferred", F.when(F.col(side) == 1, F.col("_second")).otherwise(1 - F.col("_second")))
        .drop("_second")
    )


def best_reference(
    rows: DataFrame, item: str, score: str, quality: str, by: Sequence[str] = (), good: float = 4.0
) -> DataFrame:
    """Best score over an item's references, labelled by its quality reaching ``good``."""
    return rows.groupBy(*by, item).agg(
        F.max(score).alias("pred"), (F.max(quality) >= good).cast("int").alias("label")
    )
