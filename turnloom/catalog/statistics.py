"""Queries over evaluation statistics, reports and agreement."""

from pyspark.sql import functions as F

from turnloom.catalog.registry import query, table
from turnloom.functions import dialogue as dg
from turnloom.operators import agreement as ag
from turnloom.operators import judging as jd
from turnloom.operators import ranking as rk
from turnloom.operators import reports as rp
from turnloom.operators import stats as st
from turnloom.plans import evaluation as ev
from turnloom.plans import human as hm
from turnloom.session import fresh_dir
from turnloom.sources import sinks

big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)


def rounded(df, *columns):
    return df.select(*[r6(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def scored(spark, d):
    """Scored pairs: discount at least 5% as the label, price as the prediction."""
    rows = table(spark, d, "lineitem")
    return rows.select(
        F.col("l_returnflag").alias("grp"), (F.col("l_discount") >= 0.05).cast("int").alias("label"),
        (F.col("l_extendedprice") / 105000).alias("price"), (F.col("l_discount") * 10).alias("tied"),
        F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), "l_orderkey", "l_linenumber",
    )


PAIRS = """pairs AS (SELECT l_returnflag AS grp, CAST(l_discount >= 0.05 AS INT) AS label, l_extendedprice / 105000 AS price,
  l_discount * 10 AS tied, l_quantity AS quantity, l_tax AS tax FROM lineitem)"""


def judged(spark, d):
    """Two judges' scores per paper, system and aspect."""
    aspect = F.element_at(F.array(F.lit("clarity"), F.lit("scientific"), F.lit("societal")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("system"), aspect.alias("aspect"))
        .agg((1 + F.max("l_quantity").cast("int") % 5).alias("a"), (1 + F.max("l_suppkey").cast("int") % 5).alias("b"))
    )


JUDGED = """judged AS (SELECT l_orderkey AS paper_id, l_returnflag AS system, ['clarity', 'scientific', 'societal'][l_linenumber % 3 + 1] AS aspect,
  1 + max(l_quantity)::INT % 5 AS a, 1 + max(l_suppkey)::INT % 5 AS b FROM lineitem GROUP BY 1, 2, 3)"""


def judge(spark, d, name):
    return judged(spark, d).select("paper_id", "system", "aspect", F.col(name).alias("score"))


def confusion(pred: str, threshold: str, source: str = "pairs") -> str:
    return f"""cells AS (SELECT grp, count(*) FILTER (WHERE label = 1 AND {pred} > {threshold}) AS tp, count(*) FILTER (WHERE label <> 1 AND {pred} > {threshold}) AS fp,
  count(*) FILTER (WHERE label = 1 AND NOT {pred} > {threshold}) AS fn, count(*) FILTER (WHERE label <> 1 AND NOT {pred} > {threshold}) AS tn FROM {source} GROUP BY 1)"""


METRICS = """round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS balanced_accuracy,
  round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc"""


@query("class_metrics", f"WITH {PAIRS}, {confusion('tied', '0.5')} SELECT grp, {METRICS} FROM cells")
def class_metrics(spark, d):
    out = st.class_metrics(scored(spark, d), ["grp"], pred="tied")
    return rounded(out, "accuracy", "balanced_accuracy", "f1", "mcc")


@query("three_way_accuracy", """
WITH t AS (SELECT l_returnflag AS grp, l_partkey % 3 AS label, [l_discount, l_tax, 0.05] AS tri FROM lineitem)
SELECT grp, round(avg(CAST(list_position(tri, list_max(tri)) - 1 = label AS INT)), 6) AS accuracy,
  round(avg(CAST(list_position(tri, list_max(tri)) - 1 = label AS INT)), 6) AS micro_f1 FROM t GROUP BY 1""")
def three_way_accuracy(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("grp"), (F.col("l_partkey") % 3).alias("label"), F.array("l_discount", "l_tax", F.lit(0.05)).alias("tri")
    )
    return rounded(st.three_way_accuracy(rows, ["grp"]), "accuracy", "micro_f1")


RANKS = "SELECT *, (rank() OVER (PARTITION BY grp ORDER BY {0}) + (count(*) OVER (PARTITION BY grp, {0}) - 1) / 2.0) AS r_{0}"


@query("average_ranks", """
WITH r AS (SELECT l_returnflag AS grp, l_extendedprice AS price, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS lo, count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) AS n FROM lineitem)
SELECT grp, price, n, CAST(any_value(lo + (n - 1) / 2.0) AS DOUBLE) AS rank FROM r GROUP BY 1, 2, 3""")
def average_ranks(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("price"))
    return rk.average_ranks(rows, "price", ["grp"])


@query("rank_correlations", f"""
WITH {PAIRS}, a AS (SELECT grp, quantity, price, rank() OVER (PARTITION BY grp ORDER BY quantity) + (count(*) OVER (PARTITION BY grp, quantity) - 1) / 2.0 AS rq,
  rank() OVER (PARTITION BY grp ORDER BY price) + (count(*) OVER (PARTITION BY grp, price) - 1) / 2.0 AS rp FROM pairs)
SELECT grp, round(corr(quantity, price), 6) AS pearson, round(corr(rq, rp), 6) AS spearman FROM a GROUP BY 1""")
def rank_correlations(spark, d):
    rows = scored(spark, d)
    out = st.pearson(rows, ["grp"], "quantity", "price").join(st.spearman(rows, ["grp"], "quantity", "price"), "grp")
    return rounded(out, "pearson", "spearman")


@query("kendall_correlation", f"""
WITH {PAIRS}, c AS (SELECT grp, quantity AS x, tax AS y, count(*)::DOUBLE AS n FROM pairs GROUP BY 1, 2, 3),
s AS (SELECT a.grp, sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a JOIN c b ON a.grp = b.grp GROUP BY 1),
t AS (SELECT grp, sum(n) AS n FROM c GROUP BY 1), tx AS (SELECT grp, sum(n * (n - 1) / 2) AS t FROM (SELECT grp, x, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
ty AS (SELECT grp, sum(n * (n - 1) / 2) AS t FROM (SELECT grp, y, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT grp, round(s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS kendall FROM s JOIN t USING (grp) JOIN tx USING (grp) JOIN ty USING (grp)""")
def kendall_correlation(spark, d):
    return rounded(st.kendall(scored(spark, d), ["grp"], "quantity", "tax"), "kendall")


@query("kendall_many_values")
def kendall_many_values(spark, d):
    return rounded(st.kendall(scored(spark, d), ["grp"], "quantity", "price"), "kendall")


@query("roc_auc", f"""
WITH {PAIRS}, r AS (SELECT grp, label, rank() OVER (PARTITION BY grp ORDER BY price) + (count(*) OVER (PARTITION BY grp, price) - 1) / 2.0 AS rp FROM pairs)
SELECT grp, round((sum(rp) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1)::DOUBLE * count(*) FILTER (WHERE label <> 1)), 6) AS auc FROM r GROUP BY 1""")
def roc_auc(spark, d):
    return rounded(st.auc(scored(spark, d), ["grp"], pred="price"), "auc")


SWEEP = """sweep AS (SELECT grp, i, count(*) FILTER (WHERE label = 1 AND {pred} > i / 1000.0::DOUBLE) AS tp, count(*) FILTER (WHERE label = 1) AS p,
    count(*) FILTER (WHERE label <> 1 AND NOT {pred} > i / 1000.0::DOUBLE) AS tn, count(*) FILTER (WHERE label <> 1) AS q
  FROM {source}, range(0, 1001) AS t(i) GROUP BY 1, 2),
best AS (SELECT grp, i, round((tp / p::DOUBLE + tn / q::DOUBLE) / 2, 12) AS score FROM sweep),
top AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, i) AS rn FROM best),
tuned AS (SELECT grp, i / 1000.0::DOUBLE AS threshold, score FROM top WHERE rn = 1)"""


@query("tuned_thresholds", f"WITH {PAIRS}, {SWEEP.format(pred='tied', source='pairs')} SELECT grp, threshold, round(score, 6) AS tuned_score FROM tuned")
def tuned_thresholds(spark, d):
    return rounded(st.tune_threshold(scored(spark, d), ["grp"], pred="tied"), "tuned_score")


@query("applied_thresholds", f"""
WITH p0 AS (SELECT l_returnflag AS grp, CAST(l_discount >= 0.05 AS INT) AS label, l_extendedprice / 105000 AS price, l_linenumber FROM lineitem),
valid AS (SELECT * FROM p0 WHERE l_linenumber = 1), test AS (SELECT * FROM p0 WHERE l_linenumber <> 1),
{SWEEP.format(pred='price', source='valid')}, j AS (SELECT grp, threshold, label, price FROM test JOIN tuned USING (grp)),
{confusion('price', 'threshold', 'j').replace('SELECT grp,', 'SELECT grp, threshold,').replace('GROUP BY 1)', 'GROUP BY 1, 2)')}
SELECT grp, threshold, {METRICS} FROM cells""")
def applied_thresholds(spark, d):
    rows = scored(spark, d)
    tuned = st.tune_threshold(rows.where("l_linenumber = 1"), ["grp"], pred="price")
    out = st.apply_threshold(rows.where("l_linenumber <> 1"), tuned, ["grp"], pred="price")
    return rounded(out, "accuracy", "balanced_accuracy", "f1", "mcc")


@query("choice_accuracy", """
WITH c AS (SELECT l_orderkey, l_returnflag AS grp, l_linenumber AS pos, max(l_discount) AS score, max(l_suppkey) % 2 = 0 AS is_answer FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY grp, l_orderkey ORDER BY score DESC, pos) AS rn FROM c)
SELECT grp, round(avg(is_answer::INT), 6) AS accuracy, count(*) AS n_items FROM b WHERE rn = 1 GROUP BY 1""")
def choice_accuracy(spark, d):
    cands = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("pos")).agg(
        F.max("l_discount").alias("score"), (F.max("l_suppkey") % 2 == 0).alias("is_answer")
    )
    return rounded(st.choice_accuracy(cands, "l_orderkey", ["grp"]), "accuracy")


@query("pair_preference", """
WITH s AS (SELECT l_orderkey AS pair, l_linenumber % 2 AS side, max(l_discount) AS pred, CAST(max(l_tax) > 0.04 AS INT) AS label FROM lineitem GROUP BY 1, 2),
w AS (SELECT pair, coalesce(max(pred) FILTER (WHERE side = 1) > max(pred) FILTER (WHERE side = 0), NULL)::INT AS second FROM s GROUP BY 1)
SELECT pair, CAST(side AS INT) AS side, label, CAST(CASE WHEN side = 1 THEN second ELSE 1 - second END AS INT) AS preferred FROM s JOIN w USING (pair) WHERE second IS NOT NULL""")
def pair_preference(spark, d):
    sides = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair"), (F.col("l_linenumber") % 2).alias("side")).agg(
        F.max("l_discount").alias("pred"), (F.max("l_tax") > 0.04).cast("int").alias("label")
    )
    return st.pair_preference(sides, "pair").where("preferred is not null").select("pair", "side", "label", "preferred")


@query("best_references", """
SELECT l_orderkey AS item, max(l_discount) AS pred, CAST(max(l_quantity) >= 40 AS INT) AS label FROM lineitem GROUP BY 1""")
def best_references(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "item")
    return st.best_reference(rows, "item", "l_discount", "l_quantity", good=40)


@query("signed_rank_test", f"""
WITH {JUDGED}, p AS (SELECT aspect, x.a::DOUBLE - y.a AS df FROM judged x JOIN judged y USING (paper_id, aspect) WHERE x.system = 'A' AND y.system = 'R' AND x.a <> y.a),
r AS (SELECT aspect, df, rank() OVER (PARTITION BY aspect ORDER BY abs(df)) + (count(*) OVER (PARTITION BY aspect, abs(df)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY aspect, abs(df)) AS t FROM p)
SELECT aspect, count(*) AS n_nonzero, CAST(least(sum(r) FILTER (WHERE df > 0), sum(r) FILTER (WHERE df < 0)) AS DOUBLE) AS statistic FROM r GROUP BY 1""")
def signed_rank_test(spark, d):
    return ev.significance(judge(spark, d, "a"), "A", "R").select("aspect", "n_nonzero", "statistic")


# the published rational fit of the complementary error function, lowest power first
ERFC_FIT = "[-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]::DOUBLE[]"


@query("signed_rank_p_values", f"""
WITH {JUDGED}, p AS (SELECT aspect, x.a::DOUBLE - y.a AS df FROM judged x JOIN judged y USING (paper_id, aspect) WHERE x.system = 'A' AND y.system = 'R' AND x.a <> y.a),
r AS (SELECT aspect, df, rank() OVER (PARTITION BY aspect ORDER BY abs(df)) + (count(*) OVER (PARTITION BY aspect, abs(df)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY aspect, abs(df)) AS t FROM p),
s AS (SELECT aspect, count(*)::DOUBLE AS n, CAST(least(sum(r) FILTER (WHERE df > 0), sum(r) FILTER (WHERE df < 0)) AS DOUBLE) AS w, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY 1),
z AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) / sqrt(2) AS x FROM s),
f AS (SELECT *, 1 / (1 + x / 2) AS t FROM z),
e AS (SELECT *, t * exp(-x * x + list_sum(list_transform({ERFC_FIT}, lambda c, k: c * t ** (k - 1)))) AS p FROM f)
SELECT aspect, n::BIGINT AS n_nonzero, w AS statistic, round(least(1, p), 6) AS p_value, p < 0.05 AS significant FROM e""")
def signed_rank_p_values(spark, d):
    return rounded(ev.significance(judge(spark, d, "a"), "A", "R"), "p_value")


@query("judge_correlation", f"""
WITH {JUDGED}, r AS (SELECT aspect, rank() OVER (PARTITION BY aspect ORDER BY a) + (count(*) OVER (PARTITION BY aspect, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY aspect ORDER BY b) + (count(*) OVER (PARTITION BY aspect, b) - 1) / 2.0 AS rb FROM judged)
SELECT aspect, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY 1""")
def judge_correlation(spark, d):
    return rounded(ev.judge_correlation(judge(spark, d, "a"), judge(spark, d, "b")), "spearman")


@query("aspect_report", f"""
WITH {JUDGED}, m AS (SELECT system, aspect, round_even(avg(a), 2) AS mean_score, count(*) AS n_rows FROM judged GROUP BY 1, 2)
SELECT system, aspect, mean_score, n_rows FROM m UNION ALL
SELECT system, 'overall', round_even(count(*) / sum(1 / mean_score), 2), max(n_rows) FROM m GROUP BY 1""")
def aspect_report(spark, d):
    return jd.aspect_report(judge(spark, d, "a"))


@query("wide_report", f"""
WITH {JUDGED} SELECT system, round_even(avg(a) FILTER (WHERE aspect = 'clarity'), 2) AS clarity, round_even(avg(a) FILTER (WHERE aspect = 'societal'), 2) AS societal
FROM judged GROUP BY 1""")
def wide_report(spark, d):
    return jd.wide_report(jd.aspect_report(judge(spark, d, "a")), ["system"], ["clarity", "societal"])


@query("topic_report", f"""
WITH {JUDGED}, t AS (SELECT 'topic' || paper_id % 4 AS topic, system, a FROM judged)
SELECT topic, system, round(avg(a), 6) AS mean_score, count(*) AS n_rows FROM t GROUP BY ROLLUP (topic, system)""")
def topic_report(spark, d):
    rows = judge(spark, d, "a").withColumn("topic", F.concat(F.lit("topic"), (F.col("paper_id") % 4).cast("string")))
    return rounded(jd.topic_report(rows), "mean_score")


@query("score_counts", f"WITH {JUDGED} SELECT aspect, a AS score, count(*) AS n_rows FROM judged GROUP BY 1, 2")
def score_counts(spark, d):
    rows = judge(spark, d, "a").withColumn("score", F.col("score").cast("string"))
    return jd.score_counts(rows)


@query("score_matrix", f"""
WITH {JUDGED} SELECT paper_id, max(a) FILTER (WHERE system = 'A') AS "A", max(a) FILTER (WHERE system = 'N') AS "N", max(a) FILTER (WHERE system = 'R') AS "R"
FROM judged WHERE aspect = 'clarity' GROUP BY 1""")
def score_matrix(spark, d):
    return jd.score_matrix(judge(spark, d, "a").where("aspect = 'clarity'"), ["A", "N", "R"])


@query("preference_agreement", f"""
WITH {JUDGED}, w AS (SELECT paper_id, aspect, system, row_number() OVER (PARTITION BY paper_id, aspect ORDER BY a DESC, system) AS ra,
  row_number() OVER (PARTITION BY paper_id, aspect ORDER BY b DESC, system) AS rb FROM judged)
SELECT round(avg(CAST(x.system = y.system AS INT)), 6) AS agreement, count(*) AS n_items FROM w x JOIN w y USING (paper_id, aspect) WHERE x.ra = 1 AND y.rb = 1""")
def preference_agreement(spark, d):
    out = jd.preference_agreement(judge(spark, d, "a"), judge(spark, d, "b"), ["paper_id", "aspect"])
    return rounded(out, "agreement")


@query("mean_and_spread", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n_rows FROM events GROUP BY 1")
def mean_and_spread(spark, d):
    return rounded(rp.mean_and_spread(table(spark, d, "events"), "event_type", "value"), "mean", "std")


@query("box_plots", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
j AS (SELECT e.event_type, value, q25, q50, q75, value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM events e JOIN q USING (event_type))
SELECT event_type, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, min(value) AS low, max(value) AS high, min(value) FILTER (WHERE inside) AS whisker_low,
  max(value) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS n_outliers FROM j GROUP BY event_type, j.q25, j.q50, j.q75""")
def box_plots(spark, d):
    return rounded(rp.box_plot(table(spark, d, "events"), "event_type", "value"), "q25", "q50", "q75")


@query("score_histogram", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
w AS (SELECT *, least(2 * iqr / n ** (1.0 / 3), (hi - lo) / (log2(n) + 1)) AS width FROM s), b AS (SELECT lo, ceil((hi - lo) / width) AS bins, (hi - lo) / ceil((hi - lo) / width) AS width FROM w)
SELECT event_type, CAST(least(floor((value - lo) / width), bins - 1) AS INT) AS bin, count(*) AS n_rows, round(any_value(lo + least(floor((value - lo) / width), bins - 1) * width), 6) AS bin_low
FROM events, b GROUP BY 1, 2""")
def score_histogram(spark, d):
    return rounded(rp.histogram(table(spark, d, "events"), "event_type", "value"), "bin_low")


def annotated(spark, d):
    """Annotators (customers' order clerks) choosing between two models."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("sc_title"), F.col("o_orderstatus").alias("gen_model"), F.col("o_orderkey").alias("annotator"),
        F.when(F.col("o_totalprice").cast("int") % 2 == 0, "left").otherwise("right").alias("choice"),
        (F.col("o_totalprice") > 100000).alias("flag"),
    )


ANNOTATED = """ann AS (SELECT o_custkey AS sc_title, o_orderstatus AS gen_model, o_orderkey AS annotator,
  CASE WHEN trunc(o_totalprice)::INT % 2 = 0 THEN 'left' ELSE 'right' END AS choice, o_totalprice > 100000 AS flag FROM orders)"""

AGREEMENT = """r AS (SELECT *, row_number() OVER (PARTITION BY sc_title, gen_model ORDER BY annotator) AS rn, count(*) OVER (PARTITION BY sc_title, gen_model) AS m FROM {source}),
p AS (SELECT sc_title, gen_model, max(choice) FILTER (WHERE rn = 1) AS a, max(choice) FILTER (WHERE rn = 2) AS b FROM r WHERE m > 2 GROUP BY 1, 2),
k AS (SELECT count(*) AS n_units, avg(CAST(a = b AS INT)) AS po, avg((a = 'left')::INT) * avg((b = 'left')::INT) + avg((a = 'right')::INT) * avg((b = 'right')::INT) AS pe FROM p),
u AS (SELECT sc_title, gen_model, count(*)::DOUBLE AS m, sum((choice = 'left')::INT)::DOUBLE AS l FROM {source} GROUP BY 1, 2 HAVING count(*) > 2),
al AS (SELECT sum(m)::BIGINT AS n_values, 1 - sum((m * m - l * l - (m - l) * (m - l)) / (m - 1)) / ((sum(m) * sum(m) - sum(l) * sum(l) - sum(m - l) * sum(m - l)) / (sum(m) - 1)) AS alpha FROM u)"""


@query("annotator_agreement", f"""
WITH {ANNOTATED}, flagged AS (SELECT * FROM ann WHERE flag), {AGREEMENT.format(source='flagged')}
SELECT 'choice' AS question, n_units, round((po - pe) / (1 - pe), 6) AS kappa, n_values, round(alpha, 6) AS alpha FROM k, al""")
def annotator_agreement(spark, d):
    return rounded(hm.agreement_report(annotated(spark, d), {"choice": "flag"}), "kappa", "alpha")


ASPECTS = {"clarity": "trunc(o_totalprice)::INT % 2", "societal": "o_orderkey % 3 % 2"}


def aspect_sql(aspect: str, draw: str) -> str:
    """Agreement on the units whose two judges differ: both give points by the remainder of the unit's number."""
    return f"""(WITH f AS (SELECT o_custkey AS sc_title, o_orderstatus AS gen_model, o_orderkey AS annotator, CASE WHEN {draw} = 0 THEN 'left' ELSE 'right' END AS choice
  FROM orders WHERE o_custkey % 3 <> o_custkey % 2), {AGREEMENT.format(source='f')}
SELECT 'pw_llm_{aspect}' AS question, n_units, round((po - pe) / (1 - pe), 6) AS kappa, n_values, round(alpha, 6) AS alpha FROM k, al)"""


@query("human_agreement", " UNION ALL ".join(aspect_sql(a, draw) for a, draw in ASPECTS.items()))
def human_agreement(spark, d):
    """From an annotation export, one task per unit with all its annotations, to agreement per aspect."""
    o = table(spark, d, "orders")
    drawn = {"clarity": F.col("o_totalprice").cast("int") % 2, "societal": F.col("o_orderkey") % 3 % 2}
    value = lambda side: F.struct(F.when(side == 0, "left").otherwise("right").alias("selected"), F.lit(None).cast("string").alias("text"))
    results = F.array(*[F.struct(F.lit("pairwise").alias("type"), F.lit(f"pw_llm_{a}").alias("to_name"), value(side).alias("value")) for a, side in drawn.items()])
    mail = F.struct(F.format_string("%012d@annotators", F.col("o_orderkey")).alias("email"))
    rows = o.select("o_custkey", "o_orderstatus", F.struct(mail.alias("completed_by"), results.alias("result")).alias("a"))
    points = lambda n: F.concat(F.lit("Score: "), (F.col("o_custkey") % n + 1).cast("string"), F.lit("\nReason: none"))
    data = F.struct(
        F.col("o_custkey").cast("string").alias("sc_title"), F.col("o_orderstatus").alias("gen_model"),
        *[points(n).alias(f"llm{k}_{a}_eval") for a in ASPECTS for k, n in ((1, 3), (2, 2))],
    )
    export = rows.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list("a").alias("annotations")).select(data.alias("data"), "annotations")
    return rounded(hm.human_report(export, {"left": "one", "right": "two"}, list(ASPECTS)), "kappa", "alpha")


@query("annotation_lists", f"""
WITH {ANNOTATED} SELECT sc_title, gen_model, count(*) AS n_annotations, string_agg(choice, ',' ORDER BY annotator) AS annotations FROM ann GROUP BY 1, 2 HAVING count(*) > 2""")
def annotation_lists(spark, d):
    ann = annotated(spark, d)
    lists = ag.annotation_lists(ann, ["sc_title", "gen_model"], "annotator", "choice")
    return lists.join(ag.rated_units(ann, ["sc_title", "gen_model"]).drop("n_annotations"), ["sc_title", "gen_model"], "left_semi").select(
        "sc_title", "gen_model", "n_annotations", F.array_join("annotations", ",").alias("annotations")
    )


@query("preference_counts", f"WITH {ANNOTATED} SELECT choice AS value, count(*) AS n_rows, count(*) FILTER (WHERE flag) AS n_flagged FROM ann GROUP BY 1")
def preference_counts(spark, d):
    return hm.value_counts(annotated(spark, d), "choice", "flag")


@query("judge_differences", f"""
WITH {JUDGED} SELECT paper_id, system, aspect, abs(a - b) >= 1 AS differs FROM judged""")
def judge_differences(spark, d):
    from turnloom.functions.text import judged_text

    rows = judged(spark, d).select(
        "paper_id", "system", "aspect", judged_text(F.col("a"), F.lit("x")).alias("one"), judged_text(F.col("b"), F.lit("y")).alias("two")
    )
    return hm.judge_difference(rows, "one", "two", "differs").drop("one", "two")


@query("metric_table", """
WITH m AS (SELECT event_type AS system, avg(value) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1)
SELECT system, 'mean' AS metric, round(mean, 6) AS value FROM m UNION ALL SELECT system, 'low', round(low, 6) FROM m UNION ALL SELECT system, 'high', round(high, 6) FROM m""")
def metric_table(spark, d):
    wide = table(spark, d, "events").groupBy(F.col("event_type").alias("system")).agg(
        F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return rounded(rp.metric_table(wide, ["system"], ["mean", "low", "high"]), "value")


@query("distinct_topics", "SELECT DISTINCT lang AS topic FROM documents")
def distinct_topics(spark, d):
    return table(spark, d, "documents").select(F.col("lang").alias("topic")).distinct()


@query("annotation_tasks", f"""
WITH {JUDGED} SELECT paper_id, system, 'Score: ' || max(a) FILTER (WHERE aspect = 'clarity') || chr(10) || 'Reason: r' || max(a) FILTER (WHERE aspect = 'clarity') AS llm1_clarity,
  'Score: ' || max(b) FILTER (WHERE aspect = 'societal') || chr(10) || 'Reason: s' || max(b) FILTER (WHERE aspect = 'societal') AS llm2_societal FROM judged GROUP BY 1, 2""")
def annotation_tasks(spark, d):
    rows = judged(spark, d)
    side = lambda c, tag: rows.select("paper_id", "system", "aspect", F.col(c).alias("score"), F.concat(F.lit(tag), F.col(c).cast("string")).alias("reasons"))
    dialogues = rows.select("paper_id", "system").distinct().select(
        "paper_id", "system", F.lit("t").alias("topic"), F.lit("p").alias("paper_text"), F.array(dg.message("user", F.lit("hi"))).alias("dialogue")
    )
    path = fresh_dir(spark, "tasks")
    sinks.save_tasks(rp.annotation_tasks(dialogues, side("a", "r"), side("b", "s")), path)
    stored = spark.read.text(path).withColumnRenamed("value", "task")
    read = lambda name, kind="string": F.get_json_object("task", f"$.{name}").cast(kind)
    tasks = stored.select(read("sc_title", "long").alias("paper_id"), read("gen_model").alias("system"), "task")
    return tasks.select(
        "paper_id", "system", F.get_json_object("task", "$.llm1_clarity_eval").alias("llm1_clarity"),
        F.get_json_object("task", "$.llm2_societal_eval").alias("llm2_societal"),
    )
