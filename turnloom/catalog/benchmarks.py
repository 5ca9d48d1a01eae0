"""Queries over the benchmark tasks, all of them, and the equivalent SQL: pairs, scores and metrics.

Raw tables are derived from documents. The SQL repeats what a task says about its data, one line per task.
"""

from pyspark.sql import functions as F

from turnloom.catalog.datasets import BASE, FILLED, OPTIONS, base, raw_choice, raw_plain
from turnloom.catalog.registry import LEXICAL, SENTENCES, WORDS, query
from turnloom.catalog.statistics import rounded
from turnloom.operators import reports as rp
from turnloom.operators.stages import score_pairs
from turnloom.plans import benchmark as bm

TRUE = ("begin", "dialfact", "fever", "frank", "mnbm", "paws", "q2", "qags_cnndm", "qags_xsum", "summeval", "vitc")
SUMMAC = ("cogensumm", "xsumfaith", "polytope", "factcc", "summeval", "frank")


def bench_tables(spark, d):
    """Raw benchmark tables of every task; the material they share is stored once."""
    b = base(spark, d, ["row_id", "text", "source", "lang", "s1", "s2", "s3", "y3", "y2", "y6", "quality"])
    plain, choice = raw_plain(spark, d, b), raw_choice(spark, d, b)
    c = F.col
    nli = plain["mnli"].withColumn("label", c("label") - F.when(c("row_id") % 7 == 0, c("label") + 1).otherwise(0))
    pairs = lambda one, two, *more: b.select("row_id", c(one[0]).alias(one[1]), c(two[0]).alias(two[1]), *more)
    sent = lambda label, name="label": pairs(("s1", "sentence1"), ("s2", "sentence2"), label.alias(name))
    half = (c("row_id") % 2).alias("label")
    claims = b.select("row_id", c("text").alias("document"), F.lower("s1").alias("claim"), c("quality").alias("label"), F.when(c("y2") == 1, "valid").otherwise("test").alias("split"))
    systems = F.array(
        F.struct(F.lit(0).alias("place"), F.lit("x").alias("system"), c("s1").alias("sys_summ")),
        F.struct(F.lit(1).alias("place"), F.lit("y").alias("system"), c("source").alias("sys_summ")),
    )
    keyed = b.select("row_id", c("text").alias("src"), "y6", F.explode(systems).alias("e")).select(
        "row_id", "src", "e.*", c("y6").alias("informativeness"), (5 - c("y6")).alias("relevance"), ((c("row_id") + c("e.place")) % 2).cast("int").alias("fact")
    )
    rated = lambda score: claims.select("row_id", "document", c("claim").alias("summary")).join(b.select("row_id", score.alias("consistency"), (5 - c("y6")).alias("relevance")), "row_id")
    summaries = lambda score: pairs(("text", "document"), ("s1", "summary"), score.alias("consistency"))
    chat = b.select("row_id", c("s1").alias("dialog_history"), c("s2").alias("fact"), c("s3").alias("response"), c("y6").alias("engaging"), c("y2").alias("uses_knowledge"))
    review = b.select("row_id", "text", F.when(c("y2") == 1, "positive").otherwise("negative").alias("label_text"))
    wmt = b.select("row_id", c("s1").alias("reference"), c("s2").alias("candidate"), c("y6").alias("score"), "lang")
    right = F.when(c("y2") == 1, c("source")).otherwise(c("lang"))
    refs = lambda *names: b.select("row_id", c("s1").alias("sys_summ"), F.array(*names).alias("ref_summs"), c("y6").alias("quality"))
    grounded = claims.select("row_id", c("document").alias("grounding"), c("claim").alias("generated_text"), "label")
    return {
        "stsb": plain["stsb"], "sick": pairs(("s1", "sentence_A"), ("s3", "sentence_B"), c("y6").alias("relatedness_score")),
        "yelp": pairs(("s2", "input_sent"), ("s1", "output_sent"), c("y6").alias("preservation")),
        "newsroom": keyed, "bagel": b.select("row_id", F.array("s1", "s2").alias("ref_summs"), c("s1").alias("sys_summ"), c("y6").alias("informativeness")),
        "summeval": rated(c("y6")), "qags_xsum": summaries(c("y2")), "qags_cnndm": summaries(c("y6") / 5),
        "frank": claims.select("row_id", "document", c("claim").alias("summary"), (c("row_id") % 3 / 2).alias("score"), F.when(c("split") == "valid", "cnndm").otherwise("xsum").alias("dataset")),
        "xsumfaith": claims, "samsum": b.select("row_id", c("text").alias("article"), c("s1").alias("summary"), F.when(c("y2") == 1, "factual").otherwise("too incoherent").alias("label")),
        "rank19": keyed, "sfhot": refs("s1", "s2", "s3"), "sfres": refs("s2", "s3"),
        "race_m": choice["race"], "race_h": choice["race"], "boolq": choice["boolq"], "quail": choice["quail"], "sciq": choice["sciq"], "gap": choice["gap"],
        "dream": b.select("row_id", F.array("s1", "s2").alias("dialogue"), c("s3").alias("question"), F.array("lang", "source").alias("choice"), right.alias("answer")),
        "quartz": b.select("row_id", c("text").alias("para"), c("s1").alias("question"), F.struct(F.array("lang", "source").alias("text"), F.array(F.lit("A"), F.lit("B")).alias("label")).alias("choices"), F.when(c("y2") == 1, "B").otherwise("A").alias("answerKey")),
        **dict.fromkeys(("anli_1", "anli_2", "anli_3", "snli", "mnli_matched", "mnli_mismatched", "nli_fever"), nli),
        "cb": plain["mnli"], "vitaminc": plain["nli_fever"].select("row_id", c("context").alias("evidence"), c("query").alias("claim"), "label"),
        "axb": plain["paws"], **dict.fromkeys(("axg", "rte"), nli.withColumn("label", half)), "wnli": pairs(("s1", "text1"), ("s3", "text2"), half),
        "doc_nli": plain["doc_nli"], "qnli": pairs(("s2", "sentence"), ("s1", "question"), half), "eraser_multi_rc": plain["eraser_multi_rc"],
        "mrpc": sent(c("y2")), "paws": plain["paws"], "paws_qqp": plain["paws_qqp"], "qqp": plain["qqp"],
        "sem_eval": pairs(("s1", "premise"), ("s2", "hypothesis"), c("y3").alias("entailment_judgment")),
        **dict.fromkeys(("sst2", "cr", "imdb", "imdb_knn"), review), "subj": b.select("row_id", "text", F.when(c("y2") == 1, "objective").otherwise("subjective").alias("label_text")),
        "cola": b.select("row_id", c("s1").alias("sentence"), half), "yelp_efl": b.select("row_id", "text", (c("row_id") % 5).alias("label")),
        "ag_news": b.select("row_id", "text", c("y3").alias("label")), "trec": b.select("row_id", "text", (c("row_id") % 6).alias("label_coarse")),
        "persona_chat": chat, "topical_chat": chat, "wmt17": wmt, "wmt18": wmt, "wmt19": wmt,
        **{f"true_{n}": grounded for n in TRUE}, **{f"summac_{n}": claims for n in SUMMAC},
    }


def cleaned(name: str, source: str, claim: str, out: str) -> str:
    """CTEs up to ``name``: ``source`` with a claim in the spelling of its text, sentences capitalised."""
    return f"""{name}0 AS MATERIALIZED (SELECT *, list_reverse(ws) AS back, {WORDS.format(claim)} AS cw FROM {source}),
{name}1 AS MATERIALIZED (SELECT *, list_transform(back, lambda v: lower(v)) AS low FROM {name}0),
{name}2 AS MATERIALIZED (SELECT *, array_to_string(list_transform(cw, lambda w: coalesce(back[nullif(list_position(low, lower(w)), 0)], w)), ' ') AS respelt FROM {name}1),
{name} AS MATERIALIZED (SELECT * EXCLUDE (back, cw, low, respelt), array_to_string(list_transform({SENTENCES.format('respelt')}, lambda s: upper(s[1:1]) || s[2:]), ' ') AS {out} FROM {name}2)"""


def candidate(name, p, h, y="NULL", binary=None, rel="NULL", pos="NULL", answer="NULL", grps="['all']", split="'test'", source="base", item="row_id::VARCHAR"):
    return (
        f"SELECT '{name}' AS task, {item} AS item_id, {grps} AS grps, CAST({pos} AS INT) AS pos, {p} AS p, {h} AS h, CAST({y} AS DOUBLE) AS label,"
        f" CAST({binary or y} AS DOUBLE) AS label_bin, CAST({rel} AS DOUBLE) AS label_rel, CAST({answer} AS BOOLEAN) AS is_answer, {split} AS split FROM {source}"
    )


def optional(*options: str, where: str = "base") -> str:
    return f"(SELECT *, unnest([{', '.join(options)}]) AS o, unnest(range({len(options)})) AS pos FROM {where})"


def quoted(names) -> list[str]:
    return [f"'{n}'" for n in names]


NLI = "CASE WHEN row_id % 7 = 0 OR y3 = -1 THEN 1 ELSE y3 END"
KEYED = "(SELECT *, (row_id + place) % 2 AS fact FROM (SELECT *, unnest(['x', 'y']) AS system, unnest([s1, source]) AS o, unnest([0, 1]) AS place FROM base))"
ASKED = "{q} || ' ' || o || ' '"
# the cleaned claim of text and lower-case first sentence serves many tasks
MORE = f"{BASE}, {cleaned('bc', 'base', 'lower(s1)', 'claim')}, {cleaned('bk', KEYED, 'o', 'kept')}"
LINES = {
    "stsb": ("s1", "s2", "y6"), "sick": ("s1", "s3", "y6"), "yelp": ("s2", "s1", "y6"),
    "newsroom": dict(p="text", h="kept", y="y6", binary="y6 >= 4", rel="5 - y6", source="bk", item="row_id || '/' || system"),
    "bagel": dict(p="s1 || ' ' || s2", h="s1", y="y6", binary="y6 >= 4"),
    "summeval": dict(p="text", h="claim", y="y6", binary="y6 = 5", rel="5 - y6", source="bc"),
    "qags_xsum": ("text", "s1", "y2"), "qags_cnndm": dict(p="text", h="s1", y="y6 / 5", binary="y6 / 5 = 1"),
    "frank": dict(p="CASE WHEN y2 = 1 THEN text ELSE array_to_string(ss, ' ') END", h="claim", y="row_id % 3 / 2.0::DOUBLE", binary="row_id % 3 = 2", grps="[CASE WHEN y2 = 1 THEN 'cnndm' ELSE 'xsum' END, 'all']", source="bc"),
    "xsumfaith": dict(p="text", h="claim", y="quality", source="bc"), "samsum": (r"regexp_replace(text, '[^\x20-\x7E\t\n\r\x0B\x0C]', '', 'g')", "s1", "y2"),
    "rank19": dict(p="text", h="o", y="fact", pos="place", source=KEYED),
    "sfhot": dict(p="s1", h="o", y="y6", binary="NULL", pos="pos", source=optional("s1", "s2", "s3")), "sfres": dict(p="s1", h="o", y="y6", binary="NULL", pos="pos", source=optional("s2", "s3")),
    **{n: dict(p="text", h=f"CASE WHEN contains(q, '_') THEN {FILLED} ELSE {ASKED.format(q='q')} END", pos="pos", answer="pos = CASE WHEN y2 = 0 THEN 0 ELSE 2 END", source=OPTIONS) for n in ("race_m", "race_h")},
    "boolq": dict(p="text", h="s1 || ' ' || o", pos="pos", answer="pos = y2", source=optional("'No.'", "'Yes.'")),
    "dream": dict(p="s1 || ' ' || s2", h=ASKED.format(q="s3"), pos="pos", answer="pos = y2", source=optional("lang", "source")),
    "quartz": dict(p="text", h=ASKED.format(q="s1"), pos="pos", answer="pos = y2", source=optional("lang", "source")),
    "quail": dict(p="text", h=ASKED.format(q="s1"), pos="pos", answer="pos = y3", source=optional("lang", "source", "s3")),
    "sciq": dict(p="text", h=ASKED.format(q="s1"), pos="pos", answer="pos = 0", source=optional("s2", "lang", "source", "s3")),
    "gap": dict(p="text", h="o || text[3:]", pos="pos", answer="pos = 1 - y2", source=optional("lang", "source")),
    **{n: ("s1", "s2", NLI) for n in ("anli_1", "anli_2", "anli_3", "snli", "mnli_matched", "mnli_mismatched")}, "nli_fever": ("s2", "s1", NLI),
    "cb": ("s1", "s2", "CASE y3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE y3 END"), "vitaminc": ("text", "s1", "CASE y3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END"),
    **{n: ("s1", "s2", "y2 = 0") for n in ("axb", "axg", "rte")}, "wnli": ("s1", "s3", "y2"), "doc_nli": ("text", "s1", "y2"), "qnli": ("s2", "s1", "y2 = 0"),
    "eraser_multi_rc": ("text", "replace(s1 || '|| ' || s2, '|', '')", "y2"), **{n: ("s1", "s2", "y2") for n in ("mrpc", "paws", "paws_qqp")}, "qqp": ("s2", "s3", "y2"),
    "sem_eval": ("s1", "s2", "y3 = 1"), **{n: ("text", f"'{bm.SENTIMENT}'", "y2") for n in ("sst2", "cr", "imdb", "imdb_knn")}, "subj": ("text", f"'{bm.OBJECTIVE}'", "y2"), "cola": ("s1", f"'{bm.GRAMMAR}'", "y2"),
    "yelp_efl": dict(p="text", h="o", pos="pos", answer="pos = row_id % 5", source=optional(*quoted(bm.REVIEW_TEMPLATES))),
    "ag_news": dict(p="text", h="o", pos="pos", answer="pos = y3", source=optional(*quoted(bm.NEWS_TEMPLATES))),
    "trec": dict(p="text", h="o", pos="pos", answer="pos = row_id % 6", source=optional(*quoted(bm.QUESTION_TEMPLATES))),
    **{n: dict(p="o", h="s3", y="y", binary="NULL", grps="[g]", source="(SELECT *, unnest(['engaging', 'grounded']) AS g, unnest([s1 || s2, s2]) AS o, unnest([y6, y2::DOUBLE]) AS y FROM base)") for n in ("persona_chat", "topical_chat")},
    **{f"wmt{n}": dict(p="s1", h="s2", y="y6", binary="NULL", grps="[lang]") for n in (17, 18, 19)},
    **{f"true_{n}": dict(p="text", h="claim", y="quality", source="bc") for n in TRUE},
    **{f"summac_{n}": dict(p="text", h="claim", y="quality", split="CASE WHEN y2 = 1 THEN 'valid' ELSE 'test' END", source="bc") for n in SUMMAC},
}


def candidates_sql(names) -> str:
    lines = [candidate(n, **LINES[n]) if isinstance(LINES[n], dict) else candidate(n, *LINES[n]) for n in names]
    return f"{MORE}, cand AS ({' UNION ALL '.join(lines)})"


ALL = tuple(LINES)
# what each task reports
RATED = "newsroom bagel summeval qags_xsum qags_cnndm frank samsum".split()
CHOSEN = "race_m race_h boolq dream quartz quail sciq gap yelp_efl ag_news trec".split()
THREE = "anli_1 anli_2 anli_3 snli mnli_matched mnli_mismatched nli_fever cb vitaminc".split()
DECIDED = (
    "axb axg rte wnli doc_nli qnli eraser_multi_rc mrpc paws paws_qqp qqp sst2 cr imdb imdb_knn subj cola".split()
    + [f"true_{n}" for n in TRUE] + [f"summac_{n}" for n in SUMMAC]
)
KINDS = {
    "corr": RATED + "stsb sick yelp xsumfaith rank19 persona_chat topical_chat wmt17 wmt18 wmt19".split(), "corr_rel": ["newsroom", "summeval"], "auc": RATED + DECIDED,
    "f1": DECIDED, "accuracy": [*DECIDED, "sem_eval"], "mcc": ["axb"], "three_way": THREE, "micro_f1": ["vitaminc"], "choice": CHOSEN,
    "preference": ["rank19"], "best_reference": ["sfhot", "sfres"], "tuned": [f"summac_{n}" for n in SUMMAC],
}


@query("benchmark_candidates", f"WITH {candidates_sql(ALL)} SELECT task, item_id, array_to_string(grps, ',') AS grps, pos, md5(p) AS p_md5, md5(h) AS h_md5, label, label_bin, label_rel, is_answer, split FROM cand")
def benchmark_candidates(spark, d):
    out = bm.candidate_pairs(bench_tables(spark, d))
    return out.select(
        "task", "item_id", F.array_join("grps", ",").alias("grps"), "pos", F.md5("premise").alias("p_md5"), F.md5("hypothesis").alias("h_md5"), "label", "label_bin", "label_rel", "is_answer", "split"
    )


def report_sql(names, systems: dict[str, str]) -> str:
    """CTEs up to ``report(system, task, grp, metric, value)``; ``systems`` gives the prediction from containment ``c``."""
    of = lambda kind: ", ".join(f"'{n}'" for n in names if n in KINDS[kind]) or "''"
    by = "system, task, grp"
    preds = " UNION ALL ".join(f"SELECT '{s}' AS system, *, {e} AS pred FROM co" for s, e in systems.items())
    tok = lambda x: f"list_distinct({LEXICAL.format(x)})"
    half = "(sum(rp) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)"
    share = "CASE WHEN p = 0 THEN tn / q::DOUBLE WHEN q = 0 THEN tp / p::DOUBLE ELSE (tp / p::DOUBLE + tn / q::DOUBLE) / 2 END"
    return f"""{candidates_sql(names)},
co AS (SELECT *, coalesce(len(list_intersect(th, tp)) / nullif(len(th), 0)::DOUBLE, 0) AS c FROM (SELECT task, item_id, grps, pos, label, label_bin, label_rel, is_answer, split, {tok('p')} AS tp, {tok('h')} AS th FROM cand)),
sc AS (SELECT *, unnest(grps) AS grp FROM ({preds})), te AS (SELECT * FROM sc WHERE split = 'test'),
be AS (SELECT {by}, item_id, CAST(max(label) >= 4 AS INT) AS label, max(pred) AS pred FROM te WHERE task IN ({of('best_reference')}) GROUP BY ALL),
pf AS (SELECT {by}, item_id, max(pred) FILTER (WHERE pos = 1) > max(pred) FILTER (WHERE pos = 0) AS second FROM te WHERE task IN ({of('preference')}) GROUP BY ALL),
pr AS (SELECT te.system, te.task, te.grp, label, CASE WHEN (pos = 1) = second THEN 1 ELSE 0 END AS pred FROM te JOIN pf USING (system, task, grp, item_id)),
xy AS (SELECT {by}, '' AS tag, label AS x, pred AS y FROM te WHERE task IN ({of('corr')}) UNION ALL SELECT {by}, '_rel', label_rel, pred FROM te WHERE task IN ({of('corr_rel')}) UNION ALL SELECT {by}, '', label, pred FROM be),
ce AS (SELECT {by}, tag, x, y, count(*)::DOUBLE AS n FROM xy GROUP BY ALL),
ks AS (SELECT a.system, a.task, a.grp, a.tag, sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM ce a JOIN ce b ON a.system = b.system AND a.task = b.task AND a.grp = b.grp AND a.tag = b.tag GROUP BY ALL),
kn AS (SELECT {by}, tag, sum(n) AS n FROM ce GROUP BY ALL),
kx AS (SELECT {by}, tag, sum(n * (n - 1) / 2) AS t FROM (SELECT {by}, tag, x, sum(n) AS n FROM ce GROUP BY ALL) GROUP BY ALL), ky AS (SELECT {by}, tag, sum(n * (n - 1) / 2) AS t FROM (SELECT {by}, tag, y, sum(n) AS n FROM ce GROUP BY ALL) GROUP BY ALL),
ra AS (SELECT *, rank() OVER (PARTITION BY {by}, tag ORDER BY x) + (count(*) OVER (PARTITION BY {by}, tag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {by}, tag ORDER BY y) + (count(*) OVER (PARTITION BY {by}, tag, y) - 1) / 2.0 AS ry FROM xy),
la AS (SELECT {by}, label_bin AS y, pred FROM te WHERE task IN ({of('auc')}) UNION ALL SELECT {by}, label, pred FROM be UNION ALL SELECT {by}, label, pred FROM pr),
au AS (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY pred) + (count(*) OVER (PARTITION BY {by}, pred) - 1) / 2.0 AS rp FROM la),
cl AS (SELECT {by}, label_bin AS y, pred > 0.5 AS up FROM te UNION ALL SELECT system, task, grp || '#', label, pred > 0.5 FROM pr),
cm AS (SELECT {by}, count(*) FILTER (WHERE y = 1 AND up) AS tp, count(*) FILTER (WHERE y <> 1 AND up) AS fp, count(*) FILTER (WHERE y = 1 AND NOT up) AS fn, count(*) FILTER (WHERE y <> 1 AND NOT up) AS tn FROM cl GROUP BY ALL),
th AS (SELECT {by}, avg(CAST(CASE WHEN c >= 1 - c THEN 0 ELSE 2 END = label AS INT)) AS v FROM te GROUP BY ALL),
ch AS (SELECT {by}, avg(CAST(is_answer AS INT)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY {by}, item_id ORDER BY pred DESC, pos) AS nth FROM te) WHERE nth = 1 GROUP BY ALL),
sw AS (SELECT {by}, i, count(*) FILTER (WHERE label_bin = 1 AND pred > i / 1000.0::DOUBLE) AS tp, count(*) FILTER (WHERE label_bin = 1) AS p, count(*) FILTER (WHERE label_bin <> 1 AND NOT pred > i / 1000.0::DOUBLE) AS tn, count(*) FILTER (WHERE label_bin <> 1) AS q
  FROM sc, range(0, 1001) AS t(i) WHERE split = 'valid' GROUP BY ALL),
tu AS (SELECT {by}, i / 1000.0::DOUBLE AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({share}, 12) DESC, i) AS nth FROM sw) WHERE nth = 1),
ap AS (SELECT {by}, threshold, count(*) FILTER (WHERE label_bin = 1 AND pred > threshold) AS tp, count(*) FILTER (WHERE label_bin = 1) AS p, count(*) FILTER (WHERE label_bin <> 1 AND NOT pred > threshold) AS tn, count(*) FILTER (WHERE label_bin <> 1) AS q
  FROM te JOIN tu USING (system, task, grp) WHERE task IN ({of('tuned')}) GROUP BY ALL),
lo AS (SELECT {by}, 'pearson' || tag AS metric, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS value FROM xy GROUP BY {by}, tag
UNION ALL SELECT {by}, 'spearman' || tag, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) FROM ra GROUP BY {by}, tag
UNION ALL SELECT {by}, 'kendall' || tag, s / nullif(sqrt((n * (n - 1) / 2 - kx.t) * (n * (n - 1) / 2 - ky.t)), 0) FROM ks JOIN kn USING (system, task, grp, tag) JOIN kx USING (system, task, grp, tag) JOIN ky USING (system, task, grp, tag)
UNION ALL SELECT {by}, 'auc', {half} / nullif(count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y <> 1), 0) FROM au GROUP BY {by}
UNION ALL SELECT {by}, 'f1', coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) FROM cm WHERE task IN ({of('f1')})
UNION ALL SELECT {by}, 'accuracy', (tp + tn) / (tp + fp + fn + tn)::DOUBLE FROM cm WHERE task IN ({of('accuracy')})
UNION ALL SELECT {by}, 'mcc', coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) FROM cm WHERE task IN ({of('mcc')})
UNION ALL SELECT system, task, replace(grp, '#', ''), 'accuracy', (tp + tn) / (tp + fp + fn + tn)::DOUBLE FROM cm WHERE grp LIKE '%#'
UNION ALL SELECT {by}, 'accuracy', v FROM th WHERE task IN ({of('three_way')}) UNION ALL SELECT {by}, 'micro_f1', v FROM th WHERE task IN ({of('micro_f1')})
UNION ALL SELECT {by}, 'accuracy', v FROM ch WHERE task IN ({of('choice')})
UNION ALL SELECT {by}, 'balanced_accuracy', {share} FROM ap UNION ALL SELECT {by}, 'threshold', threshold FROM ap),
report AS (SELECT {by}, metric, round(value, 6) + 0.0 AS value FROM lo)"""


@query("benchmark_report", f"WITH {report_sql(ALL, {'default': 'c'})} SELECT * FROM report")
def benchmark_report(spark, d):
    return rounded(bm.run_benchmark(bench_tables(spark, d)), "value")


TWO = ("paws", "true_paws")


@query("benchmark_systems", f"""
WITH {report_sql(TWO, {'plain': 'c', 'flipped': '1 - c'})}
SELECT system, task, grp, max(value) FILTER (WHERE metric = 'f1') AS f1, max(value) FILTER (WHERE metric = 'accuracy') AS accuracy, max(value) FILTER (WHERE metric = 'auc') AS auc FROM report GROUP BY ALL""")
def benchmark_systems(spark, d):
    """Two checkpoints on two tasks, as a wide table."""
    raw = bench_tables(spark, d)
    flipped = lambda pairs: score_pairs(pairs).withColumn("bin", 1 - F.col("bin"))
    out = bm.run_benchmark({n: raw[n] for n in TWO}, {"plain": score_pairs, "flipped": flipped})
    return rounded(rp.wide_metrics(out, ["system", "task", "grp"], ["f1", "accuracy", "auc"]), "f1", "accuracy", "auc")
