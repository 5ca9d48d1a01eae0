"""Queries over training pairs, samples and benchmark tasks. Raw dataset tables are derived from documents."""

from functools import reduce

from pyspark.sql import functions as F

from turnloom.catalog.registry import SENTENCES, STRIP, WORDS, query, table
from turnloom.catalog.similarity import RAKE, summary_sql
from turnloom.catalog.texts import FRACTION, MASKED, deleted_sql
from turnloom.functions import text as tx
from turnloom.plans import pairs as pr
from turnloom.plans import shaping as sh
from turnloom.session import durable, fresh_dir
from turnloom.sources import readers, sinks

big = lambda c: c.cast("bigint")


def base(spark, d, columns=()):
    """Sentences of a document as raw material: s1, s2, s3 and the words of the text; ``columns`` are all that is stored, if given."""
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    # joined before a text is cut: only the text itself is shuffled
    rows = docs.join(labels, "doc_id", "left").withColumn("ss", tx.sentences(F.col("text"))).withColumn("ws", tx.words(F.col("text")))
    pick = lambda i: F.coalesce(F.get("ss", F.lit(i)), F.lit(""))
    made = rows.select(
        F.col("doc_id").alias("row_id"), "text", "source", "lang", "ss", "ws", pick(0).alias("s1"), pick(1).alias("s2"), pick(2).alias("s3"),
        (F.col("doc_id") % 3).cast("int").alias("y3"), (F.col("doc_id") % 2).cast("int").alias("y2"), (F.col("doc_id") % 6).cast("double").alias("y6"),
        F.coalesce("quality", F.lit(0)).alias("quality"),
    )
    # stored once: every dataset reads the columns that it needs
    return durable(made.select(*columns) if columns else made)


BASE = f"""d0 AS (SELECT *, {SENTENCES.format('text')} AS ss, {WORDS.format('text')} AS ws FROM documents),
base AS (SELECT d0.doc_id AS row_id, text, source, lang, ss, ws, coalesce(ss[1], '') AS s1, coalesce(ss[2], '') AS s2, coalesce(ss[3], '') AS s3, d0.doc_id % 3 AS y3, d0.doc_id % 2 AS y2,
  CAST(d0.doc_id % 6 AS DOUBLE) AS y6, coalesce(quality, 0) AS quality FROM d0 LEFT JOIN labels USING (doc_id))"""


def shown(pairs):
    return pairs.select(
        "dataset", "task", "row_id", F.md5("text_a").alias("a_md5"), F.md5(F.array_join("text_b", "|")).alias("b_md5"),
        F.md5(F.array_join("text_c", "|")).alias("c_md5"), "orig_label",
    )


def line(name: str, a: str, b: str, c: str, y: str, source: str = "base", row: str = "row_id::VARCHAR") -> str:
    return f"SELECT '{name}' AS dataset, '{KIND[name]}' AS task, {row} AS row_id, md5({a}) AS a_md5, md5({b}) AS b_md5, md5({c}) AS c_md5, CAST({y} AS DOUBLE) AS orig_label FROM {source}"


def union(*lines: str) -> str:
    return f"WITH {BASE} " + " UNION ALL ".join(lines)


NLI_SETS = ("mnli", "anli_r1", "anli_r2", "anli_r3", "snli")
SENTENCE_SETS = ("paws", "paws_val", "paws_unlabeled", "mrpc", "mrpc_val")
WMT_SETS = tuple(f"wmt{y}" for y in (15, 16, 17, 18, 19))
CHOICE_SETS = ("race", "race_val", "race_test", "quail", "sciq", "boolq", "strategy_qa")
# the task of every dataset
KIND = {
    **dict.fromkeys(NLI_SETS, "nli"), **dict.fromkeys((*SENTENCE_SETS, "qqp", "qqp_val", "paws_qqp"), "paraphrase"), **dict.fromkeys(WMT_SETS, "wmt"),
    **dict.fromkeys(("nli_fever", "vitaminc"), "fact_checking"), "doc_nli": "bin_nli", "stsb": "sts", "sick": "sts", **dict.fromkeys((*CHOICE_SETS, "eraser_multi_rc"), "qa"), "gap": "coreference", "msmarco": "ir",
}


def raw_plain(spark, d, b=None):
    b = base(spark, d) if b is None else b
    wrapped = lambda c: F.concat(F.lit("b'"), c, F.lit("'"))
    pair = lambda one, two, label: b.select("row_id", F.col("s1").alias(one), F.col("s2").alias(two), label)
    fact = F.when(F.col("y3") == 0, "SUPPORTS").when(F.col("y3") == 1, "REFUTES").otherwise("NOT ENOUGH INFO")
    return {
        **dict.fromkeys(NLI_SETS, pair("premise", "hypothesis", F.col("y3").alias("label"))),
        **dict.fromkeys(SENTENCE_SETS, pair("sentence1", "sentence2", F.col("y2").alias("label"))),
        **dict.fromkeys(("qqp", "qqp_val"), b.select("row_id", F.col("s2").alias("question1"), F.col("s3").alias("question2"), F.col("y2").alias("label"))),
        "paws_qqp": b.select("row_id", wrapped("s1").alias("sentence1"), wrapped("s2").alias("sentence2"), F.col("y2").alias("label")),
        **dict.fromkeys(WMT_SETS, b.select("row_id", F.col("s1").alias("ref"), F.col("s3").alias("mt"), F.col("y6").alias("score"))),
        "nli_fever": b.select("row_id", F.col("text").alias("context"), F.col("s1").alias("query"), fact.alias("label")),
        "vitaminc": b.select("row_id", F.col("text").alias("evidence"), F.col("s2").alias("claim"), fact.alias("label")),
        "doc_nli": b.select("row_id", F.col("text").alias("premise"), F.col("s1").alias("hypothesis"), F.when(F.col("y2") == 1, "entailment").otherwise("not_entailment").alias("label")),
        "eraser_multi_rc": b.select("row_id", F.col("text").alias("passage"), F.concat("s1", F.lit("|| "), "s2").alias("query_and_answer"), F.col("y2").alias("label")),
        "stsb": pair("sentence1", "sentence2", F.col("y6").alias("label")),
        "sick": pair("sentence_A", "sentence_B", F.col("y6").alias("relatedness_score")),
    }


FACTS = "CASE y3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END"


@query("plain_pairs", union(
    *[line(n, "s1", "s2", "''", "y3") for n in NLI_SETS], *[line(n, "s1", "s2", "''", "y2") for n in (*SENTENCE_SETS, "paws_qqp")], *[line(n, "s2", "s3", "''", "y2") for n in ("qqp", "qqp_val")],
    *[line(n, "s1", "s3", "''", "y6") for n in WMT_SETS], line("nli_fever", "text", "s1", "''", FACTS), line("vitaminc", "text", "s2", "''", FACTS),
    line("doc_nli", "text", "s1", "''", "y2"), line("eraser_multi_rc", "text", "replace(s1 || '|| ' || s2, '|', '')", "''", "y2"), *[line(n, "s1", "s2", "''", "y6 / 5.0") for n in ("stsb", "sick")],
))
def plain_pairs(spark, d):
    return shown(pr.build_all(raw_plain(spark, d)))


GAPPED = "CASE WHEN y2 = 0 THEN replace(s1, ' ', ' _ ') ELSE s1 END"


def raw_choice(spark, d, b=None):
    b = (base(spark, d) if b is None else b).withColumn("q", F.when(F.col("y2") == 0, F.replace("s1", F.lit(" "), F.lit(" _ "))).otherwise(F.col("s1")))
    letter = F.when(F.col("y2") == 0, "A").otherwise("C")
    race = b.select("row_id", F.col("text").alias("article"), F.col("q").alias("question"), F.array("lang", "source", "s3").alias("options"), letter.alias("answer"))
    return {
        "race": race,
        "race_val": race,
        "race_test": race,
        "quail": b.select("row_id", F.col("text").alias("context"), F.col("s1").alias("question"), F.array("lang", "source", "s3").alias("answers"), F.col("y3").alias("correct_answer_id")),
        "sciq": b.select("row_id", F.col("text").alias("support"), F.col("s1").alias("question"), F.col("lang").alias("distractor1"), F.col("source").alias("distractor2"), F.col("s3").alias("distractor3"), F.col("s2").alias("correct_answer")),
        "boolq": b.select("row_id", F.col("text").alias("passage"), F.col("s1").alias("question"), (F.col("y2") == 1).alias("answer")),
        "strategy_qa": b.select("row_id", F.array("s1", "s2").alias("facts"), F.col("s3").alias("question"), (F.col("y2") == 1).alias("answer")),
        "gap": b.select("row_id", F.col("text").alias("Text"), F.lit("xx").alias("Pronoun"), F.lit(0).alias("Pronoun_offset"), F.col("lang").alias("A"), F.col("source").alias("B"), (F.col("y2") == 1).alias("A_coref"), (F.col("y2") == 0).alias("B_coref")),
        "msmarco": b.select("row_id", F.col("s3").alias("query"), F.array(F.col("y2"), F.lit(0)).alias("is_selected"), F.array("s1", "s2").alias("passage_text")),
    }


FILLED = "array_to_string(" + WORDS.format("replace(q, '_', ' ' || o || ' ')") + ", ' ')"
OPTIONS = f"(SELECT *, {GAPPED} AS q, unnest([lang, source, s3]) AS o, unnest([0, 1, 2]) AS pos FROM base)"


@query("choice_pairs", union(
    *[line(n, "text", f"CASE WHEN contains(q, '_') THEN {FILLED} ELSE q END", "CASE WHEN contains(q, '_') THEN '' ELSE o END", "pos = CASE WHEN y2 = 0 THEN 0 ELSE 2 END", OPTIONS) for n in ("race", "race_test")],
    line("race_val", "text", f"CASE WHEN contains(q, '_') THEN {FILLED} ELSE q || ' ' || o END", "''", "pos = CASE WHEN y2 = 0 THEN 0 ELSE 2 END", OPTIONS),
    line("quail", "text", "s1", "o", "pos = y3", OPTIONS),
    line("sciq", "text", "s1", "o", "pos = 3", "(SELECT *, unnest([lang, source, s3, s2]) AS o, unnest([0, 1, 2, 3]) AS pos FROM base)"),
    line("boolq", "text", "s1", "CASE WHEN (y2 = 1) = (pos = 1) THEN 'Yes.' ELSE 'No.' END", "pos", "(SELECT *, unnest([1, 0]) AS pos FROM base)"),
    line("strategy_qa", "s1 || ' ' || s2", "s3", "CASE WHEN (y2 = 1) = (pos = 1) THEN 'Yes.' ELSE 'No.' END", "pos", "(SELECT *, unnest([1, 0]) AS pos FROM base)"),
    line("gap", "text", "o || text[3:]", "''", "pos = y2", "(SELECT *, unnest([lang, source]) AS o, unnest([1, 0]) AS pos FROM base)"),
    line("msmarco", "o", "s3", "''", "pos", "(SELECT *, unnest([s1, s2]) AS o, unnest([1, 0]) AS pos FROM base WHERE y2 = 1)"),
))
def choice_pairs(spark, d):
    return shown(pr.build_all(raw_choice(spark, d)))


def raw_answers(spark, d):
    b = base(spark, d, ["row_id", "text", "lang", "s1", "s2", "s3", "y3", "y2", F.get("ws", F.lit(0)).alias("w1")])
    answers = F.when(F.col("y3") == 0, F.array().cast("array<string>")).otherwise(F.array("s2", "w1"))
    qa = b.select("row_id", F.col("text").alias("context"), F.col("s1").alias("question"), answers.alias("answers"))
    story = b.select(
        "row_id", F.when(F.col("y2") == 1, "train").otherwise("dev").alias("type"), "text",
        F.array(F.struct(F.col("s1").alias("q"), F.lit(0.2).alias("isQuestionBad"), F.struct(F.lit(0).alias("s"), F.lit(4).alias("e")).alias("consensus")),
                F.struct(F.col("s2").alias("q"), F.lit(0.3).alias("isQuestionBad"), F.struct(F.lit(0).alias("s"), F.lit(4).alias("e")).alias("consensus"))).alias("questions"),
    )
    hop = b.select("row_id", F.col("s3").alias("question"), F.col("lang").alias("answer"), F.array(F.lit("t1")).alias("supporting_titles"),
                   F.array(F.lit("t1"), F.lit("t2")).alias("titles"), F.array(F.array("s1"), F.array("s2", "s3")).alias("sentences"))
    return {
        "squad_v2_new": qa, "quoref": qa, "adversarial_qa": qa, "squad_v2": qa, "squad": qa, "newsqa": story, "hotpot_qa_distractor": hop, "hotpot_qa_fullwiki": hop,
        "drop": qa.select("row_id", F.col("context").alias("passage"), "question", F.col("answers").alias("answers_spans")),
        **dict.fromkeys(("duorc_self", "duorc_paraphrase"), qa.select("row_id", F.col("context").alias("plot"), "question", "answers")),
        "ropes": qa.select("row_id", F.col("context").alias("situation"), F.col("question").alias("background"), "question", "answers"),
    }


def answered(name: str, a: str, b: str, n: str, y: str, c: str = "NULL", source: str = "base", row: str = "row_id::VARCHAR") -> str:
    return f"SELECT '{name}' AS dataset, {row} AS row_id, md5({a}) AS a_md5, md5({b}) AS b_md5, {n} AS n_c, {c} AS c_md5, CAST({y} AS DOUBLE) AS orig_label FROM {source}"


GIVEN = "md5(s2 || coalesce('|' || ws[1], ''))"
HOP = "CASE WHEN md5('0-order|' || row_id || '|0') < md5('0-order|' || row_id || '|1') THEN s1 || chr(10) || s2 || s3 ELSE s2 || s3 || chr(10) || s1 END"
ALWAYS = ("quoref", "adversarial_qa", "drop", "duorc_self", "duorc_paraphrase")


# a made-up answer is the first word that is left when the given answers, the longer one first, are deleted
LONGER, SHORTER = ("CASE WHEN length(s2) {} length(coalesce(ws[1], '')) THEN s2 ELSE coalesce(ws[1], '') END".format(sign) for sign in (">=", "<"))
SITUATION = "(text || ' ' || s1)"
HOPS = ("hotpot_qa_distractor", "hotpot_qa_fullwiki")
MADE_UP = "md5(coalesce({}[1], 'no answer'))"


def made_up_sql(name: str, context: str, left: str, row: str = "row_id::VARCHAR", question: str = "s1") -> str:
    return answered(name, context, question, "1", "0", MADE_UP.format("lf.left"), f"base JOIN {left} lf USING (row_id)", row)


@query("answer_pairs", f"WITH {BASE}, r AS (SELECT * FROM base WHERE y3 <> 0), n AS (SELECT * FROM base WHERE y3 = 0), " + ", ".join([
    f"m1 AS MATERIALIZED (SELECT row_id, {deleted_sql('text', LONGER)} AS t, s2, ws FROM r)",
    f"lt AS MATERIALIZED (SELECT row_id, {WORDS.format(deleted_sql('t', SHORTER))} AS left FROM m1 UNION ALL SELECT row_id, ws AS left FROM n)",
    f"m2 AS MATERIALIZED (SELECT row_id, {deleted_sql(SITUATION, LONGER)} AS t, s2, ws FROM r)",
    f"lr AS MATERIALIZED (SELECT row_id, {WORDS.format(deleted_sql('t', SHORTER))} AS left FROM m2 UNION ALL SELECT row_id, {WORDS.format(SITUATION)} AS left FROM n)",
    f"ln AS MATERIALIZED (SELECT row_id, {WORDS.format(deleted_sql('text', STRIP.format('text[1:4]')))} AS left FROM base WHERE y2 = 1)",
    f"hp AS (SELECT row_id, lang, {HOP} AS t FROM base)", f"lh AS MATERIALIZED (SELECT row_id, {WORDS.format(deleted_sql('t', 'lang'))} AS left FROM hp) ",
]) + " UNION ALL ".join([
    answered("squad_v2_new", "text", "s1", "2", "1", GIVEN, "r"), answered("squad_v2_new", "text", "s1", "1", "0", MADE_UP.format("ws"), "n"),
    *[answered(n, "text", "s1", "2", "1", GIVEN, "r") for n in ALWAYS], *[made_up_sql(n, "text", "lt") for n in ALWAYS],
    answered("ropes", "text || ' ' || s1", "s1", "2", "1", GIVEN, "r"), made_up_sql("ropes", "text || ' ' || s1", "lr"),
    answered("newsqa", "text", "s1", "1", "1", f"md5({STRIP.format('text[1:4]')})", "base WHERE y2 = 1", "row_id || '-0'"), made_up_sql("newsqa", "text", "ln", "row_id || '-0'"),
    answered("squad_v2", "text", "s1 || ' ' || s2", "0", "1", "md5('')", "r"), answered("squad_v2", "text", "s1 || ' ' || ws[-1]", "0", "0", "md5('')", "n"),
    *[answered(n, HOP, "s3", "1", "1", "md5(lang)") for n in HOPS], *[made_up_sql(n, HOP, "lh", question="s3") for n in HOPS],
]))
def answer_pairs(spark, d):
    """Given answers and made-up ones alike."""
    raw = raw_answers(spark, d)
    raw.pop("squad")
    out = pr.build_all(raw)
    return out.select(
        "dataset", "row_id", F.md5("text_a").alias("a_md5"), F.md5(F.array_join("text_b", "|")).alias("b_md5"), F.size("text_c").alias("n_c"),
        F.md5(F.array_join("text_c", "|")).alias("c_md5"), "orig_label",
    )


def grams_sql(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) + {2 - n}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


def hits_sql(n: int) -> str:
    """Grams of ``h`` that a reference holds, each as often as the reference that has it most often."""
    count = lambda grams: f"len(list_filter({grams}, lambda x: x = g))"
    most = f"greatest({count(grams_sql('r1', n))}, {count(grams_sql('r2', n))})"
    return f"list_sum(list_transform(list_distinct({grams_sql('h', n)}), lambda g: least({count(grams_sql('h', n))}, {most})))"


@query("key_phrase_pairs", f"""
WITH {RAKE}, {BASE}, g AS (SELECT base.*, rank, phrase, string_split(phrase, ' ') AS h, CASE WHEN y3 = 0 THEN [] ELSE {WORDS.format('lower(s2)')} END AS r1,
  CASE WHEN y3 = 0 THEN [] ELSE [lower(ws[1])] END AS r2 FROM base LEFT JOIN (SELECT * FROM r WHERE rank <= 5) ON row_id = doc_id),
k AS (SELECT *, {hits_sql(1)} AS h1, {hits_sql(2)} AS h2, {hits_sql(3)} AS h3, CASE WHEN (abs(len(r1) - len(h)), len(r1)) < (abs(len(r2) - len(h)), len(r2)) THEN len(r1) ELSE len(r2) END AS near FROM g),
b AS (SELECT *, CASE WHEN h1 > 0 AND h2 > 0 AND h3 > 0 THEN least(1, exp(1 - near / len(h))) * exp(0.33 * ln(h1 / len(h)) + 0.33 * ln(h2 / (len(h) - 1)) + 0.33 * ln(h3 / (len(h) - 2))) ELSE 0 END AS bleu FROM k)
SELECT 'squad' AS dataset, 'extractive_qa' AS task, row_id::VARCHAR AS row_id, md5(text) AS a_md5, md5(CASE WHEN y3 = 0 THEN '' ELSE s1 || ' ' || s2 || '|' || s1 || ' ' || ws[1] END) AS b_md5,
  md5(coalesce(string_agg(s1 || ' ' || phrase, '|' ORDER BY rank) FILTER (bleu < 0.6 AND phrase IS NOT NULL), '')) AS c_md5, -1.0::DOUBLE AS orig_label FROM b GROUP BY row_id, text, y3, s1, s2, ws""")
def key_phrase_pairs(spark, d):
    return shown(pr.build_pairs("squad", raw_answers(spark, d)["squad"]))


def corrupted_sql(name: str, source: str, text: str, tag: str) -> str:
    """CTEs up to ``name(row_id, bad)``: a quarter of the words, the first by digest, replaced by the word behind them."""
    draw = f"md5('{tag}|' || row_id || '|' || (i - 1))"
    return f"""{name}w AS (SELECT row_id, {WORDS.format(text)} AS ws FROM {source}),
{name}c AS (SELECT row_id, ws, CAST(floor(len(ws) * 0.25) AS INT) AS n, list_sort(list_transform(ws, lambda w, i: {draw}))[CAST(floor(len(ws) * 0.25) AS INT)] AS cut FROM {name}w),
{name} AS (SELECT row_id, array_to_string(list_transform(ws, lambda w, i: CASE WHEN n > 0 AND {draw} <= cut THEN ws[i % len(ws) + 1] ELSE w END), ' ') AS bad FROM {name}c)"""


SUMMARY_SETS = ("xsum", "cnndm", "wikihow")


@query("summary_pairs", f"""
WITH {BASE}, {summary_sql('base', 'row_id', 'text')}, {corrupted_sql('gold', 'base', 's1', 'gold')}, {corrupted_sql('ex', 'sm', 'summary', 'extract')},
u AS (SELECT row_id, text, s1, summary, gold.bad AS b1, ex.bad AS b2 FROM base JOIN sm USING (row_id) JOIN gold USING (row_id) JOIN ex USING (row_id))
SELECT unnest({list(SUMMARY_SETS)}) AS dataset, 'summarization' AS task, row_id::VARCHAR AS row_id, md5(text) AS a_md5, md5(s1 || '|' || summary) AS b_md5, md5(b1 || '|' || b2) AS c_md5, -1.0::DOUBLE AS orig_label FROM u""")
def summary_pairs(spark, d):
    rows = base(spark, d, ["row_id", "text", "s1"])
    named = lambda text, short: rows.select("row_id", F.col("text").alias(text), F.col("s1").alias(short))
    return shown(pr.build_all({"xsum": named("document", "summary"), "cnndm": named("article", "highlights"), "wikihow": named("text", "headline")}))


@query("paraphrase_pairs", f"""
WITH t AS (SELECT doc_id, source, text, {WORDS.format('text')} AS ws FROM documents),
h AS (SELECT *, CAST(floor(len(ws) * 0.25) AS INT) AS n, list_sort(list_transform(ws, lambda w, i: md5('gold|' || doc_id || '|' || (i - 1)))) AS hs FROM t),
c AS (SELECT *, hs[n] AS cut FROM h), m AS (SELECT doc_id, source, text, ws, {MASKED.replace("'7|'", "'gold|'")} AS ms FROM c),
b AS (SELECT doc_id, source, text, array_to_string(list_transform(ms, lambda w, i: CASE WHEN w = '[MASK]' THEN ws[i % len(ws) + 1] ELSE w END), ' ') AS bad FROM m)
SELECT doc_id::VARCHAR AS row_id, md5(source) AS a_md5, md5(text) AS b_md5, 1.0::DOUBLE AS orig_label FROM b UNION ALL SELECT doc_id::VARCHAR, md5(source), md5(bad), 0 FROM b""")
def paraphrase_pairs(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("original_sent"), F.col("text").alias("paraphrase"))
    return shown(pr.build_pairs("wiki103", rows)).select("row_id", "a_md5", "b_md5", "orig_label")


TASKS = ("nli", "fact_checking", "paraphrase", "bin_nli", "qa", "coreference", "ir", "summarization", "multiple_choice_qa", "extractive_qa", "wmt", "sts", "ctc")


def sample_pairs(spark, d):
    """Documents as pairs of all task kinds; half of the drawn tasks' rows have no wrong texts of their own."""
    b = base(spark, d)
    task = F.element_at(F.array(*[F.lit(t) for t in TASKS]), (F.col("row_id") % len(TASKS) + 1).cast("int"))
    none = F.array().cast("array<string>")
    return b.select(
        F.col("row_id").alias("row_no"), F.col("lang").alias("dataset"), task.alias("task"), F.col("s1").alias("text_a"), F.array("s2", "s3").alias("text_b"),
        F.when(F.col("y2") == 1, F.array("source", "lang")).otherwise(none).alias("text_c"), (F.col("row_id") % 4 - 1).cast("double").alias("orig_label"),
    )


def draw(name: str) -> str:
    return FRACTION.format(f"'0-{name}|' || row_no")


def index(name: str, n: str) -> str:
    return f"(('0x' || substr(md5('0-{name}|' || row_no), 1, 15))::BIGINT % {n} + 1)"


SAMPLES = f"""sp AS (SELECT row_id AS row_no, lang AS dataset, [{', '.join(f"'{t}'" for t in TASKS)}][row_id % {len(TASKS)} + 1] AS task, s1 AS text_a, [s2, s3] AS text_b,
  CASE WHEN y2 = 1 THEN [source, lang] ELSE [] END AS text_c, CAST(row_id % 4 - 1 AS DOUBLE) AS y FROM base),
dr AS (SELECT *, {draw('align')} > 0.95 AS al, {draw('swap')} > 0.95 AS sw, {draw('positive')} > 0.5 AS pos FROM sp),
ix AS (SELECT task, text_b[1] AS peer, row_number() OVER (PARTITION BY task ORDER BY md5('0-peer|' || row_no)) - 1 AS ix, count(*) OVER (PARTITION BY task) AS n FROM sp),
nt AS (SELECT task, count(*) AS n FROM sp GROUP BY 1),
pe AS (SELECT dr.*, ix.peer FROM dr JOIN nt USING (task) LEFT JOIN ix ON ix.task = dr.task AND ix.ix = ('0x' || substr(md5('0-peer-draw|' || row_no), 1, 15))::BIGINT % nt.n),
k AS (SELECT *, task IN ('nli', 'fact_checking') AS tri, task IN ('summarization', 'multiple_choice_qa', 'extractive_qa') AS drawn FROM pe),
f AS (SELECT *, al AND (tri OR task = 'paraphrase') AS sa, NOT al AND sw AND ((tri AND y = 2) OR task = 'paraphrase') AS ss FROM k),
o AS (SELECT row_no, dataset, task, CASE WHEN ss THEN text_b[1] ELSE text_a END AS a,
  CASE WHEN drawn THEN CASE WHEN pos THEN CASE WHEN task = 'multiple_choice_qa' THEN text_b[1] ELSE text_b[{index('right', 2)}] END
    ELSE CASE WHEN len(text_c) > 0 THEN text_c[{index('wrong', 2)}] ELSE peer END END
  WHEN task IN ('qa', 'coreference') THEN CASE WHEN len(text_c) > 0 THEN text_b[1] || ' ' || text_c[1] ELSE text_b[1] END
  WHEN task = 'ir' THEN text_b[{index('query', 2)}] WHEN sa OR ss THEN text_a ELSE text_b[1] END AS b,
  CAST(CASE WHEN drawn THEN pos::INT WHEN task IN ('bin_nli', 'paraphrase', 'qa', 'coreference', 'ir') THEN CASE WHEN sa THEN 1 ELSE y END ELSE -100 END AS INT) AS align_label,
  CAST(CASE WHEN tri THEN CASE WHEN sa THEN 0 WHEN y = -1 THEN 1 ELSE y END ELSE -100 END AS INT) AS tri_label,
  CASE WHEN task IN ('wmt', 'sts', 'ctc') THEN y ELSE -100.0 END AS reg_label FROM f)"""


@query("training_samples", f"WITH {BASE}, {SAMPLES} SELECT row_no, task, md5(a) AS a_md5, md5(b) AS b_md5, align_label, tri_label, CAST(reg_label AS DOUBLE) AS reg_label FROM o")
def training_samples(spark, d):
    out = sh.training_samples(sample_pairs(spark, d), 0, "row_no")
    return out.select("row_no", "task", F.md5("text_a").alias("a_md5"), F.md5("text_b").alias("b_md5"), "align_label", "tri_label", "reg_label")


SHOWN_SAMPLE = "md5(a) AS a_md5, md5(b) AS b_md5, align_label, tri_label, CAST(reg_label AS DOUBLE) AS reg_label"


def sample_columns():
    return [F.md5("text_a").alias("a_md5"), F.md5("text_b").alias("b_md5"), "align_label", "tri_label", "reg_label"]


@query("mixed_corpus", f"""
WITH {BASE}, cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || row_id)) AS rn FROM base) WHERE rn <= 120),
cut AS (SELECT row_id, row_number() OVER (ORDER BY md5('0|' || row_id)) AS p, count(*) OVER () AS n FROM cap), {SAMPLES.replace("FROM base)", "FROM cap)")}
SELECT row_no, dataset, task, CASE WHEN p <= floor(n * 0.95) THEN 'train' ELSE 'test' END AS split, {SHOWN_SAMPLE} FROM o JOIN cut ON o.row_no = cut.row_id""")
def mixed_corpus(spark, d):
    out = sh.mixed_corpus(sample_pairs(spark, d), cap=120)
    return out.select("row_no", "dataset", "task", "split", *sample_columns())


@query("limited_corpus", f"""
WITH {BASE}, cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY lang) AS n_all FROM base)
  WHERE (lang = 'en' AND rn <= floor(n_all * 0.5)) OR (lang = 'fr' AND rn <= 30)), {SAMPLES.replace("FROM base)", "FROM cap)")}
SELECT row_no, dataset, task, {SHOWN_SAMPLE} FROM o""")
def limited_corpus(spark, d):
    out = sh.mixed_corpus(sample_pairs(spark, d), {"en": 0.5, "fr": 30})
    return out.select("row_no", "dataset", "task", *sample_columns())


FLAT = r"regexp_replace({}, '\s+', ' ', 'g')"


@query("registered_datasets", union(
    line("mnli", "s1", "s2", "''", "y3"), line("paws", "s1", "s2", "''", "y2"), line("paws_qqp", FLAT.format("s1"), FLAT.format("s2"), "''", "y2"),
    line("wmt15", "s1", "s3", "''", "y6"), line("doc_nli", "text", "s1", "''", "y2"),
))
def registered_datasets(spark, d):
    """Raw files in each format of the registry, read by the dataset's name: partitions by split and by configuration, TSV, JSON lines and a JSON array."""
    raw = raw_plain(spark, d)
    flat = lambda c: F.regexp_replace(c, r"\s+", " ").alias(c)
    at = {n: fresh_dir(spark, n) for n in ("mnli", "paws", "paws_qqp", "wmt15", "doc_nli")}
    placed = lambda df, **named: df.withColumns({k: F.lit(v) for k, v in named.items()})
    splits = placed(raw["mnli"], split="train").unionByName(placed(raw["mnli"], split="test"))
    splits.write.partitionBy("split").parquet(at["mnli"])
    configs = [placed(raw["paws"], split=s, config=c) for s, c in (("train", "labeled_final"), ("train", "unlabeled_final"), ("test", "labeled_final"))]
    reduce(lambda a, b: a.unionByName(b), configs).write.partitionBy("split", "config").parquet(at["paws"])
    raw["paws_qqp"].select("row_id", flat("sentence1"), flat("sentence2"), "label").write.csv(at["paws_qqp"], header=True, sep="\t", quote='"', escape='"')
    raw["wmt15"].write.json(at["wmt15"])
    # arrays of 500 rows, each a file
    arrays = raw["doc_nli"].groupBy(F.floor(F.col("row_id") / 500).alias("part")).agg(F.to_json(F.collect_list(F.struct("row_id", "premise", "hypothesis", "label"))).alias("value"))
    arrays.write.partitionBy("part").text(at["doc_nli"])
    schemas = {
        "mnli": "row_id long, premise string, hypothesis string, label int, split string, config string",
        "paws": "row_id long, sentence1 string, sentence2 string, label int, split string, config string",
        "paws_qqp": "row_id long, sentence1 string, sentence2 string, label int", "wmt15": "row_id long, ref string, mt string, score double",
        "doc_nli": "row_id long, premise string, hypothesis string, label string",
    }
    return shown(pr.build_all({n: pr.read_dataset(spark, n, at[n], schemas[n]) for n in at}))


@query("published_pairs", union(line("mnli", "s1", "s2", "''", "y3")))
def published_pairs(spark, d):
    """A version is published, a reader opens it, a second version takes the name; the reader goes on with the first."""
    pairs = pr.build_pairs("mnli", raw_plain(spark, d)["mnli"])
    half = F.pmod(F.xxhash64("row_id"), F.lit(2)) == 0
    sinks.publish(pairs.where(half), "turnloom_pairs")
    earlier = spark.table("turnloom_pairs")
    sinks.publish(pairs.where(~half), "turnloom_pairs")
    return shown(earlier.unionByName(spark.table("turnloom_pairs")))


@query("stored_pairs", union(line("mnli", "s1", "s2", "''", "y3")).replace("'nli' AS task", "'nli' AS task"))
def stored_pairs(spark, d):
    path = fresh_dir(spark, "pairs")
    sinks.save_pairs(pr.build_pairs("mnli", raw_plain(spark, d)["mnli"]), path)
    schema = "task string, row_id string, text_a string, text_b array<string>, text_c array<string>, orig_label double, dataset string"
    return shown(readers.json_lines(spark, path, schema))
