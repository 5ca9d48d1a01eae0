"""Queries over turns, budgets, splits and samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.catalog.registry import (
    ORACLES,
    AS_QUESTIONS, SENTENCES, TOKENS, TURNS, WORDS, as_questions, query, table, turns,
)
from turnloom.catalog.texts import FRACTION, NAIVE, OPENERS, STRIP
from turnloom.functions import dialogue as dg
from turnloom.functions import text as tx
from turnloom.operators import budget as bg
from turnloom.operators import sampling as sm
from turnloom.operators import turns as tn
from turnloom.plans import corpus as cp
from turnloom.sources import readers, sinks
from turnloom.session import fresh_dir

big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)


def papers(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("paper_id"), F.col("source").alias("paper_title"), F.col("text").alias("paper_text"), "lang"
    )


def examples_sql(role: str, budget: int, source: str = "turns") -> str:
    return f"""r AS (SELECT conv_id, author, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
    CAST(len({TOKENS.format('text')}) AS BIGINT) AS n FROM {source}),
g AS (SELECT conv_id, list(author ORDER BY pos) AS au, list(text ORDER BY pos) AS tx, list({{'s': n, 'k': [pos]}} ORDER BY pos) AS it
  FROM r WHERE pos < 40 GROUP BY 1),
x AS (SELECT *, i FROM g, LATERAL (SELECT unnest(range(0, len(au) - 1)) AS i)),
p AS (SELECT conv_id, i, au, tx, list_reduce(list_reverse(it[1:i + 1]), lambda a, b: CASE WHEN a.s + b.s <= {budget}
    THEN {{'s': a.s + b.s, 'k': list_concat(b.k, a.k)}} ELSE a END, {{'s': 0::BIGINT, 'k': []::BIGINT[]}}) AS h
  FROM x WHERE au[i + 2] = '{role}')"""


HISTORY_MD5 = """md5(array_to_string(list_transform(h.k, lambda j: CASE WHEN au[j + 1] = '{}' THEN 'assistant:' ELSE 'user:' END || tx[j + 1]), chr(1)))"""


@query("turn_examples", f"""
WITH {TURNS}, {examples_sql('Journalist', 150)}
SELECT conv_id, CAST(i AS BIGINT) AS example, CAST(len(h.k) AS BIGINT) AS n_history, CAST(h.s AS BIGINT) AS history_tokens,
  {HISTORY_MD5.format('Journalist')} AS history_md5, md5(tx[i + 2]) AS completion_md5 FROM p""")
def turn_examples(spark, d):
    ex = tn.turn_examples(turns(spark, d), "Journalist", token_budget=150)
    history = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\x01")
    return ex.select(
        "conv_id", big(F.col("example")).alias("example"), big(F.size("prompt")).alias("n_history"),
        big(F.col("history_tokens")).alias("history_tokens"), F.md5(history).alias("history_md5"), F.md5("completion").alias("completion_md5"),
    )


LEAD = """list_reduce(list_transform({ss}, lambda s: {{'u': CAST(len({tok}) AS BIGINT), 'k': 1, 'f': false}}),
  lambda a, b: CASE WHEN a.f OR {over} THEN {{'u': a.u, 'k': a.k, 'f': true}} ELSE {{'u': a.u + b.u, 'k': a.k + 1, 'f': false}} END,
  {{'u': 0::BIGINT, 'k': 0, 'f': false}}).k"""


def lead_sql(ss: str, over: str) -> str:
    return LEAD.format(ss=ss, tok=TOKENS.format("s"), over=over)


@query("training_examples", f"""
WITH {TURNS}, {examples_sql('Journalist', 1000)},
s AS (SELECT doc_id, source, {SENTENCES.format('text')} AS ss FROM documents),
b AS (SELECT doc_id, source, array_to_string(ss[1:{lead_sql('ss', 'a.u + b.u > 1000')}], ' ') AS paper FROM s)
SELECT conv_id AS paper_id, CAST(i AS BIGINT) AS example, CAST(len(h.k) + 2 AS BIGINT) AS n_messages,
  md5('[PAPER-TITLE]' || chr(10) || source || chr(10) || '[PAPER]' || chr(10) || paper) AS paper_md5,
  {HISTORY_MD5.format('Journalist')} AS history_md5, md5(tx[i + 2]) AS completion_md5
FROM p JOIN b ON p.conv_id = b.doc_id""")
def training_examples(spark, d):
    rows = turns(spark, d).withColumnRenamed("conv_id", "paper_id")
    ex = cp.training_examples(rows, papers(spark, d), "Journalist")
    history = dg.history_of(F.col("prompt"))
    history = F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\x01")
    return ex.select(
        "paper_id", big(F.col("example")).alias("example"), big(F.size("prompt")).alias("n_messages"),
        F.md5(F.col("prompt")[1]["content"]).alias("paper_md5"), F.md5(history).alias("history_md5"),
        F.md5(F.col("completion")[0]["content"]).alias("completion_md5"),
    )


@query("sentence_budgets", f"""
WITH s AS (SELECT doc_id, text, {SENTENCES.format('text')} AS ss, len({TOKENS.format('text')}) AS n FROM documents)
SELECT doc_id, md5(CASE WHEN n <= 100 THEN text ELSE array_to_string(ss[1:{lead_sql('ss', 'a.u + b.u > 100')}], ' ') END) AS truncated_md5,
  md5(array_to_string(ss[1:{lead_sql('ss', 'a.u >= 100')}], ' ') || ' ') AS context_md5 FROM s""")
def sentence_budgets(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(bg.leading_sentences(t, 100)).alias("truncated_md5"),
        F.md5(bg.leading_sentences(t, 100, include_crossing=True)).alias("context_md5"),
    )


@query("paper_contexts", f"""
WITH s AS (SELECT doc_id, text, {SENTENCES.format('text')} AS ss FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN array_to_string(ss[1:{lead_sql('ss', 'a.u >= 200')}], ' ') || ' '
  WHEN doc_id % 3 = 1 THEN CASE WHEN len(ss) > 1 THEN ss[2] || chr(10) || ss[1] ELSE ss[1] END
  ELSE array_to_string(({WORDS.format('text')})[1:1000], ' ') END) AS context_md5 FROM s""")
def paper_contexts(spark, d):
    ss = tx.sentences(F.col("text"))
    names = F.when(F.col("doc_id") % 3 == 1, F.when(F.size(ss) > 1, F.array(F.lit("1. Introduction"), F.lit("ABSTRACT"))).otherwise(F.array(F.lit("1. Introduction")))).when(
        F.col("doc_id") % 3 == 2, F.array(F.lit("Methods"))
    )
    context = bg.paper_context(F.col("names"), F.col("ss"), F.col("text"), limit=200)
    return table(spark, d, "documents").withColumn("ss", ss).withColumn("names", names).select("doc_id", F.md5(context).alias("context_md5"))


CHUNKS = f"""s AS (SELECT {{key}}, {SENTENCES.format('text')} AS ss, len({WORDS.format('text')}) AS w FROM documents),
z AS (SELECT *, greatest(len(ss) // (w // 350 + 1), 1) AS per FROM s)"""


@query("sentence_chunks", f"""
WITH {CHUNKS.format(key='doc_id')}
SELECT doc_id, CAST(c AS BIGINT) AS chunk, md5(array_to_string(ss[c * per + 1 : (c + 1) * per], ' ')) AS chunk_md5
FROM z, LATERAL (SELECT unnest(range(0, CAST(ceil(len(ss) / per) AS BIGINT))) AS c)""")
def sentence_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(bg.sentence_chunks(F.col("text"))).alias("chunk", "c"))
    return rows.select("doc_id", big(F.col("chunk")).alias("chunk"), F.md5("c").alias("chunk_md5"))


@query("length_gate", f"""
WITH n AS (SELECT CAST(len({TOKENS.format('text')}) AS BIGINT) AS n FROM documents)
SELECT count(*) AS rows_before, max(n) AS max_before, count(*) FILTER (WHERE n < 300) AS rows_after, max(n) FILTER (WHERE n < 300) AS max_after FROM n""")
def length_gate(spark, d):
    report = bg.budget_report(table(spark, d, "documents"), "text", 300)
    return report.select(*[big(F.col(c)).alias(c) for c in report.columns])


@query("conversation_lengths", f"""
WITH c AS (SELECT role, conv_id, sum(len({WORDS.format('text')})) AS n FROM conversations GROUP BY 1, 2)
SELECT role, round(avg(n), 6) AS mean_words, count(*) AS n_conversations FROM c GROUP BY 1""")
def conversation_lengths(spark, d):
    out = tn.conversation_lengths(table(spark, d, "conversations"), "role")
    return out.withColumn("mean_words", r6(F.col("mean_words")))


def asked_sql(text: str) -> str:
    return rf"""len(list_filter(list_transform({NAIVE.format(text)}, lambda s: {STRIP.format('s')}),
  lambda s: s LIKE '%?' OR regexp_matches(lower(s), '^({OPENERS})([^\p{{L}}\p{{N}}_]|$)')))"""


@query("question_behaviour", f"""
WITH {TURNS}, q AS (SELECT author, conv_id, turn, {AS_QUESTIONS.format('text')} AS x FROM turns),
t AS (SELECT author, conv_id, {asked_sql('x')} AS n FROM q),
c AS (SELECT author, conv_id, string_agg(x, chr(10) || chr(10) ORDER BY turn) AS x FROM q GROUP BY 1, 2),
v AS (SELECT author, avg({asked_sql('x')}) AS m FROM c GROUP BY 1)
SELECT t.author, round(count(*) FILTER (WHERE n = 0) / count(*), 6) AS turns_without_question, round(sum(n) / count(*), 6) AS questions_per_turn,
  round(any_value(m), 6) AS questions_per_conversation FROM t JOIN v USING (author) GROUP BY 1""")
def question_behaviour(spark, d):
    rows = turns(spark, d).withColumn("text", as_questions("text"))
    out = tn.question_behaviour(rows, "author", rounded=False)
    return out.select("author", *[r6(F.col(c)).alias(c) for c in out.columns[1:]])


@query("split_by_paper", """
WITH k AS (SELECT DISTINCT l_partkey FROM lineitem),
r AS (SELECT l_partkey, row_number() OVER (ORDER BY md5('123|' || l_partkey)) AS rn, count(*) OVER () AS n FROM k)
SELECT CASE WHEN rn <= floor(n * 0.9) THEN 'train' ELSE 'test' END AS split, l_partkey AS paper_id, count(*) AS n_rows
FROM lineitem JOIN r USING (l_partkey) GROUP BY 1, 2""")
def split_by_paper(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("paper_id"))
    return sm.split_by_key(rows, "paper_id").groupBy("split", "paper_id").agg(F.count("*").alias("n_rows"))


@query("leaked_keys", "SELECT l_partkey AS paper_id FROM lineitem WHERE false")
def leaked_keys(spark, d):
    rows = sm.split_by_key(table(spark, d, "lineitem").select(F.col("l_partkey").alias("paper_id")), "paper_id")
    return sm.shared_keys(rows.where("split = 'train'"), rows.where("split = 'test'"), "paper_id")


@query("row_split", f"""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('42|' || event_id)) AS rn, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN rn <= floor(n * 0.9) THEN 'train' ELSE 'test' END AS exact,
  CASE WHEN {FRACTION.format("'42|' || event_id")} < 0.9 THEN 'train' ELSE 'test' END AS split FROM r""")
def row_split(spark, d):
    rows = table(spark, d, "events").select("event_id")
    return sm.split_by_fraction(sm.split_rows(rows, "event_id", seed=42, column="exact"), "event_id", seed=42)


@query("sampled_rows", "SELECT event_id, event_type FROM events ORDER BY md5('7|' || event_id) LIMIT 500")
def sampled_rows(spark, d):
    return sm.sample_rows(table(spark, d, "events").select("event_id", "event_type"), 500, "event_id", 7)


@query("head_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def head_rows(spark, d):
    return sm.head_rows(table(spark, d, "documents").select("doc_id", "lang"), 50, "doc_id")


@query("capped_groups", """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('5|' || event_id)) AS rn FROM events)
SELECT event_id, event_type FROM r WHERE rn <= 1500""")
def capped_groups(spark, d):
    return sm.cap_per_group(table(spark, d, "events").select("event_id", "event_type"), "event_type", 1500, "event_id", 5)


@query("first_share", """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, rn <= 700 AS in_first_700 FROM r WHERE rn <= floor(n * 0.4)""")
def first_share(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    share = sm.first_per_group(rows, "event_type", 0.4, "event_id")
    head = sm.first_per_group(rows, "event_type", 700, "event_id").select("event_id", F.lit(True).alias("hit"))
    return share.join(head, "event_id", "left").select("event_id", "event_type", F.coalesce("hit", F.lit(False)).alias("in_first_700"))


@query("shuffled_rows", "SELECT event_id, row_number() OVER (ORDER BY md5('3|' || event_id)) AS place FROM events")
def shuffled_rows(spark, d):
    path = fresh_dir(spark, "shuffled")
    sinks.save(sm.shuffled(table(spark, d, "events").select("event_id"), "event_id", 3), path)
    # the written order: files by name, rows by their place in a file
    rows = spark.read.schema("event_id long").parquet(path).select("event_id", "_metadata.file_name", F.col("_metadata.row_index").alias("at"))
    ranged = rows.groupBy("file_name").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows.join(ranged.select("file_name", before.alias("before")), "file_name").select("event_id", (F.col("before") + F.col("at") + 1).alias("place"))


@query("group_sizes", "SELECT source, count(*) AS n_rows, least(count(*), 40) AS n_capped FROM documents GROUP BY 1")
def group_sizes(spark, d):
    return sm.group_sizes(table(spark, d, "documents"), "source", 40)


@query("random_peers", """
WITH p AS (SELECT doc_id, source, md5(text) AS m, row_number() OVER (PARTITION BY source ORDER BY md5('1|' || doc_id)) - 1 AS ix, count(*) OVER (PARTITION BY source) AS n FROM documents),
w AS (SELECT doc_id, source, ('0x' || substr(md5('1-draw|' || doc_id), 1, 15))::BIGINT % n AS draw FROM p WHERE doc_id % 2 = 0)
SELECT d.doc_id, d.source, p.m AS peer_md5 FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN p ON p.source = w.source AND p.ix = w.draw""")
def random_peers(spark, d):
    rows = table(spark, d, "documents")
    out = sm.random_peer(rows, "source", "doc_id", F.md5("text"), "peer_md5", F.col("doc_id") % 2 == 0, 1)
    return out.select("doc_id", "source", "peer_md5")


@query("first_turns", """
SELECT conv_id, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1""")
def first_turns(spark, d):
    return tn.first_per_key(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "role", F.md5("text").alias("text_md5"))


@query("evaluation_sample", f"""
WITH {TURNS}, f AS (SELECT conv_id, min(turn) AS turn FROM turns GROUP BY 1),
c AS (SELECT o_custkey AS conv_id, o_orderpriority AS topic, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT f.conv_id AS paper_id, f.turn AS example, topic FROM f JOIN c ON f.conv_id = c.conv_id AND rn = 1 ORDER BY md5('9|' || f.conv_id) LIMIT 30""")
def evaluation_sample(spark, d):
    examples = turns(spark, d).select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("example"))
    corpus = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("row_no"), F.col("o_orderpriority").alias("topic"))
    return cp.evaluation_sample(examples, corpus, 30, seed=9)


@query("missing_lookups", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_lookups(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tn.missing_keys(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey")


@query("member_rows", """
SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY md5('2|' || doc_id) LIMIT 200)""")
def member_rows(spark, d):
    ids = sm.sample_rows(table(spark, d, "documents").select("doc_id"), 200, "doc_id", 2)
    return cp.members(table(spark, d, "labels"), ids, "doc_id")


@query("selected_papers", f"""
WITH s AS (SELECT doc_id, quality, toxic, source, {SENTENCES.format('text')} AS ss FROM documents JOIN labels USING (doc_id)),
k AS (SELECT *, 3 + 2 * quality - toxic AS clarity, 1 + doc_id % 3 AS sci, 1 + doc_id % 4 AS soc FROM s)
SELECT doc_id AS id, CAST(clarity AS BIGINT) AS clarity, (sci + soc) / 2.0 AS avg_quality_score,
  md5(array_to_string(ss[1:{lead_sql('ss', 'a.u >= 300')}], ' ') || ' ') AS context_md5
FROM k WHERE clarity >= 4 AND (sci + soc) / 2.0 > 2""")
def selected_papers(spark, d, source=None):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "source", F.col("text").alias("sc_article"),
        F.lit(None).cast("array<string>").alias("sc_section_names"), F.lit(None).cast("array<string>").alias("sc_sections"),
    )
    grid = F.expr(
        "stack(3, 'clarity', bigint(3 + 2 * quality - toxic), 'scientific', 1 + doc_id % 3, 'societal', 1 + doc_id % 4) as (aspect, score)"
    )
    scores = table(spark, d, "labels").selectExpr("doc_id as id", "doc_id", "quality", "toxic").select("id", grid)
    scores = scores.withColumn("score", F.col("score").cast("string"))
    out = cp.select_papers(docs, scores, limit=300, source=source)
    return out.select("id", big(F.col("clarity")).alias("clarity"), "avg_quality_score", F.md5("sc_intro").alias("context_md5"))


@query("selected_source", ORACLES["selected_papers"] + " AND source = 'src3'")
def selected_source(spark, d):
    return selected_papers(spark, d, "src3")


@query("training_tables", f"""
WITH {TURNS}, pa AS (SELECT doc_id, row_number() OVER (ORDER BY md5('123|' || doc_id)) <= floor(count(*) OVER () * 0.9) AS seen FROM documents),
r AS (SELECT conv_id, author, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM turns),
e AS (SELECT conv_id AS paper_id, author AS role, rn - 2 AS example, seen FROM r JOIN pa ON conv_id = doc_id WHERE rn BETWEEN 2 AND 40),
k AS (SELECT paper_id, row_number() OVER (ORDER BY md5('123|' || paper_id)) <= floor(count(*) OVER () * 0.9) AS train FROM (SELECT DISTINCT paper_id FROM e WHERE seen AND role = 'Journalist'))
SELECT role, CASE WHEN train THEN 'train' ELSE 'test' END AS split, paper_id, example FROM e JOIN k USING (paper_id) WHERE seen AND role = 'Journalist'
UNION ALL SELECT role, 'held_out', paper_id, example FROM e WHERE NOT seen""")
def training_tables(spark, d):
    rows = turns(spark, d).withColumnRenamed("conv_id", "paper_id")
    path = fresh_dir(spark, "training")
    sinks.save_splits(cp.training_tables(rows, papers(spark, d)), path)
    parts = [readers.named_split(spark, path, s) for s in ("train", "test", "held_out")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return cp.pruned(out, ("role", "split", "paper_id", "example")).withColumn("example", big(F.col("example")))


@query("stored_configs", "SELECT doc_id, source FROM documents WHERE lang = 'fr' AND doc_id % 2 = 0")
def stored_configs(spark, d):
    path = fresh_dir(spark, "configs")
    split = F.when(F.col("doc_id") % 2 == 0, "test").otherwise("train").alias("split")
    table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("config"), split).write.partitionBy("config", "split").parquet(path)
    return readers.named_split(spark, path, "test", "fr").drop("split", "config")


@query("stored_results", """
SELECT 'results' AS kind, lang AS system, doc_id AS item, n_chars::DOUBLE AS value FROM documents UNION ALL SELECT 'metrics', event_type, NULL, round(avg(value), 6) FROM events GROUP BY event_type
UNION ALL SELECT 'metrics again', event_type, NULL, round(max(value), 6) FROM events GROUP BY event_type UNION ALL SELECT 'arrays', lang, doc_id, n_chars FROM documents""")
def stored_results(spark, d):
    """Result lines by system, metrics appended twice, and one JSON array per file."""
    base = fresh_dir(spark, "results")
    docs = table(spark, d, "documents").select(F.col("lang").alias("system"), F.col("doc_id").alias("item"), F.col("n_chars").cast("double").alias("value"))
    sinks.save_results(docs, f"{base}/results")
    schema = "system string, item long, value double"
    found = [readers.json_lines(spark, f"{base}/results", schema).withColumn("kind", F.lit("results"))]
    for kind, value in (("metrics", F.avg("value")), ("metrics again", F.max("value"))):
        means = table(spark, d, "events").groupBy(F.col("event_type").alias("system")).agg(F.round(value, 6).alias("value"))
        sinks.save_metrics(means.withColumn("kind", F.lit(kind)), f"{base}/metrics")
    found.append(readers.columnar(spark, f"{base}/metrics").withColumn("item", F.lit(None).cast("long")))
    # an array for some hundred documents: their number grows with the table
    arrays = docs.groupBy("system", F.floor(F.col("item") / 200)).agg(F.to_json(F.collect_list(F.struct("system", "item", "value"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{base}/arrays")
    found.append(readers.json_any(spark, f"{base}/arrays", schema).withColumn("kind", F.lit("arrays")))
    out = found[0].select("kind", "system", "item", "value")
    for part in found[1:]:
        out = out.unionByName(part)
    return out


@query("relabelled_roles", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Researcher' WHEN 'assistant' THEN 'Journalist' ELSE role END AS author FROM conversations")
def relabelled_roles(spark, d):
    named = dg.relabel(F.col("role"), {"user": "Researcher", "assistant": "Journalist"})
    return table(spark, d, "conversations").select("conv_id", "turn", named.alias("author"))


@query("overlapping_titles", "SELECT doc_id, md5(text) AS title FROM documents WHERE source < 'src2' AND text IN (SELECT text FROM documents WHERE source >= 'src2')")
def overlapping_titles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("title"))
    return cp.overlapping_titles(docs.where("source < 'src2'"), docs.where("source >= 'src2'"), "title").select("doc_id", "title")


@query("stored_splits", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('123|' || doc_id)) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, lang FROM r WHERE rn > floor(n * 0.9)""")
def stored_splits(spark, d):
    path = fresh_dir(spark, "splits")
    sinks.save_splits(sm.split_rows(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), path)
    return readers.named_split(spark, path, "test").drop("split")


@query("stored_text_tables", """
SELECT 'delimited' AS format, doc_id, md5(text) AS text_md5 FROM documents
UNION ALL SELECT 'lines', doc_id, md5(text) FROM documents""")
def stored_text_tables(spark, d):
    base = fresh_dir(spark, "tables")
    rows = table(spark, d, "documents").select("doc_id", "text")
    rows.write.csv(f"{base}/part.tsv", sep="\t", header=True, quote='"', escape='"')
    rows.write.json(f"{base}/part.json")
    schema = "doc_id bigint, text string"
    one = readers.delimited(spark, f"{base}/part.tsv", schema, line_breaks=True)
    two = readers.json_any(spark, f"{base}/part.json", schema)
    out = one.withColumn("format", F.lit("delimited")).unionByName(two.withColumn("format", F.lit("lines")))
    return out.select("format", "doc_id", F.md5("text").alias("text_md5"))


@query("experiment_registry", """
SELECT 'short' AS system, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE n_chars < 1000
UNION ALL SELECT 'long', count(*), sum(n_chars)::BIGINT FROM documents WHERE n_chars >= 1000""")
def experiment_registry(spark, d):
    base = fresh_dir(spark, "experiments")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    sinks.save(docs.where("n_chars < 1000"), f"{base}/short")
    sinks.save(docs.where("n_chars >= 1000"), f"{base}/long")
    rows = readers.experiments(spark, {"short": f"{base}/short", "long": f"{base}/long"})
    return rows.groupBy("system").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query("annotation_export", """
SELECT c_custkey AS sc_title, 'a' || o_orderkey % 3 AS annotator, max(CASE WHEN o_orderkey % 2 = 0 THEN 'model-l' ELSE 'model-r' END) AS clarity,
  max(o_orderpriority) AS clarity_comment FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, o_orderkey, annotator""")
def annotation_export(spark, d):
    o = table(spark, d, "orders")
    results = F.array(
        F.struct(F.lit("pairwise").alias("type"), F.lit("clarity").alias("to_name"),
                 F.struct(F.when(F.col("o_orderkey") % 2 == 0, "left").otherwise("right").alias("selected"), F.lit(None).cast("string").alias("text")).alias("value")),
        F.struct(F.lit("textarea").alias("type"), F.lit("clarity").alias("to_name"),
                 F.struct(F.lit(None).cast("string").alias("selected"), F.col("o_orderpriority").alias("text")).alias("value")),
    )
    email = F.concat(F.lit("a"), (F.col("o_orderkey") % 3).cast("string"))
    ann = F.array(F.struct(F.struct(email.alias("email")).alias("completed_by"), results.alias("result")))
    tasks = o.select(F.struct(F.col("o_custkey").alias("sc_title"), F.col("o_orderkey").alias("order")).alias("data"), ann.alias("annotations"))
    out = readers.annotations(tasks, {"left": "model-l", "right": "model-r"}, ["clarity"])
    return out.drop("order")


@query("keyed_documents", """
SELECT l_orderkey AS id, 'src' || l_orderkey AS src, 'sys' || l_linenumber AS system, 's' || max(l_partkey) AS sys_summ, max(l_tax) AS fact
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def keyed_documents(spark, d):
    entry = F.struct(
        F.concat(F.lit("sys"), "l_linenumber").alias("key"),
        F.struct(F.concat(F.lit("s"), "l_partkey").alias("sys_summ"), F.struct(F.col("l_tax").alias("fact")).alias("scores")).alias("value"),
    )
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("l_partkey"), F.max("l_tax").alias("l_tax")
    )
    docs = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.map_from_entries(F.collect_list(entry)).alias("sys_summs"))
    return readers.keyed_documents(docs.withColumn("src", F.concat(F.lit("src"), F.col("id").cast("string"))))
