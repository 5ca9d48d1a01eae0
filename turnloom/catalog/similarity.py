"""Queries over overlap metrics, vectors, alignment, retrieval and key phrases."""

from pyspark.sql import functions as F

from turnloom.catalog.registry import LEXICAL, SENTENCES, WORDS, query, table
from turnloom.catalog.statistics import rounded
from turnloom.functions.vectors import cosine
from turnloom.operators import alignment as al
from turnloom.operators import keyphrases as kp
from turnloom.operators import lexical as lx
from turnloom.operators import retrieval as rt
from turnloom.operators import similarity as sim
from turnloom.operators import stages as sg
from turnloom.operators import summaries as su
from turnloom.operators.ranking import running_totals
from turnloom.plans import evaluation as ev
from turnloom.session import durable

big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)


def text_pairs(spark, d):
    """Each turn against the document of its conversation."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("a"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("b"))
    return turns.join(docs, "conv_id").select(F.concat_ws("/", "conv_id", "turn").alias("item_id"), "role", "a", "b")


PAIRED = """tp AS (SELECT c.conv_id || '/' || c.turn AS item_id, c.role, d.text AS a, c.text AS b FROM conversations c JOIN documents d ON c.conv_id = d.doc_id)"""


def overlap_sql(n: int) -> str:
    gram = "ts[i]" if n == 1 else f"array_to_string(ts[i:i + {n - 1}], ' ')"
    return f"""tk AS (SELECT item_id, 'a' AS side, {LEXICAL.format('a')} AS ts FROM tp UNION ALL SELECT item_id, 'b', {LEXICAL.format('b')} FROM tp),
g AS (SELECT item_id, side, {gram} AS g FROM tk, LATERAL (SELECT unnest(range(1, len(ts) + 2 - {n})) AS i)),
c AS (SELECT item_id, g, count(*) FILTER (WHERE side = 'a') AS ca, count(*) FILTER (WHERE side = 'b') AS cb FROM g GROUP BY 1, 2),
s AS (SELECT item_id, sum(least(ca, cb)) AS o, sum(ca) AS na, sum(cb) AS nb FROM c GROUP BY 1)
SELECT item_id, round(coalesce(o / nullif(nb, 0), 0), 6) AS precision, round(coalesce(o / nullif(na, 0), 0), 6) AS recall,
  round(coalesce(2 * o / nullif(na + nb, 0), 0), 6) AS f FROM tp LEFT JOIN s USING (item_id)"""


@query("unigram_overlap", f"WITH {PAIRED}, {overlap_sql(1)}")
def unigram_overlap(spark, d):
    return rounded(lx.rouge_n(text_pairs(spark, d), 1, stem=False), "precision", "recall", "f")


@query("bigram_overlap", f"WITH {PAIRED}, {overlap_sql(2)}")
def bigram_overlap(spark, d):
    return rounded(lx.rouge_n(text_pairs(spark, d), 2, stem=False), "precision", "recall", "f")


@query("longest_common_subsequence", f"""
WITH p AS (SELECT a.conv_id || '/' || a.turn AS item_id, {LEXICAL.format('a.text')} AS x, {LEXICAL.format('b.text')} AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
l AS (SELECT item_id, len(x) AS n, len(y) AS m, list_reduce(list_transform(x, lambda t: {{'t': t, 'r': []::INT[]}}), lambda acc, e: {{'t': e.t, 'r':
  list_reduce(list_transform(range(1, len(y) + 1), lambda j: [j::INT]), lambda r, j: list_append(r, CASE WHEN y[j[1]] = e.t THEN acc.r[j[1]] + 1 ELSE greatest(acc.r[j[1] + 1], r[len(r)]) END), [0::INT])}},
  {{'t': '', 'r': list_transform(range(0, len(y) + 1), lambda j: 0::INT)}}).r[-1] AS k FROM p)
SELECT item_id, round(k / m, 6) AS precision, round(k / n, 6) AS recall, round(2 * k / (n + m), 6) AS f FROM l""")
def longest_common_subsequence(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    pairs = rows.join(after, ["conv_id", "turn"]).select(F.concat_ws("/", "conv_id", "turn").alias("item_id"), F.col("text").alias("a"), "b")
    return rounded(lx.rouge_l(pairs, stem=False), "precision", "recall", "f")


def common_sql(x: str, y: str) -> str:
    """Length of the longest common subsequence of two lists: the longest rising run of places in ``y`` of the words of ``x``."""
    places = f"list_transform(list_reverse(list_filter(range(1, len({y}) + 1), lambda j: {y}[j] = t)), lambda j: [j::INT])"
    below = "len(list_filter(acc, lambda v: v < e[1]))"
    step = f"list_concat(list_concat(acc[1:{below}], e), acc[{below} + 2:])"
    return f"len(list_reduce(flatten(list_transform({x}, lambda t: {places})), lambda acc, e: {step}, []::INT[]))"


@query("stemmed_overlap")
def stemmed_overlap(spark, d):
    return rounded(lx.rouge(text_pairs(spark, d), ("1", "2", "L")), "rouge1_f", "rouge2_f", "rougeL_f")


@query("text_similarity_report", f"""
WITH {PAIRED}, o AS (WITH {overlap_sql(1)}), k AS (SELECT item_id, {LEXICAL.format('a')} AS x, {LEXICAL.format('b')} AS y FROM tp),
l AS (SELECT item_id, coalesce(2 * {common_sql('x', 'y')} / nullif(len(x) + len(y), 0), 0) AS f FROM k)
SELECT role AS system, round_even(avg(o.f), 3) AS rouge1_f, round_even(avg(l.f), 3) AS "rougeL_f" FROM o JOIN tp USING (item_id) JOIN l USING (item_id) GROUP BY 1""")
def text_similarity_report(spark, d):
    return ev.text_similarity_report(text_pairs(spark, d).withColumnRenamed("role", "system"), ("1", "L"), stem=False)


def grid_words(column: str) -> str:
    return f"list_transform({SENTENCES.format(column)}, lambda s: {WORDS.format("replace(s, '.', ' ')")})"


def grid_sets(column: str, n: int) -> str:
    words = WORDS.format("replace(s, '.', ' ')")
    if n == 1:
        return f"list_transform({SENTENCES.format(column)}, lambda s: list_distinct({words}))"
    return (
        f"list_transform(list_transform({SENTENCES.format(column)}, lambda s: {words}), lambda w: "
        f"list_distinct(list_transform(range(1, len(w) + 2 - {n}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))))"
    )


SET_F = "coalesce(2 * len(list_intersect(p, c)) / nullif(len(p) + len(c), 0), 0)"


def grid_sql(n: int) -> str:
    return f"""WITH {PAIRED}, z AS (SELECT item_id, {grid_sets('a', n)} AS ps, {grid_sets('b', n)} AS cs FROM tp)
SELECT item_id, round(coalesce(list_avg(list_transform(cs, lambda c: list_max(list_transform(ps, lambda p: {SET_F})))), 0), 6) AS score FROM z"""


@query("sentence_grid_unigrams", grid_sql(1))
def sentence_grid_unigrams(spark, d):
    return rounded(lx.rouge_grid(text_pairs(spark, d), 1), "score")


@query("sentence_grid_bigrams", grid_sql(2))
def sentence_grid_bigrams(spark, d):
    return rounded(lx.rouge_grid(text_pairs(spark, d), 2), "score")


LONG_F = f"CASE WHEN len(p) > 0 AND len(c) > 0 THEN 2 * {common_sql('p', 'c')} / (len(p) + len(c)) ELSE 0 END"


@query("sentence_grid_subsequences", f"""
WITH {PAIRED}, z AS (SELECT item_id, {grid_words('a')} AS ps, {grid_words('b')} AS cs FROM tp)
SELECT item_id, round(coalesce(list_avg(list_transform(cs, lambda c: list_max(list_transform(ps, lambda p: {LONG_F})))), 0), 6) AS score FROM z""")
def sentence_grid_subsequences(spark, d):
    return rounded(lx.rouge_grid_l(text_pairs(spark, d)), "score")


def bleu_sql(n: int) -> str:
    return f"""WITH {PAIRED}, r AS (SELECT item_id, list_transform({SENTENCES.format('a')}, lambda s: {WORDS.format('s')}) AS ss FROM tp),
h AS (SELECT item_id, list_transform({SENTENCES.format('b')}, lambda s: {WORDS.format('s')}) AS ss FROM tp),
rs AS (SELECT item_id, i, ss[i] AS w FROM r, LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i)),
hs AS (SELECT item_id, i, ss[i] AS w FROM h, LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i)),
rg AS (SELECT item_id, i, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM rs, range(1, {n + 1}) AS o(k), LATERAL (SELECT unnest(range(1, len(w) + 2 - k)) AS j)),
hg AS (SELECT item_id, i, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM hs, range(1, {n + 1}) AS o(k), LATERAL (SELECT unnest(range(1, len(w) + 2 - k)) AS j)),
rm AS (SELECT item_id, k, g, max(c) AS c FROM (SELECT item_id, i, k, g, count(*) AS c FROM rg GROUP BY ALL) GROUP BY ALL),
hc AS (SELECT item_id, i, k, g, count(*) AS c FROM hg GROUP BY ALL),
m AS (SELECT item_id, i, k, sum(least(hc.c, coalesce(rm.c, 0))) AS hit, sum(hc.c) AS tot FROM hc LEFT JOIN rm USING (item_id, k, g) GROUP BY ALL),
lens AS (SELECT hs.item_id, hs.i, len(hs.w) AS hl, arg_min(len(rs.w), (abs(len(rs.w) - len(hs.w)) * 100000 + len(rs.w))) AS rl FROM hs JOIN rs USING (item_id) GROUP BY ALL),
q AS (SELECT item_id, i, count(*) FILTER (WHERE hit > 0) AS orders, sum(ln(hit / tot) / {n}) FILTER (WHERE hit > 0) AS ls FROM m GROUP BY ALL),
b AS (SELECT item_id, i, CASE WHEN orders = {n} THEN CASE WHEN hl > rl THEN 1 ELSE exp(1 - rl / hl) END * exp(ls) ELSE 0 END AS bleu FROM lens LEFT JOIN q USING (item_id, i))
SELECT tp.item_id, round(coalesce(avg(bleu), 0), 6) AS score FROM tp LEFT JOIN b USING (item_id) GROUP BY 1"""


@query("bleu_1", bleu_sql(1))
def bleu_1(spark, d):
    return rounded(lx.bleu(text_pairs(spark, d), 1), "score")


@query("bleu_4", bleu_sql(4))
def bleu_4(spark, d):
    return rounded(lx.bleu(text_pairs(spark, d), 4), "score")


@query("bleu_2", bleu_sql(2))
def bleu_2(spark, d):
    return rounded(lx.bleu(text_pairs(spark, d), 2), "score")


@query("bleu_3", bleu_sql(3))
def bleu_3(spark, d):
    return rounded(lx.bleu(text_pairs(spark, d), 3), "score")


@query("distinct_bigrams", f"""
WITH w AS (SELECT role, {WORDS.format('text')} AS w FROM conversations), g AS (SELECT role, w[i] || ' ' || w[i + 1] AS g FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS i))
SELECT role, count(DISTINCT g) AS n_distinct, count(*) AS n_grams, round(count(DISTINCT g) / count(*), 6) AS distinct_ratio FROM g GROUP BY 1""")
def distinct_bigrams(spark, d):
    return rounded(lx.distinct_n(table(spark, d, "conversations"), "role", n=2), "distinct_ratio")


VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query("vector_cosines", f"""WITH {VECTORS} SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vector_cosines(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(after, "vec_id").select("vec_id", r6(cosine(F.col("e"), F.col("f"))).alias("cosine"))


@query("self_redundancy", f"""
WITH {VECTORS}, m AS (SELECT a.label, a.vec_id, max(list_cosine_similarity(a.e, b.e)) AS best FROM v a LEFT JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT label, round(avg(coalesce(best, -1)), 6) AS redundancy, count(*) AS n_turns FROM m GROUP BY 1""")
def self_redundancy(spark, d):
    return rounded(sim.self_redundancy(table(spark, d, "embeddings"), "label", "vec_id"), "redundancy")


NUMBERED = "n AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 3 AS turn FROM v)"


@query("followup_scores", f"""
WITH {VECTORS}, {NUMBERED}, h AS (SELECT DISTINCT a.label, a.turn FROM n a JOIN n b ON a.label = b.label AND b.turn = a.turn + 1 WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT label, count(DISTINCT turn) AS n_turns FROM n GROUP BY 1), k AS (SELECT label, count(*) AS k FROM h GROUP BY 1)
SELECT label, n_turns, round(coalesce(k, 0) / (n_turns - 1), 6) AS followup FROM c LEFT JOIN k USING (label)""")
def followup_scores(spark, d):
    v = table(spark, d, "embeddings")
    # numbered by stretches: no task sees all vectors of a label
    placed = running_totals(v.select("label", "vec_id", F.lit(1).alias("one")), ["label"], "vec_id", ["one"])
    turns = placed.select("vec_id", F.floor(F.col("one_before") / 3).alias("turn"))
    rows = durable(v.join(turns, "vec_id"))
    return rounded(sim.followup_score(rows, rows.select("label", "turn"), "label", "turn", "vec_id", threshold=0.9), "followup")


@query("embedding_matches", f"""
WITH {VECTORS}, p AS (SELECT * FROM v WHERE vec_id % 2 = 0), c AS (SELECT * FROM v WHERE vec_id % 2 = 1), x AS (SELECT p.label, p.vec_id AS i, c.vec_id AS j, list_cosine_similarity(p.e, c.e) AS s FROM p JOIN c USING (label)),
r AS (SELECT label, avg(m) AS r FROM (SELECT label, i, max(s) AS m FROM x GROUP BY 1, 2) GROUP BY 1), q AS (SELECT label, avg(m) AS p FROM (SELECT label, j, max(s) AS m FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f FROM r JOIN q USING (label)""")
def embedding_matches(spark, d):
    v = table(spark, d, "embeddings")
    out = sim.embedding_prf(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "label", "vec_id")
    return rounded(out, "precision", "recall", "f")


def sets(column: str) -> str:
    return f"list_transform({column}, lambda s: list_distinct({LEXICAL.format('s')}))"


CONTAINED = "coalesce(len(list_intersect(c, p)) / nullif(len(c), 0), 0)"
CONTAINED_BACK = "coalesce(len(list_intersect(c, p)) / nullif(len(p), 0), 0)"


@query("alignment_scores", f"""
WITH {PAIRED}, s AS (SELECT item_id, {SENTENCES.format('a')} AS ss, len({WORDS.format('a')}) AS w, {SENTENCES.format('b')} AS cs FROM tp),
z AS (SELECT *, greatest(len(ss) // (w // 350 + 1), 1) AS per FROM s),
k AS (SELECT item_id, {sets("list_transform(range(0, CAST(ceil(len(ss) / per) AS BIGINT)), lambda i: array_to_string(ss[i * per + 1 : (i + 1) * per], ' '))")} AS ps, {sets('cs')} AS cs FROM z)
SELECT item_id, round(coalesce(list_avg(list_transform(cs, lambda c: list_max(list_transform(ps, lambda p: {CONTAINED})))), 0), 6) AS alignment FROM k""")
def alignment_scores(spark, d):
    pairs = text_pairs(spark, d).select("item_id", F.col("a").alias("premise"), F.col("b").alias("hypothesis"))
    return al.alignment_score(pairs).select("item_id", r6(F.col("alignment")).alias("alignment"))


@query("sentence_unit_scores", f"""
WITH {PAIRED}, k AS (SELECT item_id, {sets(SENTENCES.format('a'))} AS ps, {sets(SENTENCES.format('b'))} AS cs FROM tp),
m AS (SELECT item_id, coalesce(list_avg(list_transform(cs, lambda c: list_max(list_transform(ps, lambda p: {CONTAINED})))), 0) AS p,
  coalesce(list_avg(list_transform(ps, lambda p: list_max(list_transform(cs, lambda c: {CONTAINED_BACK})))), 0) AS r FROM k)
SELECT item_id, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f FROM m""")
def sentence_unit_scores(spark, d):
    pairs = text_pairs(spark, d).select("item_id", F.col("a").alias("premise"), F.col("b").alias("hypothesis"))
    return rounded(al.smart_n(pairs), "precision", "recall", "f")


SOFT_ROW = """list_reduce(list_transform(range(1, len(e.s) + 1), lambda j: [j::DOUBLE]), lambda r, j: list_append(r, greatest(
  acc.r[j[1]::INT] + e.s[j[1]::INT], acc.r[j[1]::INT + 1] + e.s[j[1]::INT], r[len(r)])), [0::DOUBLE])"""


@query("soft_subsequence_scores", f"""
WITH {PAIRED}, k AS (SELECT item_id, {sets(SENTENCES.format('a'))} AS ps, {sets(SENTENCES.format('b'))} AS cs FROM tp),
g AS (SELECT item_id, len(cs) AS n, list_transform(ps, lambda p: {{'s': list_transform(cs, lambda c: ({CONTAINED})::DOUBLE), 'r': []::DOUBLE[]}}) AS g FROM k),
l AS (SELECT item_id, len(g) AS m, list_reduce(g, lambda acc, e: {{'s': e.s, 'r': {SOFT_ROW}}}, {{'s': []::DOUBLE[], 'r': list_transform(range(0, n + 1), lambda i: 0::DOUBLE)}}).r[-1] AS v FROM g)
SELECT item_id, round(coalesce(v / nullif(m, 0), 0), 6) AS score FROM l""")
def soft_subsequence_scores(spark, d):
    pairs = text_pairs(spark, d).select("item_id", F.col("a").alias("premise"), F.col("b").alias("hypothesis"))
    return rounded(al.smart_l(pairs), "score")


@query("pair_scores", f"""
WITH {PAIRED}, k AS (SELECT item_id, list_distinct({LEXICAL.format('a')}) AS p, list_distinct({LEXICAL.format('b')}) AS c FROM tp), s AS (SELECT item_id, {CONTAINED} AS s FROM k)
SELECT item_id, round(s, 6) AS reg, round(s, 6) AS bin, round(1 - s, 6) AS contradiction FROM s""")
def pair_scores(spark, d):
    pairs = text_pairs(spark, d).select("item_id", F.col("a").alias("premise"), F.col("b").alias("hypothesis"))
    out = sg.score_pairs(pairs).select("item_id", "reg", "bin", F.col("tri")[2].alias("contradiction"))
    return rounded(out, "reg", "bin", "contradiction")


BM25 = f"""q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({LEXICAL.format('text')}) AS term FROM benchmark) GROUP BY ALL),
dt AS (SELECT doc_id, {LEXICAL.format('text')} AS ts FROM documents), dl AS (SELECT doc_id, len(ts) AS dl FROM dt), av AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), av GROUP BY 1, 2),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 100)"""


def retrieved(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rt.bm25(table(spark, d, "documents"), queries, 100)


@query("retrieved_documents", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM run")
def retrieved_documents(spark, d):
    return rounded(retrieved(spark, d), "score")


QRELS = """qr AS (SELECT doc_id % 40 AS query_id, doc_id, quality + 1 - toxic AS grade FROM labels)"""


def qrels(spark, d):
    return table(spark, d, "labels").select(
        (F.col("doc_id") % 40).alias("query_id"), "doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade")
    )


def ranking_sql(run: str) -> str:
    return f"""good AS (SELECT * FROM qr WHERE grade > 0), rel AS (SELECT query_id, count(*) AS rel FROM good GROUP BY 1),
ks AS (SELECT unnest([1, 3, 5, 10, 100, 1000]) AS k), idl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS pl FROM good),
idc AS (SELECT query_id, k, sum(grade / log2(pl + 1)) AS idcg FROM idl, ks WHERE pl <= k GROUP BY 1, 2),
j AS (SELECT r.query_id, r.rank, grade, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS found FROM {run} r JOIN good USING (query_id, doc_id)),
m AS (SELECT query_id, k, sum(grade / log2(rank + 1)) AS dcg, sum(found / rank) AS ap, count(*) AS hits FROM j, ks WHERE rank <= k GROUP BY 1, 2),
a AS (SELECT DISTINCT query_id FROM {run})
SELECT CAST(k AS INT) AS k, round(avg(coalesce(dcg, 0) / idcg), 6) AS ndcg, round(avg(coalesce(ap, 0) / rel), 6) AS map, round(avg(coalesce(hits, 0) / rel), 6) AS recall,
  round(avg(coalesce(hits, 0) / k), 6) AS precision, count(*) AS n_queries FROM rel JOIN a USING (query_id) JOIN idc USING (query_id) LEFT JOIN m USING (query_id, k) GROUP BY 1"""


@query("retrieval_metrics", f"WITH {BM25}, {QRELS}, {ranking_sql('run')}")
def retrieval_metrics(spark, d):
    out = rt.retrieval_metrics(retrieved(spark, d), qrels(spark, d))
    return rounded(out, "ndcg", "map", "recall", "precision")


@query("reranked_metrics", f"""WITH {BM25}, {QRELS},
rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM run JOIN documents USING (doc_id)), {ranking_sql('rr')}""")
def reranked_metrics(spark, d):
    run = retrieved(spark, d)
    scores = run.select("query_id", "doc_id").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id")
    out = rt.retrieval_metrics(rt.rerank(run, scores), qrels(spark, d))
    return rounded(out, "ndcg", "map", "recall", "precision")


STOPS = ", ".join(f"'{w}'" for w in kp.STOP_WORDS)


RAKE = rf"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+') AS ts FROM documents),
m AS (SELECT doc_id, array_to_string(list_transform(ts, lambda w: CASE WHEN w IN ({STOPS}) OR NOT regexp_matches(w, '^[\p{{L}}\p{{N}}_]') THEN chr(1) ELSE w END), ' ') AS s FROM t),
f AS (SELECT doc_id, list_filter(list_transform(string_split(s, chr(1)), lambda p: trim(p)), lambda p: p <> '') AS ps FROM m),
p AS (SELECT doc_id, i AS pos, ps[i] AS phrase, string_split(ps[i], ' ') AS ws FROM f, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i)),
w AS (SELECT doc_id, pos, phrase, len(ws) AS n, unnest(ws) AS w FROM p), st AS (SELECT doc_id, w, sum(n) / count(*) AS ratio FROM w GROUP BY 1, 2),
sc AS (SELECT doc_id, pos, phrase, sum(ratio) AS score FROM w JOIN st USING (doc_id, w) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase DESC, pos) AS rank FROM sc)"""


@query("key_phrases", f"WITH {RAKE} SELECT doc_id, CAST(rank AS INT) AS rank, md5(phrase) AS phrase_md5, round(score, 6) AS phrase_score FROM r WHERE rank <= 5")
def key_phrases(spark, d):
    out = kp.key_phrases(table(spark, d, "documents"), "doc_id", "text", 5)
    return out.select("doc_id", "rank", F.md5("phrase").alias("phrase_md5"), r6(F.col("phrase_score")).alias("phrase_score"))


def summary_sql(source: str, ident: str, text: str) -> str:
    """CTEs up to ``sm(ident, n, summary)``: rank of sentences by shared words in 30 rounds, the best twentieth in text order."""
    rounds = ", ".join(
        f"r{k + 1} AS (SELECT v.d, v.i, any_value(0.15::DOUBLE / v.n) + 0.85::DOUBLE * coalesce(sum(e.w * r.r / g.g), 0) AS r "
        f"FROM sv v LEFT JOIN e ON e.d = v.d AND e.i = v.i LEFT JOIN r{k} r ON r.d = e.d AND r.i = e.j LEFT JOIN g ON g.d = e.d AND g.i = e.j GROUP BY v.d, v.i)"
        for k in range(su.ROUNDS)
    )
    return f"""sl AS (SELECT {ident} AS d, {SENTENCES.format(text)} AS ss FROM {source}),
sv AS MATERIALIZED (SELECT d, i, len(ss) AS n, ss[i] AS s, log10(length(ss[i])) AS l FROM sl, LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i)),
sw AS (SELECT d, i, l, unnest(list_distinct({WORDS.format('lower(s)')})) AS w FROM sv),
e AS MATERIALIZED (SELECT a.d, a.i, b.i AS j, count(*) / any_value(a.l + b.l) AS w FROM sw a JOIN sw b ON a.d = b.d AND a.w = b.w AND a.i <> b.i WHERE a.l + b.l > 0 GROUP BY ALL),
g AS MATERIALIZED (SELECT d, i, sum(w) AS g FROM e GROUP BY ALL), r0 AS (SELECT d, i, 1.0::DOUBLE / n AS r FROM sv), {rounds},
o AS (SELECT d, i, n, s, row_number() OVER (PARTITION BY d ORDER BY round(r, 12) DESC, i) AS place FROM r{su.ROUNDS} JOIN sv USING (d, i)),
sm AS (SELECT sl.d AS {ident}, count(o.i) AS n, coalesce(string_agg(o.s, chr(10) ORDER BY o.i), '') AS summary
  FROM sl LEFT JOIN o ON sl.d = o.d AND o.place <= CASE WHEN o.n >= 20 THEN o.n // 20 WHEN o.n >= 2 THEN 1 ELSE 0 END GROUP BY sl.d)"""


@query("extractive_summaries", f"""
WITH {summary_sql('documents', 'doc_id', 'text')} SELECT doc_id, len(list_filter(string_split(summary, chr(10)), lambda s: s <> '')) AS n_lines, md5(summary) AS summary_md5 FROM sm""")
def extractive_summaries(spark, d):
    out = su.extractive_summary(table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", big(F.size(F.filter(F.split("summary", "\n"), lambda s: s != ""))).alias("n_lines"), F.md5("summary").alias("summary_md5"))


@query("hashed_embeddings", f"SELECT conv_id, turn, len({WORDS.format('text')})::DOUBLE AS n_words, true AS ok FROM conversations")
def hashed_embeddings(spark, d):
    out = sg.embed(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text")
    return out.select("conv_id", "turn", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("n_words"), F.col("embedding_error").isNull().alias("ok"))
