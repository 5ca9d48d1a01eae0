"""Named queries of this subpackage over the shared tables, each with the equivalent SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import (
    bpe,
    chat,
    exact_dedup,
    filter_audit,
    lexical_search,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    sharding,
    simhash,
    toxicity,
    winnowing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash_dedup")
def simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", "links")


@query("op2_mixing")
def mixed(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.taken_words(table(spark, folder, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "pieces")


WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(
    "op3_line_dedup",
    f"""
    WITH raw AS (SELECT doc_id, pos - 1 AS pos, lines[pos] AS line
                 FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
    w AS (SELECT doc_id, pos, {WORDS.format("line")} AS words FROM raw),
    m AS (SELECT *, list_transform(words, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS masked FROM w WHERE len(words) >= 1),
    g AS (SELECT *, NOT list_contains(masked, '<*>') OR len(list_filter(masked, lambda x: x <> '<*>' AND regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) > 0 AS general FROM m),
    l AS (SELECT doc_id, pos, CASE WHEN general THEN masked ELSE words END AS words, general FROM g),
    k AS (SELECT *, array_to_string(words, ' ') AS line, CASE WHEN general THEN len(words) || ' ' || array_to_string(words[1:3], ' ') END AS leaf FROM l),
    d AS (SELECT leaf, line, any_value(words) AS words, min(doc_id) AS a, max(doc_id) AS b FROM k WHERE leaf IS NOT NULL GROUP BY ALL),
    s AS (SELECT leaf FROM d GROUP BY leaf HAVING count(*) > 1 AND min(a) < max(b)),
    t AS (SELECT leaf, line, unnest(words) AS word, unnest(range(len(words))) AS place FROM d WHERE leaf IN (FROM s)),
    c AS (SELECT leaf, place, word, row_number() OVER (PARTITION BY leaf, place ORDER BY count(*) DESC, word) AS nth FROM t GROUP BY leaf, place, word),
    ag AS (SELECT t.leaf, t.line FROM t JOIN c ON t.leaf = c.leaf AND t.place = c.place AND c.nth = 1
           GROUP BY ALL HAVING count(*) FILTER (t.word = c.word) >= 0.8 * count(*)),
    o AS (SELECT doc_id, pos, coalesce('leaf ' || ag.leaf, 'line ' || k.line) AS template FROM k LEFT JOIN ag ON k.leaf = ag.leaf AND k.line = ag.line),
    r AS (SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER v < max(doc_id) OVER v AS again,
                 row_number() OVER (PARTITION BY template ORDER BY doc_id, pos) AS nth FROM o WINDOW v AS (PARTITION BY template))
          WHERE again AND nth > 1),
    x AS (SELECT raw.doc_id, count(r.pos) AS n_dropped,
                 coalesce(string_agg(CASE WHEN r.pos IS NULL THEN raw.line END, chr(10) ORDER BY raw.pos), '') AS text
          FROM raw LEFT JOIN r ON raw.doc_id = r.doc_id AND raw.pos = r.pos GROUP BY raw.doc_id)
    SELECT documents.doc_id, coalesce(len(string_split(documents.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(x.n_dropped, 0)::BIGINT AS n_dropped,
           CASE WHEN documents.text IS NOT NULL THEN x.text END AS text
    FROM documents LEFT JOIN x ON documents.doc_id = x.doc_id
    """,
)
def lines_dropped(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, folder, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", "text")


# The checksum of UTF-8 bytes as SQL folds it: 256 table entries by their rule, then one step per byte.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'),"
    " lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])))::BIGINT"
)


@query(
    "op4_sharding",
    f"""
    WITH tab AS (SELECT {CRC_TABLE} AS tab),
    k AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size, {CRC.format(text="coalesce(text, '')")} AS text_crc32,
                 md5('7:' || coalesce(doc_id::VARCHAR, 'none')) AS key FROM documents, tab),
    r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) - 0.5::DOUBLE)
                    / count(*) OVER (PARTITION BY source) AS fraction FROM k),
    p AS (SELECT *, row_number() OVER (ORDER BY fraction, key, doc_id, text_crc32, size, source) - 1 AS position, count(*) OVER () AS n FROM r),
    s AS (SELECT *, (position * 40) // n AS shard FROM p)
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard,
           (position - (shard * n + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
    """,
)
def sharded(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.interleave(table(spark, folder, "documents"), shards=40, seed=7)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op5_exact_dedup",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY text)
    """,
)
def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


@query("op6_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query("op7_toxicity")
def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3)


def rank_file() -> tuple[str, str]:
    """Path of the rank file and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op8_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    done = docs.select("doc_id", bpe.round_trip(F.col("text"), spark, *rank_file()).alias("r"))
    return done.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


@query(
    "op9_chat_rotation",
    """
    WITH p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS DISTINCT FROM 'system'),
    j AS (SELECT m.conv_id, p.perspective, m.turn, m.role AS speaker, coalesce(m.text, '') AS text,
                 CASE WHEN m.role = 'system' THEN 'system' WHEN m.role IS NOT DISTINCT FROM p.perspective THEN 'assistant' ELSE 'user' END AS role
          FROM conversations m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
    h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN coalesce(' name=' || speaker, '') ELSE '' END || chr(10) AS head FROM j),
    s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
    o AS (SELECT *, row_number() OVER w - 1 AS position, (sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) - length(segment))::BIGINT AS start
          FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker NULLS FIRST, text))
    SELECT conv_id, perspective, position, turn, role, CASE WHEN role = 'user' THEN speaker END AS name, segment, start,
           CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
           CASE WHEN role = 'assistant' THEN start + length(segment) - 1 END AS mask_end
    FROM o
    """,
)
def chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(table(spark, folder, "conversations"))


@query("op10_winnowing")
def winnowed(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.compare_neighbours(table(spark, folder, "documents"))


# A-Z only; the functions for whole alphabets change other letters too
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_ngram_join",
    f"""
    WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
    s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                 lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    e AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
    p AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n
          HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    c(r, far) AS (SELECT r, r FROM s UNION SELECT c.r, l.b FROM c JOIN l ON c.far = l.a)
    SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(o.doc_id) AS component_id
    FROM s JOIN c ON s.r = c.r JOIN s o ON c.far = o.r GROUP BY s.r
    """,
)
def ngram_links(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, folder, "documents"))


TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op12_lexical_search",
    f"""
    WITH q AS (SELECT DISTINCT item_id, unnest({TERMS.format(LOWER.format("text"))}) AS term FROM benchmark),
    d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS.format(LOWER.format("text"))} AS terms FROM documents),
    t AS (SELECT r, unnest(terms) AS term FROM d),
    tf AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, term),
    c AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(c.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term),
    m AS (SELECT r, doc_id, 50 + (50 * len(terms) * c.n) // c.l AS m FROM d, c WHERE len(terms) > 0),
    s AS (SELECT q.item_id, m.doc_id, m.r, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m)))::BIGINT AS score
          FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m ON tf.r = m.r GROUP BY q.item_id, m.doc_id, m.r),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS nth FROM s WHERE score > 0)
    SELECT item_id, nth::INT AS rank, doc_id, score FROM k WHERE nth <= 50
    """,
)
def best_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op13_filter_audit",
    f"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
    w AS (SELECT *, {WORDS.format("text")} AS words FROM t),
    f AS (SELECT doc_id, part, [len(words) < 100, 100 * list_unique(words) < 80 * len(words),
                 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, FALSE)] AS fails FROM w),
    lab AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    j AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN lab USING (doc_id) GROUP BY part, fails),
    x AS (SELECT unnest(range(1, 6)) AS i),
    o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a JOIN x b ON b.i <> a.i JOIN x c ON c.i NOT IN (a.i, b.i) JOIN x d ON d.i NOT IN (a.i, b.i, c.i)
          JOIN x e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
    s AS (SELECT o, i AS step, o[i] AS filter, o[1:i - 1] AS earlier FROM o, x),
    g AS (SELECT part, o, step, filter,
                 coalesce(sum(n) FILTER (NOT fails[filter] AND len(list_filter(earlier, lambda k: fails[k])) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (fails[filter] AND len(list_filter(earlier, lambda k: fails[k])) = 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (fails[filter] AND len(list_filter(earlier, lambda k: fails[k])) > 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (fails[filter] AND len(list_filter(fails, lambda k: k)) = 1), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (fails[filter] AND len(list_filter(earlier, lambda k: fails[k])) = 0), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (fails[filter] AND len(list_filter(earlier, lambda k: fails[k])) = 0), 0)::BIGINT AS toxic_lost
          FROM j, s GROUP BY part, o, step, filter)
    SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails,
           good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
    FROM g
    """,
)
def audited_filters(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
