"""Queries that run streams over the shared tables to completion."""

from pyspark.sql import functions as F

from turnloom.catalog.corpus import examples_sql
from turnloom.catalog.judging import INPUTS, POINTS, judged_inputs, prompt_sql
from turnloom.catalog.registry import TURNS, query, table, turns
from turnloom.operators import judging as jd
from turnloom.operators import rubrics as rb
from turnloom.session import fresh_dir, path_exists
from turnloom.streaming import streams as stm

big = lambda c: c.cast("bigint")


#: Batches of a small table, and rows that a batch has on average at most: a batch is one file and one task.
BATCHES = 4
BATCH_ROWS = 1 << 20
#: Bytes of a row group in a batch's file.
ROW_GROUP = 4 << 20


def stream_of(spark, rows, end=None):
    """``rows`` as a stream of batches of equal time spans, each a file in the order of ``ts``; ``end`` is one more.

    Rows are dealt to their spans once, whatever the number of spans. Files have small row groups, so that one is read
    by many tasks.
    """
    path, dealt = fresh_dir(spark, "source"), fresh_dir(spark, "spans")
    low, high, n = rows.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    batches = max(BATCHES, -(-n // BATCH_ROWS))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else F.lit(c).cast("timestamp"))
    span = F.floor((micros("ts") - micros(low)) * batches / (micros(high) - micros(low) + 1))
    spread = rows.withColumn("_span", span).repartitionByRange("ts", F.xxhash64(*rows.columns))
    spread.write.partitionBy("_span").parquet(dealt)
    of = lambda i: spark.read.schema(rows.schema).parquet(f"{dealt}/_span={i}") if path_exists(spark, f"{dealt}/_span={i}") else rows.limit(0)
    cut = [of(i) for i in range(batches)] + ([end] if end is not None else [])
    for part in cut:
        part.coalesce(1).sortWithinPartitions("ts").write.option("parquet.block.size", ROW_GROUP).mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def events(spark, d):
    return stream_of(spark, table(spark, d, "events"))


def finished(spark, stream, schema, mode="append"):
    base = fresh_dir(spark, "stream")
    stm.run_available(stream, f"{base}/out", f"{base}/state", mode)
    done = spark.read.schema(schema).parquet(f"{base}/out")
    naive = lambda c, kind: F.col(c).cast("timestamp_ntz") if kind == "timestamp" else F.col(c)
    return done.select(*[naive(c, kind).alias(c) for c, kind in done.dtypes])


SESSIONS = """g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL {gap} THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
w AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, max(ts) + INTERVAL {gap} AS session_end, count(*) AS n_messages FROM s GROUP BY user_id, s.s)"""


@query("chat_sessions", f"""
WITH {SESSIONS.format(gap="'6 hours'")} SELECT user_id, first_ts AS session_start, session_end, n_messages, first_ts, last_ts FROM w WHERE n_messages > 1""")
def chat_sessions(spark, d):
    return stm.chat_sessions(table(spark, d, "events"), gap="6 hours")


@query("chat_session_stream", f"""
WITH {SESSIONS.format(gap="'6 hours'")} SELECT user_id, first_ts AS session_start, session_end, n_messages, first_ts, last_ts FROM w
WHERE n_messages > 1 AND session_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1 hour' FROM events)""")
def chat_session_stream(spark, d):
    out = stm.chat_sessions(events(spark, d), gap="6 hours")
    return finished(spark, out, out.schema)


@query("running_means", """
SELECT event_type, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL '1 hour' AS window_end, round(avg(value), 6) AS mean, count(*) AS n_rows FROM events
GROUP BY 1, 2 HAVING window_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1 hour' FROM events)""")
def running_means(spark, d):
    out = stm.running_means(events(spark, d), "event_type", "value")
    return finished(spark, out, out.schema).withColumn("mean", F.round("mean", 6))


SPAN = "CAST(floor((epoch_us(ts) - epoch_us(lo)) * 4 / (epoch_us(hi) - epoch_us(lo) + 1)) AS INT)"


# a key counts as seen in the next batch, and in the one after if its first row lies within twice the delay of the batch's end
@query("first_arrivals", f"""
WITH r AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), b AS (SELECT user_id, ts, {SPAN} AS b FROM events, r),
e AS (SELECT b, max(ts) AS last FROM b GROUP BY 1), f AS (SELECT user_id, b, min(ts) AS t FROM b GROUP BY 1, 2),
m AS (SELECT user_id, b, t > last - INTERVAL '2 hours' AS near FROM f JOIN e USING (b)),
p AS (SELECT user_id, bool_or(b = 0) AS p0, bool_or(b = 1) AS p1, bool_or(b = 2) AS p2, bool_or(b = 3) AS p3, bool_or(b = 0 AND near) AS n0, bool_or(b = 1 AND near) AS n1 FROM m GROUP BY 1),
x AS (SELECT *, p0 AS e0, p1 AND NOT p0 AS e1 FROM p), y AS (SELECT *, p2 AND NOT e1 AND NOT (e0 AND n0) AS e2 FROM x), z AS (SELECT *, p3 AND NOT e2 AND NOT (e1 AND n1) AS e3 FROM y)
SELECT user_id FROM z WHERE e0 UNION ALL SELECT user_id FROM z WHERE e1 UNION ALL SELECT user_id FROM z WHERE e2 UNION ALL SELECT user_id FROM z WHERE e3""")
def first_arrivals(spark, d):
    out = stm.first_arrivals(events(spark, d), "user_id").select("user_id")
    return finished(spark, out, out.schema)


@query("chat_session_documents", f"""
WITH {SESSIONS.format(gap="'6 hours'")}, t AS (SELECT s.user_id, s.s, min(s.ts) AS date, list(e.event_type ORDER BY s.ts, e.event_type) AS said FROM s JOIN events e ON e.user_id = s.user_id AND e.ts = s.ts GROUP BY 1, 2)
SELECT user_id, 'user_' || user_id || '_' || strftime(date, '%Y-%m-%d_%H-%M-%S') AS session_key, CAST(len(said) AS BIGINT) AS n_messages, array_to_string(said, ',') AS said FROM t
WHERE len(said) > 1 AND (SELECT max(ts) + INTERVAL '6 hours' FROM s s2 WHERE s2.user_id = t.user_id AND s2.s = t.s) <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1 hour' FROM events)""")
def chat_session_documents(spark, d):
    said = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    messages = events(spark, d).select("user_id", "ts", F.lit("user").alias("role"), F.col("event_type").alias("content"), said.alias("paper_title"), F.lit("text").alias("paper_text"))
    out = stm.chat_session_documents(messages, gap="6 hours")
    rows = finished(spark, out, out.schema).withColumn("m", F.from_json("session", "messages array<struct<role: string, content: string>>")["messages"])
    return rows.select("user_id", "session_key", big(F.size("m")).alias("n_messages"), F.array_join(F.col("m.content"), ",").alias("said"))


@query("turn_example_stream", f"""
WITH {TURNS}, {examples_sql('Journalist', 150)}
SELECT conv_id, CAST(i AS INT) AS example, CAST(len(h.k) AS INT) AS n_history, CAST(h.s AS INT) AS history_tokens,
  md5(array_to_string(list_transform(h.k, lambda j: tx[j + 1]), chr(1))) AS history_md5, md5(tx[i + 2]) AS completion_md5 FROM p""")
def turn_example_stream(spark, d):
    # a turn a minute; a last row far ahead moves the watermark past all others
    at = lambda turn: F.timestamp_seconds(F.lit(1_700_000_000).cast("long") + turn * 60)
    rows = turns(spark, d).select("conv_id", "turn", "author", "text", at(F.col("turn")).alias("ts"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("Researcher").alias("author"), F.lit("end").alias("text"), at(F.lit(10**7)).alias("ts"))
    out = stm.turn_example_stream(stream_of(spark, rows, end), "Journalist", token_budget=150)
    done = finished(spark, out, out.schema).where("not late")
    return done.select(
        "conv_id", "example", "n_history", "history_tokens", F.md5(F.array_join("history", "\x01")).alias("history_md5"), F.md5("completion").alias("completion_md5")
    )


@query("judged_arrivals", f"""
WITH {INPUTS}, {prompt_sql(rb.RUBRICS)} SELECT row_id, subject, aspect, CAST({POINTS} AS INT) AS score FROM pr""")
def judged_arrivals(spark, d):
    base = fresh_dir(spark, "arrivals")
    jd.build_prompts(judged_inputs(spark, d), rb.RUBRICS, ["row_id", "system"]).write.parquet(f"{base}/prompts")
    stored = spark.read.parquet(f"{base}/prompts")
    prompts = spark.readStream.schema(stored.schema).parquet(f"{base}/prompts")
    score = lambda batch: jd.run_judge(batch.withColumn("evaluator", F.lit("rule"))).drop("prompt", "reply")
    # the second run sees the same prompts again and adds nothing
    for run in ("one", "two"):
        stm.judge_arrivals(prompts, score, f"{base}/scores", f"{base}/state-{run}").awaitTermination()
    return spark.read.parquet(f"{base}/scores").select("row_id", "subject", "aspect", "score")
