"""Streaming forms of the stateful steps: examples from turns, sessions, incremental judging, running means, dedupe."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.functions import text as tx
from turnloom.sources.sinks import append_scores

EXAMPLE_SCHEMA = "conv_id long, turn int, late boolean, example int, n_history int, history_tokens int, history array<string>, completion string"
STATE_SCHEMA = (
    "seen int, turns array<string>, costs array<int>, last int,"
    " waiting array<struct<turn int, author string, content string, cost int, at long>>"
)


def turn_example_stream(
    turns: DataFrame,
    role: str,
    max_turns: int = 40,
    token_budget: int = 1000,
    tokens: tx.TokenCounter = tx.token_count,
    time: str = "ts",
    delay: str = "1 hour",
    idle_ms: int = 7 * 24 * 3600 * 1000,
) -> DataFrame:
    """Examples of ``role`` from a stream of (conv_id, turn, author, text, ``time``) rows, as in the batch form.

    Turns may arrive out of order within ``delay``: they wait in the state until the watermark has passed them and then
    go on in the order of their numbers. The first ``max_turns`` turns count by rank, whatever their numbers. A turn
    that comes after a later one has gone on is returned with ``late`` set and no example; one behind the watermark is
    in Spark's count of dropped rows. A repeated number is ignored while it waits. A conversation's state goes once the
    watermark is ``idle_ms`` past its last event, and holds ``max_turns`` texts at most besides what waits.
    """
    clean = tx.mask_names(F.col("text"))
    timed = turns.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    prepared = timed.select(
        "conv_id", F.col("turn").cast("int").alias("turn"), "author", tx.strip(clean).alias("content"),
        tokens(clean).cast("int").alias("cost"), F.unix_millis(time).alias("at"), time,
    )

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, texts, costs, last, waiting = state.get if state.exists else (0, [], [], -(1 << 31), [])
        texts, costs, waiting = list(texts), [int(c) for c in costs], [tuple(w) for w in waiting]
        passed, out = state.getCurrentWatermarkMs(), []
        known = {w[0] for w in waiting}
        for part in batches:
            for turn, author, content, cost, at in part[["turn", "author", "content", "cost", "at"]].itertuples(index=False):
                if turn <= last:
                    out.append((key[0], int(turn), True, None, None, None, None, content))
                elif turn not in known and seen < max_turns:
                    known.add(turn)
                    waiting.append((int(turn), author, content, int(cost), int(at)))
        waiting.sort()
        while waiting and waiting[0][4] <= passed and seen < max_turns:
            turn, author, content, cost, _ = waiting.pop(0)
            if author == role and seen > 0:
                kept, used = [], 0
                for i in range(len(texts) - 1, -1, -1):
                    if used + costs[i] <= token_budget:
                        used += costs[i]
                        kept.insert(0, texts[i])
                out.append((key[0], turn, False, seen - 1, len(kept), used, kept, content))
            texts.append(content)
            costs.append(cost)
            seen, last = seen + 1, turn
        if seen >= max_turns:
            texts, costs, waiting = [], [], []
        if state.hasTimedOut and not waiting and not out:
            state.remove()
        else:
            state.update((seen, texts, costs, last, waiting))
            # the timeout must lie ahead of the watermark
            state.setTimeoutTimestamp(max(waiting[0][4], passed) + 1 if waiting else passed + idle_ms)
        columns = ["conv_id", "turn", "late", "example", "n_history", "history_tokens", "history", "completion"]
        yield pd.DataFrame(out, columns=columns).astype({c: "Int32" for c in ("example", "n_history", "history_tokens")})

    return prepared.groupBy("conv_id").applyInPandasWithState(
        advance, EXAMPLE_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )


def _event_time(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarked stream (or plain batch) with an instant as event time."""
    if not rows.isStreaming:
        return rows
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def chat_sessions(
    events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Finished sessions with more than one message; works on streams (append) and on batches.

    Partial sessions are merged before the shuffle, so a busy user arrives as sessions, not as events.
    """
    sessions = _event_time(events, time, delay).groupBy(F.session_window(time, gap).alias("w"), user).agg(
        F.count("*").alias("n_messages"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")
    )
    return sessions.where("n_messages > 1").select(
        user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_messages", "first_ts", "last_ts"
    )


def chat_session_documents(
    messages: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Finished sessions as JSON documents with their messages in order, from (user, time, role, content) rows.

    Also takes ``paper_title`` and ``paper_text`` of a message; a session has those of its first message. Works on
    streams (append) and on batches; sessions with one message are dropped.
    """
    message = F.struct(F.col(time).alias("at"), "role", "content")
    first = lambda c: F.min_by(c, time).alias(c)
    sessions = _event_time(messages, time, delay).groupBy(F.session_window(time, gap).alias("w"), user).agg(
        F.array_sort(F.collect_list(message)).alias("_m"), first("paper_title"), first("paper_text"), F.min(time).alias("date")
    )
    ordered = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return session_documents(sessions.withColumn("messages", ordered), (user,))


def session_documents(sessions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chat sessions (paper_title, paper_text, date, messages) as JSON documents with a file-safe key.

    Sessions with one message or none are dropped.
    """
    key = F.concat_ws("_", tx.file_key(F.col("paper_title")), F.date_format("date", "yyyy-MM-dd_HH-mm-ss"))
    body = F.to_json(F.struct("paper_title", "paper_text", "date", "messages"))
    return sessions.where(F.size("messages") > 1).select(*keep, key.alias("session_key"), body.alias("session"))


def judge_arrivals(
    prompts: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Judge prompts as they arrive and append unseen (row, evaluator, aspect) scores; a replayed batch adds nothing."""

    def store(batch: DataFrame, _: int) -> None:
        append_scores(judge(batch), path)

    return (
        prompts.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_means(
    scores: DataFrame, by: str, value: str, time: str = "ts", window: str = "1 hour", slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Mean score per group and time window; late rows within ``delay`` still count."""
    timed = _event_time(scores, time, delay)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return timed.groupBy(span.alias("w"), by).agg(F.avg(value).alias("mean"), F.count(value).alias("n_rows")).select(
        by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mean", "n_rows"
    )


def first_arrivals(rows: DataFrame, key: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a key within ``delay`` of its first row, as the watermark tells; a batch keeps one row per key.

    A key is forgotten once the watermark has passed its first row by ``delay`` and may then come again.
    """
    if rows.isStreaming:
        return _event_time(rows, time, delay).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into a parquet folder and stop."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
