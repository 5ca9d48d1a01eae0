"""Conversations as turn tables: training examples, token-budgeted history, rendering, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import dialogue as dg
from turnloom.functions import text as tx
from turnloom.operators.ranking import running_totals
from turnloom.functions.binding import let
from turnloom.session import join_on


def explode_dialogues(df: DataFrame, parsed: str = "parsed_conv", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Parsed dialogue arrays to the long turn table ``(keep..., turn, author, text)``."""
    return df.select(*keep, F.posexplode(parsed).alias("turn", "_t")).select(*keep, "turn", "_t.author", "_t.text")


def pack_history(context: Column, budget: int) -> Column:
    """Walk the context backwards, skip every turn that would overflow the budget, keep older ones that fit.

    ``context`` is an array of structs with ``n_tokens``; the kept structs come back in reading order.
    """
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, item: Column) -> Column:
        fits = acc["used"] + item["n"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + item["n"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(F.array(item["i"]), acc["at"])).otherwise(acc["at"]).alias("at"),
        )

    costs = F.reverse(F.transform(context, lambda t, i: F.struct(t["n_tokens"].alias("n"), i.alias("i"))))
    kept = F.aggregate(costs, start, step, lambda acc: acc["at"])
    return F.transform(kept, lambda i: F.get(context, i))


def turn_examples(
    turns: DataFrame,
    role: str,
    max_turns: int = 40,
    token_budget: int = 1000,
    tokens: tx.TokenCounter = tx.token_count,
    conv: str = "conv_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One example per turn spoken by ``role`` after the first, with its budgeted history.

    Output: ``conv, keep..., example, prompt array<struct<role, content>>, completion, history_tokens``. Only the
    first ``max_turns`` turns take part; that limit is applied inside each input partition before the shuffle,
    so the one row collected per conversation stays bounded however long a conversation is.
    """
    order = Window.partitionBy(conv).orderBy("turn")
    clean = turns.select(conv, *keep, "turn", "author", "text").withColumn("_rank", F.row_number().over(order))
    head = clean.where(F.col("_rank") <= max_turns).withColumn("text", tx.mask_names("text"))
    item = F.struct(
        F.col("turn"),
        F.col("author"),
        tx.strip(F.col("text")).alias("content"),
        tokens(F.col("text")).alias("n_tokens"),
    )
    rows = head.groupBy(conv, *keep).agg(F.array_sort(F.collect_list(item)).alias("_t"))

    def example(ts: Column, i: Column) -> Column:
        packed = pack_history(F.slice(ts, F.lit(1), i + 1), token_budget)
        return let(
            packed,
            lambda h: F.struct(
                i.alias("example"),
                F.transform(
                    h,
                    lambda t: dg.message(
                        F.when(t["author"] == role, F.lit("assistant")).otherwise(F.lit("user")), t["content"]
                    ),
                ).alias("prompt"),
                F.get(ts, i + 1)["content"].alias("completion"),
                F.aggregate(h, F.lit(0), lambda acc, t: acc + t["n_tokens"]).alias("history_tokens"),
            ),
        )

    ts = F.col("_t")
    at = F.filter(F.sequence(F.lit(0), F.size(ts) - 2), lambda i: F.get(ts, i + 1)["author"] == role)
    return (
        rows.where(F.size("_t") >= 2)
        .select(conv, *keep, F.explode(F.transform(at, lambda i: example(ts, i))).alias("_e"))
        .select(conv, *keep, "_e.*")
    )


def render_conversations(
    turns: DataFrame, conv: str = "conv_id", sep: str = "\n\n", skip: int = 0, style: str = "journalist"
) -> DataFrame:
    """Whole conversations as text ``(conv, text)`` from ``(conv, turn, role, text)``."""
    line = dg.dialogue_line(F.col("role"), F.col("text"), style)
    return (
        turns.where(F.col("turn") >= skip)
        .groupBy(conv)
        .agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("_l"))
        .select(conv, F.array_join(F.transform("_l", lambda x: x["line"]), sep).alias("text"))
    )


def conversation_segments(
    turns: DataFrame, conv: str = "conv_id", sep: str = "\n\n", skip: int = 0, style: str = "journalist"
) -> DataFrame:
    """Rendered conversations in parts, ``(conv, turn, segment, start)``: what ``render_conversations`` joins by ``sep``.

    ``start`` is the place of the segment in the whole text, 0-based. Lengths are added up by stretches of turns, so a
    conversation of any length is neither gathered nor sorted by one task. A turn number is unique in its conversation;
    a turn without text has no segment.
    """
    line = dg.dialogue_line(F.col("role"), F.col("text"), style)
    rows = turns.where((F.col("turn") >= skip) & F.col("text").isNotNull()).select(conv, "turn", line.alias("segment"))
    rows = rows.withColumn("n", (F.length("segment") + len(sep)).cast("long"))
    return running_totals(rows, [conv], "turn", ["n"]).select(conv, "turn", "segment", F.col("n_before").alias("start"))


def conversation_lengths(turns: DataFrame, by: str, conv: str = "conv_id") -> DataFrame:
    """Mean words per conversation by system; counts are summed turn by turn, no text is assembled."""
    return (
        turns.groupBy(by, conv)
        .agg(F.sum(tx.word_count(F.col("text"))).alias("_n"))
        .groupBy(by)
        .agg(F.avg("_n").alias("mean_words"), F.count("*").alias("n_conversations"))
    )


def question_behaviour(turns: DataFrame, by: str, conv: str = "conv_id", rounded: bool = True) -> DataFrame:
    """Share of turns without a question, questions per turn, questions per conversation.

    The conversation count reads the turns joined by a blank line, where a turn without a final ``. ? !`` runs on into
    the next one. No text is joined: of each turn only its first and last sentence cross to others, as flags. Sentences
    that run on form a chain, which is a question if its first part opens like one or its last part ends with ``?``.
    """
    parts = F.transform(tx.naive_sentences(F.col("text")), tx.strip)
    flags = F.transform(parts, lambda s: F.struct(tx.opens_question(s).alias("opens"), s.endswith("?").alias("ends")))
    rows = turns.select(by, conv, "turn", flags.alias("_f"), (tx.strip(F.col("text")) == "").alias("_empty"),
                        (~tx.strip(F.col("text")).rlike("[?.!]$")).alias("_open"))
    asked = lambda f: f["opens"] | f["ends"]
    rows = rows.withColumn("_n", F.size(F.filter("_f", asked)))
    inner = F.size(F.filter(F.slice("_f", 2, F.greatest(F.size("_f") - 2, F.lit(0))), asked))
    order = Window.partitionBy(by, conv).orderBy("turn")
    runs_on = F.coalesce(F.lag("_open").over(order), F.lit(False))
    edge = lambda at, new, f: F.struct(F.lit(at).alias("at"), new.alias("new"), f["opens"].alias("opens"), f["ends"].alias("ends"))
    first, last = edge(0, ~F.col("_runs_on"), F.element_at("_f", 1)), edge(1, F.lit(True), F.element_at("_f", -1))
    spoken = rows.where(~F.col("_empty")).withColumn("_runs_on", runs_on).withColumn("_inner", inner)
    edges = spoken.select(by, conv, "turn", F.explode(F.when(F.size("_f") > 1, F.array(first, last)).otherwise(F.array(first))).alias("_e"))
    order = Window.partitionBy(by, conv).orderBy("turn", "_e.at").rowsBetween(Window.unboundedPreceding, 0)
    chains = edges.withColumn("_chain", F.sum(F.col("_e.new").cast("int")).over(order)).groupBy(by, conv, "_chain")
    place = F.struct("turn", "_e.at")
    chains = chains.agg((F.min_by("_e.opens", place) | F.max_by("_e.ends", place)).alias("_asked"))
    chained = chains.groupBy(by, conv).agg(F.count_if("_asked").alias("_chained"))
    counts = rows.groupBy(by, conv).agg(F.count("*").alias("_turns"), F.count_if(F.col("_n") == 0).alias("_silent"), F.sum("_n").alias("_q"))
    inside = spoken.groupBy(by, conv).agg(F.sum("_inner").alias("_inside"))
    convs = join_on(join_on(counts, chained, [by, conv], "left"), inside, [by, conv], "left")
    convs = convs.withColumn("_conv_q", F.coalesce("_chained", F.lit(0)) + F.coalesce("_inside", F.lit(0)))
    share = F.sum("_silent") / F.sum("_turns")
    per_turn = F.sum("_q") / F.sum("_turns")
    per_conv = F.avg("_conv_q")
    if rounded:
        share, per_turn, per_conv = F.bround(share, 2), F.bround(per_turn, 2), F.bround(per_conv, 1)
    return convs.groupBy(by).agg(
        share.alias("turns_without_question"),
        per_turn.alias("questions_per_turn"),
        per_conv.alias("questions_per_conversation"),
    )


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key in an explicit order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key: a lookup table where later duplicates win."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def lookup(df: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """Inner key lookup against the last row per key."""
    return df.join(last_per_key(table, key, order).drop(order), key, "inner")


def missing_keys(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows whose key the lookup table lacks, as a validation output."""
    return df.join(table.select(key), key, "left_anti")
