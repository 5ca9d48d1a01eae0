"""Corpus building: cleaning, paper selection, training examples, evaluation samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import dialogue as dg
from turnloom.functions import text as tx
from turnloom.operators import sampling as sm
from turnloom.operators import turns as tn
from turnloom.operators.budget import leading_sentences, paper_context

MARKER = "**Journalist"


def clean_corpus(raw: DataFrame, text: str = "conversation", marker: str = MARKER) -> DataFrame:
    """Keep texts with the marker, parse them, drop dialogues that parse to nothing."""
    return (
        raw.where(F.col(text).contains(marker))
        .withColumn("parsed_conv", tx.parse_dialogue(F.col(text)))
        .where(F.size("parsed_conv") > 0)
    )


def select_papers(
    papers: DataFrame,
    scores: DataFrame,
    min_clarity: int = 4,
    min_mean: float = 2.0,
    limit: int = 3000,
    source: str | None = None,
) -> DataFrame:
    """Papers with clear, relevant press releases and a usable context.

    ``scores`` is long (id, aspect, score); the clarity score must reach ``min_clarity`` and the mean of the
    scientific and societal score must exceed ``min_mean``.
    """
    wanted = papers if source is None else papers.where(F.col("source") == source)
    score = F.col("score").try_cast("int")
    pick = lambda a: F.max(F.when(F.col("aspect") == a, score)).alias(a)
    wide = scores.groupBy("id").agg(pick("clarity"), pick("scientific"), pick("societal"))
    good = wide.withColumn("avg_quality_score", (F.col("scientific") + F.col("societal")) / 2).where(
        (F.col("clarity") >= min_clarity) & (F.col("avg_quality_score") > min_mean)
    )
    context = paper_context(F.col("sc_section_names"), F.col("sc_sections"), F.col("sc_article"), limit=limit)
    return wanted.join(good, "id").withColumn("sc_intro", context).where(F.col("sc_intro") != "")


def training_examples(
    turns: DataFrame,
    papers: DataFrame,
    role: str,
    max_turns: int = 40,
    conversation_budget: int = 1000,
    paper_budget: int = 1000,
    conv: str = "paper_id",
) -> DataFrame:
    """Chat-formatted examples of one role: (paper_id, example, prompt, completion).

    ``papers`` has one (paper_id, paper_title, paper_text) row per conversation. Paper texts are cut to their
    budget before the join, so the join carries short texts.
    """
    cut = papers.select(
        conv,
        "paper_title",
        leading_sentences(F.col("paper_text"), paper_budget, keep_short=False).alias("paper_text"),
    )
    examples = tn.turn_examples(turns, role, max_turns, conversation_budget, conv=conv)
    full = examples.join(cut, conv)
    prompt = dg.chat(role, F.col("paper_title"), F.col("paper_text"), F.col("prompt"))
    completion = F.array(dg.message("assistant", F.col("completion")))
    return full.select(conv, "paper_title", "example", prompt.alias("prompt"), completion.alias("completion"))


def training_tables(
    turns: DataFrame, papers: DataFrame, seed: int = 123, train: float = 0.9, conv: str = "paper_id"
) -> DataFrame:
    """Journalist training, validation and test examples and researcher test examples in one table.

    Conversations are split 90/10 first. Journalist examples of the first part are split again by paper, so no
    paper feeds both training and validation.
    """
    papers = sm.split_rows(papers, conv, train, seed, "part")
    both = turns.join(papers.select(conv, "part"), conv)
    seen, held = both.where("part = 'train'").drop("part"), both.where("part = 'test'").drop("part")
    plain = papers.drop("part")
    journalist = sm.split_by_key(training_examples(seen, plain, "Journalist", conv=conv), conv, train, seed)
    held_j = training_examples(held, plain, "Journalist", conv=conv).withColumn("split", F.lit("held_out"))
    held_r = training_examples(held, plain, "Researcher", conv=conv).withColumn("split", F.lit("held_out"))
    return (
        journalist.withColumn("role", F.lit("Journalist"))
        .unionByName(held_j.withColumn("role", F.lit("Journalist")))
        .unionByName(held_r.withColumn("role", F.lit("Researcher")))
    )


def evaluation_sample(
    examples: DataFrame, corpus: DataFrame, n: int = 500, seed: int = 0, order: str = "example", corpus_order: str = "row_no"
) -> DataFrame:
    """One example per paper with its article and topic, ``n`` papers drawn by hash.

    ``corpus`` holds (paper_id, pr_article, topic) and an order; the last row of a paper wins.
    """
    one = tn.first_per_key(examples, "paper_id", order)
    return sm.sample_rows(tn.lookup(one, corpus, "paper_id", corpus_order), n, "paper_id", seed)


def list_questions(turns: DataFrame, ident: str = "conv_id") -> DataFrame:
    """Journalist turns as ``id ==> text`` lines."""
    line = F.concat(F.col(ident).cast("string"), F.lit(" ==> "), F.col("text"))
    return turns.where(F.col("author") == "Journalist").select(ident, "turn", line.alias("line"))


def overlapping_titles(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose title also occurs in ``b``."""
    return a.join(b.select(key), key, "left_semi")


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def pruned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)
