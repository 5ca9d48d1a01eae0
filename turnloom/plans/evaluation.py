"""Evaluation of generated conversations: faithfulness, redundancy, follow-ups, judges, significance."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import dialogue as dg
from turnloom.functions import text as tx
from turnloom.operators import judging as jd
from turnloom.operators import stats as st
from turnloom.operators.alignment import alignment_score
from turnloom.operators.lexical import rouge
from turnloom.operators.reports import corpus_overlap, mean_and_spread, registry_table
from turnloom.operators.rubrics import Rubric
from turnloom.operators.similarity import followup_score, self_redundancy
from turnloom.operators.stages import embed
from turnloom.sources.sinks import ScoreCache


def journalist_pairs(generated: DataFrame) -> DataFrame:
    """Paper text against all journalist turns, per (paper_id, system)."""
    messages = F.col("generated_conversation")
    return generated.select(
        "paper_id",
        "system",
        F.get(messages, F.lit(1))["content"].alias("premise"),
        F.array_join(dg.contents_of(messages), "\n\n").alias("hypothesis"),
    )


def journalist_turns(generated: DataFrame) -> DataFrame:
    """Journalist turns with consecutive numbers: (system, conv, turn, text)."""
    conv = F.concat_ws("/", "system", "paper_id").alias("conv")
    turns = F.posexplode(dg.contents_of(F.col("generated_conversation"))).alias("turn", "text")
    return generated.select("system", conv, turns)


def faithfulness(generated: DataFrame, **how) -> DataFrame:
    return alignment_score(journalist_pairs(generated), **how).select("paper_id", "system", "alignment")


def conversation_quality(generated: DataFrame, make_client: Callable | None = None, threshold: float = 0.8) -> DataFrame:
    """Mean and spread of faithfulness, self-redundancy and follow-up share per system."""
    turns = journalist_turns(generated)
    ident = F.concat_ws("/", "conv", F.col("turn").cast("string"))
    vectors = embed(turns, "text", make_client=make_client).withColumn("vec_id", ident)
    redundancy = self_redundancy(vectors, "conv", "vec_id")
    asked = turns.select("conv", "turn", F.posexplode(tx.question_sentences(F.col("text"))).alias("n", "question"))
    asked = embed(asked, "question", make_client=make_client).withColumn(
        "vec_id", F.concat_ws("/", "conv", F.col("turn").cast("string"), F.col("n").cast("string"))
    )
    follow = followup_score(asked, turns, "conv", "turn", "vec_id", threshold=threshold)
    systems = turns.select("system", "conv").distinct()
    long = (
        faithfulness(generated).select("system", F.lit("faithfulness").alias("metric"), F.col("alignment").alias("v"))
        .unionByName(redundancy.join(systems, "conv").select("system", F.lit("redundancy").alias("metric"), F.col("redundancy").alias("v")))
        .unionByName(follow.join(systems, "conv").select("system", F.lit("followup").alias("metric"), F.col("followup").alias("v")))
    )
    return long.groupBy("system", "metric").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n_rows")
    )


def text_similarity_report(pairs: DataFrame, kinds: Sequence[str] = ("1", "L"), stem: bool = True) -> DataFrame:
    """Mean ROUGE per system over ``(item_id, system, a, b)``."""
    scored = rouge(pairs, kinds, stem=stem).join(pairs.select("item_id", "system"), "item_id")
    return corpus_overlap(scored, "system", [f"rouge{k}_f" for k in kinds])


def judge_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spearman correlation of two judges per aspect."""
    return st.spearman(jd.judge_pairs(a, b), ["aspect"], "a", "b")


def significance(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Signed-rank test between two systems per aspect, paired by paper."""
    return st.wilcoxon(jd.system_pairs(scores, first, second), ["aspect"])


def metric_spread(scores: DataFrame, value: str, by: Sequence[str] = ("system",)) -> DataFrame:
    """Mean, sample deviation and count of a score per system, or per system and aspect."""
    return mean_and_spread(scores, by, value)


def evaluate_systems(
    tables: Mapping[str, DataFrame], rubrics: Sequence[Rubric], evaluator: str, folder: str, force: bool = False, key: str = "row_id", **how
) -> DataFrame:
    """Scores of several systems' conversations on several rubrics, of which only those that ``folder`` lacks are judged.

    The folder is read for this evaluator and these systems only. What is new goes there as one batch, which counts
    from the moment that it is whole; with ``force`` all is judged anew and the later scores count.
    """
    systems = registry_table(tables)
    cache = ScoreCache(systems.sparkSession, folder)
    stored = cache.read(evaluator, list(tables))
    todo = jd.pending_prompts(systems, rubrics, (key, "system"), None if force else stored).withColumn("evaluator", F.lit(evaluator))
    cache.append(jd.run_judge(todo, **how).drop("prompt", "reply"))
    return cache.read(evaluator, list(tables))
