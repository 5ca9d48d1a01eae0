"""From raw documents to token ids: filter, drop recurring lines and near copies, mix the sources, encode.

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import bpe, line_dedup, mixing, near_copies, toxicity
from turnloom.llm.catalog import rank_file
from turnloom.session import bound_batches, durable

#: The stages need a trained classifier, a permutation and a tokenizer, which SQL cannot express.
ORACLE_SQL = None
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below the threshold, unchanged. Labels are read from ``sf_dir``."""
    bound_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(F.col("text"), model) < TOXIC_FROM)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template came in an earlier document; ``n_chars`` follows the text."""
    bound_batches(spark)
    kept = line_dedup.drop_lines(docs)
    fresh = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    changed = {"text": F.col("text"), "n_chars": fresh}
    return kept.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id.

    Links are fingerprints within two bits, by the trie self-join of all of them, and a five-word Jaccard similarity of 0.8.
    """
    bound_batches(spark)
    return near_copies.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at its target weights: a row per document and pass, with the words taken."""
    bound_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, token_ids, ids_sha256, decoded_sha256`` for every row."""
    bound_batches(spark)
    done = docs.select("doc_id", "lang", "source", bpe.round_trip(F.col("text"), spark, *rank_file(), keep_ids=True).alias("t"))
    return done.select("doc_id", "lang", "source", "t.n_tokens", "t.token_ids", "t.ids_sha256", "t.decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage but the last is stored before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
