"""Named queries over the shared tables, each with the equivalent SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` must return the same columns and rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker turns: ``assistant`` is the journalist, ``user`` the researcher."""
    rows = table(spark, folder, "conversations").where("role <> 'system'")
    author = F.when(F.col("role") == "assistant", "Journalist").otherwise("Researcher")
    return rows.select("conv_id", "turn", author.alias("author"), "role", "text")


TURNS = """turns AS (
  SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'Journalist' ELSE 'Researcher' END AS author, role, text
  FROM conversations WHERE role <> 'system')"""


def as_questions(text):
    """Full stops behind a vowel become question marks: the shared texts hold none."""
    return F.regexp_replace(text, r"([aeiou])\.", "$1?")


AS_QUESTIONS = r"regexp_replace({}, '([aeiou])\.', '\1?', 'g')"
WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SENTENCES = (
    r"list_filter(string_split(regexp_replace(" + STRIP + r", '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
)
NAIVE = r"string_split(regexp_replace(" + STRIP + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')"
LEXICAL = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"
