"""Readers. Schemas are given, never inferred from the data in production paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.reports import registry_table


def columnar(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet table; the stored schema unless one is given."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def named_split(spark: SparkSession, path: str, split: str, config: str | None = None) -> DataFrame:
    """One split of a dataset partitioned by ``split`` (and ``config``): other partitions are not read."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    return df.where(F.col("config") == config) if config else df


def experiments(spark: SparkSession, paths: Mapping[str, str], schema: str | None = None) -> DataFrame:
    """Several result tables as one with a ``system`` column."""
    return registry_table({name: columnar(spark, path, schema) for name, path in paths.items()})


def delimited(spark: SparkSession, path: str, schema: str, sep: str | None = None, line_breaks: bool = False) -> DataFrame:
    """CSV or TSV with header; the separator follows the file ending unless given.

    With ``line_breaks`` a quoted value may hold some, at the price that a file is read by one task; without, a row
    that one has broken is an error, as is any other row that does not fit the schema.
    """
    sep = sep or ("\t" if path.rstrip("/").endswith("tsv") else ",")
    return _csv(spark, path, schema, sep, line_breaks)


def _csv(spark: SparkSession, path: str, schema: str, sep: str, line_breaks: bool) -> DataFrame:
    # whole rows are parsed even if few columns are asked for: a broken row is one in every query
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("columnPruning", False)
    return reader.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=line_breaks)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or an array when the first line with content opens with ``[``; only that line is looked at."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    is_array = first is not None and first["value"].lstrip("﻿ \t").startswith("[")
    return json_array(spark, path, schema) if is_array else json_lines(spark, path, schema)


def task_files(spark: SparkSession, path: str, schema: str, name_parts: int = 2, sep: str = ",", line_breaks: bool = False) -> DataFrame:
    """All files of a folder as one table; ``task`` is the first ``name_parts`` pieces of the file name."""
    pattern = "^((?:[^_.]+_){0,%d}[^_.]+)" % (name_parts - 1)
    df = _csv(spark, path, schema, sep, line_breaks)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).alias("task"))


def keyed_documents(df: DataFrame, ident: str = "id") -> DataFrame:
    """Documents holding a map system -> (summary, scores) as one row per document and system."""
    return df.select(ident, "src", F.explode("sys_summs").alias("system", "_s")).select(
        ident, "src", "system", "_s.sys_summ", "_s.scores.*"
    )


def annotations(df: DataFrame, sides: Mapping[str, str], questions: Sequence[str]) -> DataFrame:
    """Flatten an annotation export: one row per task and annotator.

    A pairwise result becomes the model behind the chosen side in its question's column, any other result a
    ``<name>_comment`` column.
    """
    model = F.lit(None).cast("string")
    for side, name in sides.items():
        model = F.when(F.col("_r.value.selected") == side, F.lit(name)).otherwise(model)
    long = (
        df.select("data", F.posexplode("annotations").alias("_n", "_a"))
        .select("data", "_n", F.col("_a.completed_by.email").alias("annotator"), F.explode_outer("_a.result").alias("_r"))
        .withColumn("_pairwise", F.col("_r.type") == "pairwise")
    )
    aggs = []
    for q in questions:
        mine = F.col("_r.to_name") == q
        aggs.append(F.max(F.when(mine & F.col("_pairwise"), model)).alias(q))
        aggs.append(F.max(F.when(mine & ~F.col("_pairwise"), F.col("_r.value.text"))).alias(f"{q}_comment"))
    return long.groupBy("data", "_n", "annotator").agg(*aggs).select("data.*", "annotator", *[c for q in questions for c in (q, f"{q}_comment")])
