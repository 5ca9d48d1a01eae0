"""Writers."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators.judging import SCORE_KEY
from turnloom.session import fresh_dir, path_exists, sub_folders


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def save_splits(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def save_pairs(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per dataset."""
    df.write.mode("overwrite").partitionBy("dataset").json(path)


def save_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("system").json(path)


def save_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    """Long metric table ``(task, system, metric, value)``."""
    df.write.mode(mode).parquet(path)


def publish(df: DataFrame, name: str, folder: str | None = None) -> str:
    """Give ``df`` a name in the session's catalogue, and return where this version is stored.

    Each version is written whole to a folder of its own before the name is turned to it by one call, so a reader sees
    the old version or the new one. Readers of an earlier version go on: its files stay until they are deleted.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/version-{os.urandom(8).hex()}" if folder else fresh_dir(spark, "published")
    df.write.parquet(path)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{path}`")
    return path


def save_tasks(df: DataFrame, path: str, column: str = "task") -> None:
    """Annotation tasks as text, one JSON object per line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def save_manifest(spark: SparkSession, settings: Mapping[str, object], path: str) -> None:
    """One-row record of a run's settings."""
    row = spark.createDataFrame([(json.dumps(dict(settings), sort_keys=True, default=str),)], "settings string")
    row.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


class ScoreCache:
    """Scores in batches, each a folder with partitions by evaluator and system; a batch counts once it is whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def batches(self) -> list[str]:
        """Folders of the whole batches, oldest first."""
        found = sub_folders(self.spark, self.folder)
        return sorted(f"{self.folder}/{name}" for name in found if path_exists(self.spark, f"{self.folder}/{name}/_SUCCESS"))

    def append(self, scored: DataFrame) -> None:
        """Store ``scored(row_id, system, evaluator, subject, aspect, ...)`` as the latest batch."""
        last = max((int(f.rpartition("-")[2]) for f in sub_folders(self.spark, self.folder) if f.startswith("batch-")), default=-1)
        scored.write.partitionBy("evaluator", "system").parquet(f"{self.folder}/batch-{last + 1:06d}")

    def read(self, evaluator: str, systems: Sequence[str], key: Sequence[str] = ("row_id", "subject", "aspect")) -> DataFrame | None:
        """Scores of one evaluator and some systems, of rows judged again the latest; None without any batch.

        Partitions of other evaluators and systems are not read.
        """
        found = None
        for number, path in enumerate(self.batches()):
            if not any(f"evaluator={evaluator}" == x for x in sub_folders(self.spark, path)):
                continue
            part = self.spark.read.parquet(path).where((F.col("evaluator") == evaluator) & F.col("system").isin(*systems))
            part = part.withColumn("_batch", F.lit(number))
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        if found is None:
            return None
        latest = Window.partitionBy("system", *key).orderBy(F.col("_batch").desc())
        return found.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth", "_batch")


def unseen(scored: DataFrame, stored: DataFrame, key: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Rows of ``scored``, one per key, whose key is not stored.

    Stored keys are small as files and many times larger in memory: they are sorted beside the keys that are unique
    anyway, never sent whole to every task.
    """
    return scored.dropDuplicates(list(key)).join(stored.select(*key).hint("merge"), list(key), "left_anti")


def append_scores(scored: DataFrame, path: str, key: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Append scores whose key is not stored yet and return the full table; a repeated batch adds nothing."""
    spark = scored.sparkSession
    known = path_exists(spark, path)
    fresh = unseen(scored, spark.read.parquet(path), key) if known else scored.dropDuplicates(list(key))
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)
