"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of step tables by application.
_STEPS: dict[str, list[str]] = {}

# Shuffle keys may be skewed, so joins and aggregates rely on runtime re-planning.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # a table laid out by item serves every grouping or join on item plus further keys
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def get_session(name: str = "turnloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on batches for Python workers end at ``size`` bytes: rows with whole texts differ too much for a count.

    What a worker holds at once follows the batch, and workers live on from stage to stage. A size other than Spark's
    own stays as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(size))


def shared_dir(spark: SparkSession) -> str:
    """Folder for steps: the cluster's ``spark.checkpoint.dir`` or the checkpoint folder that was set.

    Only a local master, where driver and executors are one process, may do without: it gets a temporary folder that
    goes when the program ends. Elsewhere each executor would write to its own disk, so a missing folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and _has_checkpoint_dir(spark):
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="turnloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not _has_checkpoint_dir(spark):
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _has_checkpoint_dir(spark: SparkSession) -> bool:
    return spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new sub-folder path (not created) below the shared folder."""
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/{label}-{os.urandom(8).hex()}"
    _STEPS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it is missing."""
    if not path_exists(spark, path):
        return []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def drop_steps(spark: SparkSession) -> int:
    """Delete the step tables that this application has written so far; results that still read them are lost."""
    paths = _STEPS.pop(spark.sparkContext.applicationId, [])
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder once; later reads neither recompute nor depend on executors.

    Unlike a row checkpoint the table is columnar and of known size: readers take only the columns they need, and
    small tables are joined by broadcast.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the result has the keys of ``left`` once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])
