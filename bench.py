"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnloom.catalog import QUERIES  # noqa: E402
from turnloom.session import get_session  # noqa: E402

HEADLINE = (
    "text_counts", "training_examples", "turn_examples", "split_by_paper", "capped_groups", "class_metrics", "rank_correlations",
    "kendall_correlation", "roc_auc", "tuned_thresholds", "self_redundancy", "followup_scores", "unigram_overlap", "sentence_grid_unigrams",
    "bleu_4", "alignment_scores", "retrieved_documents", "key_phrases", "judge_scores", "preference_pairs", "plain_pairs", "training_samples",
    "aspect_report", "annotator_agreement", "chat_sessions",
)


# timed once more over the tables as they are stored; not part of the total
AS_STORED = ("text_counts", "split_by_paper", "turn_examples", "alignment_scores", "retrieved_documents")
# the shared text tables are one row group each, which Spark cannot divide; a cluster's tables have many
TEXT_TABLES = ("documents", "conversations", "pages")


def laid_out(spark, folder: str, parts: int) -> str:
    """The tables of ``folder`` in a temporary one, text tables in ``parts`` files; this is not timed."""
    target = tempfile.mkdtemp(prefix="bench-")
    atexit.register(shutil.rmtree, target, ignore_errors=True)
    for name in sorted(os.listdir(folder)):
        if name.removesuffix(".parquet") in TEXT_TABLES:
            spark.read.parquet(f"{folder}/{name}").repartition(parts).write.parquet(f"{target}/{name}")
        else:
            os.symlink(f"{folder}/{name}", f"{target}/{name}")
    return target


def timed(spark, names, folder: str) -> dict[str, float]:
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    label = os.path.basename(folder.rstrip("/"))
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cores}]",
        **{"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times = timed(spark, HEADLINE, laid_out(spark, folder, int(cores)))
    stored = timed(spark, AS_STORED, folder)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "as_stored": stored, "sf": label}))
    spark.stop()


if __name__ == "__main__":
    main()
