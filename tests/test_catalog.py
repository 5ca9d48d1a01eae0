"""Queries against their SQL on the smallest shared tables. ``TURNLOOM_QUICK=1`` runs a few of them."""

import math
import os

import duckdb
import pytest

from turnloom.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = (
    "text_counts", "parsed_dialogues", "cleaned_claims", "masked_tokens", "training_examples", "split_by_paper", "capped_groups",
    "random_peers", "kendall_correlation", "applied_thresholds", "annotator_agreement", "bigram_overlap", "bleu_2", "self_redundancy",
    "retrieval_metrics", "key_phrases", "resumed_judging", "preference_pairs", "choice_pairs", "training_samples", "chat_session_stream",
)
NAMES = QUICK if os.environ.get("TURNLOOM_QUICK") else sorted(ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLES[name])
    order = [c[0] for c in result.description]
    assert sorted(order) == columns
    want = sorted(tuple(plain(row[order.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120
