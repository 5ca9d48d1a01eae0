"""The registered queries over the smallest shared tables: against their SQL, or against plain forms."""

import hashlib
import os

import duckdb
import pytest
from cases import reach, simhash
from test_joins import linked

from turnloom.llm.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    order = [c[0] for c in result.description]
    assert sorted(order) == sorted(df.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=key) == sorted(result.fetchall(), key=key)


def test_simhash_query(spark, docs):
    prints = [simhash(t) for _, t in docs]
    root = reach(prints, 2)
    want = {d: (f"{p:016x}", docs[r][0]) for (d, _), p, r in zip(docs, prints, root)}
    rows = QUERIES["op1_simhash_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want and len(rows) == len(docs)


def test_token_query(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op8_byte_bpe"](spark, FOLDER).collect()}
    assert all(rows[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for d, t in docs)


def test_one_row_per_document(spark, docs):
    ids = sorted(d for d, _ in docs)
    for name in ("op2_mixing", "op6_pii", "op7_toxicity", "op10_winnowing"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, FOLDER).select("doc_id").collect()) == ids, name


def test_pipeline_stage_by_stage(spark, docs):
    """Each stage does on its predecessor's rows what its operator promises, and run() is the stages in order."""
    import corpus_pipeline as pipeline

    from turnloom.llm import mixing, toxicity
    from turnloom.session import durable

    first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = {}
    df = first
    for name, stage in pipeline.STAGES:
        df = durable(stage(spark, df, FOLDER))
        stages[name] = [r.asDict() for r in df.collect()]
        if name != "byte_bpe":
            assert df.columns == first.columns, name
    text = {d: t for d, t in docs}
    toxic = {r.doc_id for r in toxicity.scored(first, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("predicted = 1").collect()}
    clean = {r["doc_id"]: r["text"] for r in stages["toxicity"]}
    assert clean == {d: t for d, t in text.items() if d not in toxic} and toxic
    lines = {r["doc_id"]: r["text"] for r in stages["line_dedup"]}
    assert set(lines) == set(clean)
    for d, t in lines.items():
        left = iter(clean[d].split("\n"))
        assert t == "" or all(any(x == y for y in left) for x in t.split("\n"))  # a subsequence of the lines
    seen = set()
    for d in sorted(lines):  # no line with a word comes twice in different documents
        own = {x for x in lines[d].split("\n") if x.split()}
        assert not own & seen
        seen |= own
    order = sorted(lines)
    like = {d: c for d, n, c in linked([(d, lines[d]) for d in order]) if n}
    empty = [d for d in order if not lines[d].split()]
    assert sorted(r["doc_id"] for r in stages["simhash_dedup"]) == sorted({*like.values(), *empty[:1]})
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert words(stages["mixing"]) == pytest.approx(1.5 * words(stages["simhash_dedup"]), rel=0.01)
    tokens = sorted((r["doc_id"], r["decoded_sha256"]) for r in stages["byte_bpe"])
    assert tokens == sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in stages["mixing"])
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in stages["byte_bpe"])
    run = sorted((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, FOLDER).collect())
    assert run == sorted((r["doc_id"], r["ids_sha256"]) for r in stages["byte_bpe"])
    assert mixing.BLOCK == 1024
