"""Steps whose cost must not grow faster than their input."""

import hashlib

from pyspark.sql import functions as F

from turnloom.catalog import datasets as cd
from turnloom.catalog import streaming as cs
from turnloom.catalog import texts as ct
from turnloom.functions import lookup as lk
from turnloom.functions import text as tx
from turnloom.operators import judging as jd
from turnloom.operators import lexical as lx
from turnloom.operators import rubrics as rb
from turnloom.operators.stages import containment, score_pairs, token_set
from turnloom.plans import benchmark as bm
from turnloom.plans import pairs as pr
from turnloom.sources import sinks


def test_stream_source_reads_its_rows_a_fixed_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(cs, "BATCH_ROWS", 5)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(60, numPartitions=2).select(F.timestamp_seconds(counted("id")).alias("ts"), "id")
    stream = cs.stream_of(spark, rows)
    assert seen.value <= 4 * 60
    assert stream.isStreaming


def test_case_maps_are_made_of_asked_documents_only(spark, tmp_path, monkeypatch):
    """A text that no claim is about is not cut into words; repeated rows on both sides stay as they are."""
    docs = [(1, "The NATO met"), (1, "the Nato met"), (2, "no claim about this"), (3, "Rome fell"), (None, "x")]
    said = [(1, 0, "the nato"), (3, 1, "rome"), (3, 1, "rome"), (4, 0, "nothing"), (None, 2, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    stored = []
    monkeypatch.setattr(ct, "durable", lambda df: stored.append(df) or df)
    got = sorted((r.conv_id, r.turn, r.claim_md5) for r in ct.cleaned_claims(spark, str(tmp_path)).collect())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == sorted([(1, 0, md5("The NATO")), (1, 0, md5("The Nato")), (3, 1, md5("Rome")), (3, 1, md5("Rome"))])
    assert sorted(r.conv_id for r in stored[0].collect()) == [1, 1, 3]


def test_pending_prompts_meet_stored_scores_by_row(spark):
    rows = spark.createDataFrame([("1", "s", "x"), ("2", "s", "y"), (None, "s", "z")], "row_id string, system string, conversation string")
    rubrics, keep = rb.RUBRICS[:2], ["row_id", "system"]
    every = jd.build_prompts(rows, rubrics, keep)
    stored = every.where(f"row_id = '1' or aspect = '{rubrics[0].aspect}'").select(*keep, "subject", "aspect")
    got = sorted(map(str, jd.pending_prompts(rows, rubrics, keep, stored).collect()))
    assert got == sorted(map(str, jd.pending(every, stored, [*keep, "subject", "aspect"]).collect())) and len(got) == 3
    assert jd.pending_prompts(rows, rubrics, keep, None).count() == every.count()


def test_stored_scores_are_not_broadcast(spark, tmp_path):
    """No task holds all stored keys, however small their files are; nulls and repeats are as in a plain anti join."""
    rows = [("1", "e", "s", "a", 1), ("1", "e", "s", "a", 2), ("2", "e", "s", "a", 1), (None, "e", "s", "a", 1), ("3", "e", "s", "a", 1)]
    scored = spark.createDataFrame(rows, "row_id string, evaluator string, subject string, aspect string, score int")
    scored.where("row_id is null or row_id = '2'").write.parquet(f"{tmp_path}/scores")
    fresh = sinks.unseen(scored, spark.read.parquet(f"{tmp_path}/scores"))
    assert sorted(str(r.row_id) for r in fresh.collect()) == ["1", "3", "None"]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_common_subsequences_take_batches_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "67108864b")
    try:
        row = lx.rouge(spark.createDataFrame([("1", "a b c", "a c")], "item_id string, a string, b string"), ("L",), stem=False).first()
        assert round(row["rougeL_f"], 6) == 0.8 and spark.conf.get(key) != "67108864b"
    finally:
        spark.conf.set(key, before)


def test_texts_of_a_pair_are_cut_once_for_all_heads(spark):
    pairs = spark.createDataFrame([("a b c", "a z")], "premise string, hypothesis string")
    scored = score_pairs(pairs)
    assert scored.first()["tri"] == [0.5, 0.0, 0.5]
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("lower(premise") == 1


def test_claims_are_respelt_without_sorting_the_context(spark):
    df = spark.createDataFrame([("The NATO met nato. The Nato", "the nato MET rome"), ("", "a"), (None, "x")], "c string, h string")
    claimed = df.select(tx.clean_claim(F.col("c"), F.col("h")).alias("t"))
    assert [r.t for r in claimed.collect()] == ["The Nato met rome", "A", "X"]
    assert "sort_array" not in claimed._jdf.queryExecution().analyzed().toString()


def test_masked_answers_are_looked_for_by_their_letters(spark):
    df = spark.createDataFrame([("Old-age, an age; AGE old", ["age", "old"])], "c string, a array<string>")
    masked = df.select(tx.mask_answers(F.col("c"), F.col("a")).alias("t"))
    assert masked.first().t == "Old-age, an ;  "
    assert "(?iU)\\Q" in masked._jdf.queryExecution().analyzed().toString()


def test_a_text_without_words_has_no_first_and_no_last_word(spark):
    texts = [" \t\n", "", None, "one", "\u00a0x  b\u2003c\n"]
    df = spark.createDataFrame([(i, t, "q", []) for i, t in enumerate(texts)], "row_id long, context string, question string, answers array<string>")
    ends = df.orderBy("row_id").select(tx.first_word(F.col("context")).alias("first"), tx.last_word(F.col("context")).alias("last")).collect()
    assert [tuple(r) for r in ends] == [(None, None), (None, None), (None, None), ("one", "one"), ("\u00a0x", "b\u2003c")]
    told = {r.row_id: r.text_b[0] for r in pr.build_pairs("squad_v2", df).collect()}
    assert told == {"0": "q no answer", "1": "q no answer", "2": "q no answer", "3": "q one", "4": "q b\u2003c"}


def test_material_of_answers_is_joined_whole_and_stored_without_its_pieces(spark, tmp_path, monkeypatch):
    """Only the text is shuffled, and no table holds all its words and sentences; repeated labels repeat a document."""
    docs = [(3, "One two. Three.", "en", "s"), (4, "Four", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stored = []
    monkeypatch.setattr(cd, "durable", lambda df: stored.append(df) or df)
    rows = cd.raw_answers(spark, str(tmp_path))["squad"].orderBy("row_id").collect()
    assert [(r.row_id, r.question, r.answers) for r in rows] == [(3, "One two.", []), (3, "One two.", []), (4, "Four", ["", "Four"])]
    assert not {"ss", "ws"} & set(stored[0].columns)
    plan = stored[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan[plan.index("Join LeftOuter") :]


ODD_TEXTS = [
    ("İstanbul ΑΣ Kelvin \u212a K", "i̇stanbul ας KELVIN k \u212a"), (None, "A b"), ("x", None), ("", ""), ("  ", " a "), ("a\x1cb A\x85b x", "A\x1cB a\x85B X"),
    ("A" * 300 + " a", "a A " * 3), ("ab aB Ab " * 400 + " Aab", "aB a b AB " * 30), ("École-été 3½", "ÉCOLE Été x_y _ ½"), ("x_y z", "x y"),
    (" ".join(f"W{i}" for i in range(90)), " ".join(f"w{i}" for i in range(0, 180, 2))), ("\tNew\nline\x0bA\x0cB\rC", "new LINE a b c"),
]


def test_claims_and_shares_by_search_are_those_of_cut_texts(spark):
    """Last spellings and shares of tokens as by cutting whole texts, also where the search gives way to that."""
    df = spark.createDataFrame(ODD_TEXTS, "c string, h string").repartition(1)
    every = df.select("c", "h", tx.clean_claim_by(tx.case_map(F.col("c")), F.col("h")).alias("t"), containment(tx.lexical_tokens(F.col("c")), token_set(F.col("h"))).alias("s"))
    made = df.select("c", "h", tx.clean_claim(F.col("c"), F.col("h")).alias("t"), lk.token_share(F.lower("c"), F.lower("h")).alias("s"))
    assert sorted(map(str, made.collect())) == sorted(map(str, every.collect()))
    for few, misses in ((0, 256), (48, 0), (10**6, 10**6)):
        with_limits = lambda f, *a: _limited(few, misses, f, *a)
        for c, h in ((c, h) for c, h in ODD_TEXTS if c and h):
            assert with_limits(lk.respelt, c, c.lower(), h, h.lower()) == lk.respelt(c, c.lower(), h, h.lower())
            assert with_limits(lk.share_held, c.lower(), h.lower()) == lk.share_held(c.lower(), h.lower())


def _limited(few, misses, f, *args):
    before = lk.FEW, lk.MISSES
    lk.FEW, lk.MISSES = few, misses
    try:
        return f(*args)
    finally:
        lk.FEW, lk.MISSES = before


def test_contexts_of_claims_and_premises_are_not_cut_into_words(spark):
    df = spark.createDataFrame([("The NATO met", "nato a.")], "premise string, hypothesis string")
    claimed = df.withColumn("hypothesis", tx.clean_claim(F.col("premise"), F.col("hypothesis")))
    assert claimed.first().hypothesis == "NATO a." and score_pairs(claimed).first()["reg"] == 0.5
    plan = score_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "split(premise" not in claimed._jdf.queryExecution().analyzed().toString()


def test_tasks_are_made_once_for_all_tables(spark, monkeypatch):
    made, tasks = [], bm.tasks
    monkeypatch.setattr(bm, "tasks", lambda: made.append(1) or tasks())
    rows = spark.createDataFrame([(1, "a b", "a b", 1), (2, "a b", "c", 0)], "row_id long, sentence1 string, sentence2 string, label int")
    got = bm.run_benchmark(dict.fromkeys(("mrpc", "paws", "axb"), rows)).where("metric = 'accuracy'").collect()
    assert sorted((r.task, r.value) for r in got) == [("axb", 0.0), ("mrpc", 1.0), ("paws", 1.0)]
    assert len(made) == 2


def test_a_null_among_the_answers_deletes_nothing(spark):
    """The first word of a text without words is such an answer."""
    rows = [(1, " \n", "q", ["", None]), (2, None, "q", ["", None]), (3, "a b c", "q", [None, "b", "a", None])]
    df = spark.createDataFrame(rows, "row_id long, context string, question string, answers array<string>")
    assert [r.t for r in df.orderBy("row_id").select(tx.mask_answers(F.col("context"), F.col("answers")).alias("t")).collect()] == [" \n", None, "  c"]
    told = {r.row_id: r.text_c for r in pr.build_pairs("quoref", df).where("orig_label = 0").collect()}
    assert told == {"1": ["no answer"], "2": ["no answer"], "3": ["c"]}
