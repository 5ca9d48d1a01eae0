"""Sources, pair builders, benchmark tasks, generation and streams on small rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from turnloom.functions import labels as lb
from turnloom.operators.rubrics import dialogue_prompts
from turnloom.plans import benchmark as bm
from turnloom.plans import generation as gn
from turnloom.plans import human as hm
from turnloom.plans import pairs as pr
from turnloom.plans import shaping as sh
from turnloom.sources import readers, sinks
from turnloom.streaming import streams as stm


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "l.json").write_text('\n{"x": 1}\n{"x": 2}\n')
    for name in ("a.json", "l.json"):
        rows = readers.json_any(spark, str(tmp_path / name), "x int").where("x is not null").collect()
        assert sorted(r.x for r in rows) == [1, 2]


def test_task_files(spark, tmp_path):
    for name in ("frank_val_1.csv", "paws_dev.csv"):
        (tmp_path / name).write_text('a,b\n1,"x,\ny"\n')
    rows = readers.task_files(spark, str(tmp_path), "a int, b string", 2, line_breaks=True).collect()
    assert {(r.task, r.b) for r in rows} == {("frank_val", "x,\ny"), ("paws_dev", "x,\ny")}


def test_append_scores_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "e", "s", "a", 3)], "row_id int, evaluator string, subject string, aspect string, score int")
    path = str(tmp_path / "scores")
    for _ in range(2):
        out = sinks.append_scores(rows, path)
    assert out.count() == 1
    sinks.save_manifest(spark, {"seed": 1}, str(tmp_path / "manifest"))
    assert json.loads(spark.read.json(str(tmp_path / "manifest")).first().settings) == {"seed": 1}


def test_annotations(spark, tmp_path):
    task = {
        "data": {"sc_title": "t", "gen_model": "m", "llm1_clarity_eval": "Score: 3\nReason: x", "llm2_clarity_eval": "Score: 10\nReason: y"},
        "annotations": [
            {"completed_by": {"email": e}, "result": [{"type": "pairwise", "to_name": "pw_llm_clarity", "value": {"selected": s}}, {"type": "textarea", "to_name": "pw_llm_clarity", "value": {"text": "c"}}]}
            for e, s in (("a", "left"), ("b", "left"), ("c", "right"))
        ]
        + [{"completed_by": {"email": "d"}, "result": []}],
    }
    (tmp_path / "x.json").write_text(json.dumps([task]))
    schema = (
        "data struct<sc_title:string,gen_model:string,llm1_clarity_eval:string,llm2_clarity_eval:string>, "
        "annotations array<struct<completed_by:struct<email:string>,result:array<struct<type:string,to_name:string,value:struct<selected:string,text:string>>>>>"
    )
    export = readers.json_array(spark, str(tmp_path / "x.json"), schema)
    flat = {r.annotator: r for r in readers.annotations(export, {"left": "one", "right": "two"}, ["pw_llm_clarity"]).collect()}
    assert flat["a"].pw_llm_clarity == "one" and flat["c"].pw_llm_clarity == "two" and flat["a"].pw_llm_clarity_comment == "c"
    assert flat["d"].pw_llm_clarity is None
    row = hm.human_report(export, {"left": "one", "right": "two"}, ["clarity"]).first()
    assert row.n_units == 1 and row.n_values == 3


def test_every_dataset_and_task_is_registered(spark):
    assert len(pr.datasets()) == 49 and len(bm.tasks()) == 74
    assert {d.task for d in pr.datasets().values()} <= {*sh.BINARY, *sh.THREE_WAY, *sh.REGRESSION}


def test_answer_builders(spark):
    qa = spark.createDataFrame([("1", "The sun shines.", "what?", ["sun"]), ("2", "No answer here", "what?", [])], "row_id string, context string, question string, answers array<string>")
    rows = {(r.row_id, r.orig_label): r for r in pr.build_pairs("squad_v2_new", qa).collect()}
    assert set(rows) == {("1", 1.0), ("2", 0.0)} and rows[("1", 1.0)].text_c == ["sun"]
    both = {(r.row_id, r.orig_label) for r in pr.build_pairs("quoref", qa).collect()}
    assert both == {("1", 1.0), ("1", 0.0), ("2", 0.0)}


def test_multi_hop(spark):
    schema = "row_id string, question string, answer string, supporting_titles array<string>, titles array<string>, sentences array<array<string>>"
    rows = [
        ("1", "q", "a", ["t1"], ["t1", "t2", "t3"], [["x ", "y"], ["z"], ["w"]]),
        ("2", "q", "a", list("abcd"), list("abcde"), [[c] for c in "abcde"]),
        ("3", "q", "a", ["a"], ["a"], [["only"]]),
    ]
    got = {r.row_id: r.context.split("\n") for r in pr.multi_hop_context(spark.createDataFrame(rows, schema)).collect()}
    assert len(got["1"]) == 2 and "x y" in got["1"] and sorted(got["2"]) == list("abcd") and got["3"] == ["only"]


def test_coreference_and_stories(spark):
    gap = spark.createDataFrame([("1", "She met Ann.", "She", 0, "Ann", "Bea", True, False)], "row_id string, Text string, Pronoun string, Pronoun_offset int, A string, B string, A_coref boolean, B_coref boolean")
    assert [(r.text_b[0], r.orig_label) for r in pr.build_pairs("gap", gap).collect()] == [("Ann met Ann.", 1.0), ("Bea met Ann.", 0.0)]
    story = "row_id string, type string, text string, questions array<struct<q:string,isQuestionBad:double,consensus:struct<s:int,e:int>>>"
    rows = [("1", "train", "abc def", [("q1", 0.2, (0, 4)), ("q2", None, None), ("q3", 0.3, (0, 1))]), ("2", "dev", "x", [("q", 0.0, None)])]
    got = {r.question: r.answers for r in pr.story_questions(spark.createDataFrame(rows, story)).collect()}
    assert got == {"q1": ["abc"], "q2": []}


def test_key_phrase_negatives_avoid_the_answer(spark):
    df = spark.createDataFrame([("1", "Compatibility of systems of linear constraints over natural numbers. Criteria of minimal generating sets.", "what?", ["minimal generating sets"])], "row_id string, context string, question string, answers array<string>")
    row = pr.build_pairs("squad", df).first()
    assert row.text_b == ["what? minimal generating sets"]
    assert "what? minimal generating sets" not in row.text_c and "what? natural numbers" in row.text_c


def test_samples_route_labels(spark):
    rows = [(i, t, "a", ["b0", "b1"], [], float(i % 3)) for i, t in enumerate(["nli", "qa", "wmt", "summarization", "ir"] * 40)]
    df = spark.createDataFrame(rows, "row_id int, task string, text_a string, text_b array<string>, text_c array<string>, orig_label double")
    out = sh.training_samples(df).collect()
    assert len(out) == 200
    for r in out:
        used = [r.align_label != -100, r.tri_label != -100, r.reg_label != -100]
        assert used == {"nli": [False, True, False], "wmt": [False, False, True]}.get(r.task, [True, False, False])
        assert r.text_b is not None
    aligned = [r for r in out if r.task == "nli" and r.text_b == "a" and r.text_a == "a"]
    assert all(r.tri_label == 0 for r in aligned)


def test_label_maps(spark):
    df = spark.createDataFrame([("factual",), ("too incoherent",), ("?",)], "l string")
    assert [r[0] for r in df.select(lb.factuality_label(F.col("l"))).collect()] == [1, 0, None]


def test_benchmark_reports_by_group(spark):
    frank = spark.createDataFrame(
        [(str(i), "cats run fast. dogs sleep.", "cats run" if i % 2 else "birds fly", float(i % 2), "xsum" if i < 4 else "cnndm") for i in range(8)],
        "row_id string, document string, summary string, score double, dataset string",
    )
    out = {(r.grp, r.metric): r.value for r in bm.run_benchmark({"frank": frank}).collect()}
    assert {g for g, _ in out} == {"xsum", "cnndm", "all"} and out[("all", "auc")] == 1.0 and out[("xsum", "pearson")] == pytest.approx(1.0)


def test_dialogue_generation_keeps_both_views(spark):
    df = spark.createDataFrame([("p", "t", "Paper text.")], "paper_id string, paper_title string, paper_text string")
    model = lambda p: F.concat(F.lit("n"), F.size(F.split(p, r"<\|")).cast("string"), F.lit("."))
    row = gn.interactive_conversations(df, model, model, rounds=2).first()
    assert [m.role for m in row.generated_conversation] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert row.conversation == "Journalist: n4.\n\nResearcher: n5.\n\nJournalist: n6.\n\nResearcher: n7."
    assert len(dialogue_prompts()) == 6


PAPERS = [("p1", "t", "Paper text."), ("p2", "u", "Another one."), ("p2", "u", "Another one.")]


def test_turn_log_holds_replies_only_and_goes_on(spark, tmp_path):
    """An ended run goes on behind its last whole step; papers are stored once, steps hold keys and replies."""
    df = spark.createDataFrame(PAPERS, "paper_id string, paper_title string, paper_text string")
    model = lambda p: F.concat(F.lit("n"), F.size(F.split(p, r"<\|")).cast("string"), F.lit("."))
    fails = lambda p: F.raise_error(F.lit("the model is gone"))
    folder = str(tmp_path / "log")
    with pytest.raises(Exception, match="the model is gone"):
        gn.interactive_conversations(df, model, fails, rounds=2, folder=folder)
    assert sorted(f.name for f in (tmp_path / "log" / "turns").iterdir() if (f / "_SUCCESS").exists()) == ["step=0"]
    other = lambda p: F.lit("not asked again.")
    got = gn.interactive_conversations(df, other, model, rounds=2, folder=folder).collect()
    assert len(got) == 3 and {r.conversation for r in got} == {
        "Journalist: n4.\n\nResearcher: n5.\n\nJournalist: not asked again.\n\nResearcher: n7."
    }
    step = spark.read.parquet(str(tmp_path / "log" / "turns" / "step=3"))
    assert step.columns == ["_paper", "role", "content", "error"] and step.count() == 3
    again = gn.interactive_conversations(df, fails, fails, rounds=2, folder=folder).collect()
    assert sorted(again) == sorted(got)


def test_turn_log_keeps_errors(spark, tmp_path):
    def make():
        def client(prompts):
            if any("Another" in p for p in prompts):
                raise ValueError("no reply")
            return ["Fine."] * len(prompts)

        return client

    df = spark.createDataFrame(PAPERS[:2], "paper_id string, paper_title string, paper_text string")
    log = str(tmp_path / "log")
    rows = gn.fixed_question_conversations(df, make, native=False, questions=["One?", "Two?"], folder=log).collect()
    assert {r.paper_id: [m.content for m in r.generated_conversation[2:]] for r in rows}["p1"] == ["One?", "Fine.", "Two?", "Fine."]
    errors = spark.read.parquet(log + "/turns").where("error is not null")
    assert errors.count() == 2 and errors.where("content is not null").isEmpty()


def test_article_summaries_of_null(spark):
    df = spark.createDataFrame([(1, "An article. End."), (2, None)], "i int, pr_article string")
    rows = {r.i: r.pr_summary for r in gn.article_summaries(df).collect()}
    assert rows == {1: "In short: End.", 2: None}


def test_limits_take_one_search(spark, monkeypatch):
    """Counts and shares per dataset are met, and more datasets do not mean more jobs."""
    from turnloom.operators import sampling as sm

    calls = []
    layout = sm.range_layout
    monkeypatch.setattr(sm, "range_layout", lambda *a: calls.append(1) or layout(*a))
    rows = [(f"d{i % 5}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "dataset string, row_no long")
    limits = {"d0": 3, "d1": 0.5, "d2": 0, "d3": 1000, "absent": 5}
    got = {}
    for r in sm.first_per_group(df, "dataset", limits, "row_no").collect():
        got.setdefault(r.dataset, []).append(r.row_no)
    own = {d: [i for n, i in rows if n == d] for d in ("d0", "d1", "d3")}
    assert {d: sorted(x) for d, x in got.items()} == {"d0": own["d0"][:3], "d1": own["d1"][:10], "d3": own["d3"]}
    assert calls == [1]


def test_long_dialogue_in_segments(spark):
    """Segments put at their places are the rendered text, also of a dialogue that holds nearly all rows."""
    from turnloom.operators.turns import conversation_segments, render_conversations

    rows = [("long", t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 7)) for t in range(3000)]
    rows += [("short", 0, "user", "only"), ("none", 0, "user", None), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    whole = {r.conv_id: r.text for r in render_conversations(df).collect()}
    built = {}
    for r in sorted(conversation_segments(df).collect(), key=lambda r: (str(r.conv_id), r.turn)):
        text = built.get(r.conv_id, "")
        text += "\n\n" if text else ""
        assert len(text) == r.start
        built[r.conv_id] = text + r.segment
    assert built["long"] == whole["long"] and built["short"] == whole["short"] and built[None] == whole[None] and "none" not in built


def test_systems_are_judged_once(spark, tmp_path):
    """Stored scores are read for the systems that are asked for, from whole batches; ``force`` judges anew."""
    from turnloom.operators.rubrics import RUBRICS
    from turnloom.plans import evaluation as ev
    from turnloom.sources.sinks import ScoreCache

    rows = [(str(i), f"text {i}", "paper") for i in range(4)]
    df = spark.createDataFrame(rows, "row_id string, conversation string, sc_intro string")
    folder = str(tmp_path / "scores")
    reply = lambda n: lambda prompt: F.lit(f'{{"reasons": "r", "score": {n}}}')
    never = lambda prompt: F.raise_error(F.lit("judged again")).cast("string")
    one, grid = RUBRICS[:2], 2 * 4
    assert ev.evaluate_systems({"a": df}, one, "judge", folder, model=reply(1)).count() == grid
    both = ev.evaluate_systems({"a": df, "b": df}, one, "judge", folder, model=reply(2))
    assert {(r.system, r.score): r["count"] for r in both.groupBy("system", "score").count().collect()} == {("a", 1): grid, ("b", 2): grid}
    assert ev.evaluate_systems({"a": df, "b": df}, one, "judge", folder, model=never).count() == 2 * grid
    cache = ScoreCache(spark, folder)
    plan = cache.read("judge", ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(evaluator" in plan and cache.read("other", ["a"]) is None
    again = ev.evaluate_systems({"b": df}, one, "judge", folder, force=True, model=reply(3))
    assert {r.score for r in again.collect()} == {3} and again.count() == grid
    # a batch that was not finished does not count
    (tmp_path / "scores" / "batch-000009" / "evaluator=judge").mkdir(parents=True)
    assert cache.read("judge", ["a", "b"]).count() == 2 * grid
    more = ev.evaluate_systems({"c": df}, one, "judge", folder, model=reply(1))
    assert more.count() == grid and cache.batches()[-1].endswith("batch-000010")


def test_publishing_does_not_break_readers(spark, tmp_path):
    from turnloom.sources.sinks import publish

    first = publish(spark.range(3).toDF("a"), "turnloom_numbers", str(tmp_path))
    reader = spark.table("turnloom_numbers")
    second = publish(spark.createDataFrame([("x", 1.0)], "b string, c double"), "turnloom_numbers", str(tmp_path))
    assert first != second and sorted(r.a for r in reader.collect()) == [0, 1, 2]
    assert [tuple(r) for r in spark.table("turnloom_numbers").collect()] == [("x", 1.0)]
    # the name keeps its version if a later one cannot be written
    with pytest.raises(Exception, match="cannot be made"):
        publish(spark.range(1).select(F.raise_error(F.lit("cannot be made")).alias("d")), "turnloom_numbers", str(tmp_path))
    assert spark.table("turnloom_numbers").columns == ["b", "c"]
    spark.sql("DROP VIEW turnloom_numbers")


def test_broken_rows_are_errors(spark, tmp_path):
    """A quoted line break is read with ``line_breaks``; without it the broken row fails, whatever columns are asked for."""
    from turnloom.sources import readers

    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"two\nlines"\n2,plain\n')
    schema = "a int, b string"
    assert [tuple(r) for r in readers.delimited(spark, str(path), schema, line_breaks=True).collect()] == [(1, "two\nlines"), (2, "plain")]
    for columns in (["a", "b"], ["a"]):
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
            readers.delimited(spark, str(path), schema).select(*columns).collect()
    path.write_text("a,b\n1,x\n2,y\n")
    assert readers.delimited(spark, str(path), schema).count() == 2


def stream_batches(spark, tmp_path, schema, batches, plan):
    """Run ``plan`` over one file per batch and give the rows it wrote."""
    source = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = plan(spark.readStream.schema(schema).parquet(str(source)))
        stm.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.parquet(str(tmp_path / "out")).collect()


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def test_streamed_examples_equal_the_batch(spark, tmp_path):
    """Out of order over the batches, numbered from 1, with more than 40 turns: rank counts and nothing is lost."""
    schema = "conv_id long, turn int, author string, text string, ts string"
    rows = [(c, t, "SRJ"[0 if t == 1 else 1 + t % 2], f"words of turn {t}", at(t)) for c in (1, 2) for t in range(1, 61)]
    moved = [r for r in rows if r[1] % 7 == 3]  # arrive one batch later
    cut = [[r for r in rows if lo < r[1] <= lo + 20 and r not in moved] + [r for r in moved if lo - 20 < r[1] <= lo] for lo in (0, 20, 40, 60)]
    end = [(9, 1, "R", "end", at(600))]
    got = stream_batches(spark, tmp_path, schema, [*cut, end, [(9, 2, "R", "end", at(601))]], lambda s: stm.turn_example_stream(s, "J", token_budget=30))
    from turnloom.operators.turns import turn_examples

    batch = spark.createDataFrame(rows, schema)
    want = {(r.conv_id, r.example): (r.completion, r.history_tokens, [m.content for m in r.prompt]) for r in turn_examples(batch, "J", token_budget=30).collect()}
    assert not any(r.late for r in got)
    assert {(r.conv_id, r.example): (r.completion, r.history_tokens, list(r.history)) for r in got} == want and len(got) == 38


def test_late_turns_are_told(spark, tmp_path):
    schema = "conv_id long, turn int, author string, text string, ts string"
    batches = [[(1, 0, "R", "a", at(0)), (1, 2, "J", "c", at(1))], [(2, 0, "R", "x", at(300))], [(1, 1, "R", "b", at(290)), (1, 3, "J", "d", at(291))], [(2, 1, "R", "y", at(600))], [(2, 2, "R", "z", at(601))]]
    got = stream_batches(spark, tmp_path, schema, batches, lambda s: stm.turn_example_stream(s, "J"))
    told = sorted((r.turn, r.late, r.completion, r.n_history) for r in got)
    assert told == [(1, True, "b", None), (2, False, "c", 1), (3, False, "d", 2)]


def test_sliding_means_with_late_rows(spark, tmp_path):
    schema = "grp string, value double, ts string"
    batches = [[("a", 1.0, at(10)), ("a", 3.0, at(50))], [("a", 5.0, at(70)), ("a", 7.0, at(20))], [("b", 1.0, at(400))], [("a", 100.0, at(15)), ("b", 2.0, at(401))], [("b", 3.0, at(800))]]
    got = stream_batches(spark, tmp_path, schema, batches, lambda s: stm.running_means(s, "grp", "value", slide="30 minutes"))
    means = {(r.grp, r.window_start.strftime("%H:%M")): (r["mean"], r.n_rows) for r in got if r.grp == "a"}
    # the row of minute 20 is late but counts; that of minute 15 comes after its windows have closed
    assert means == {("a", "23:30"): (4.0, 2), ("a", "00:00"): (11 / 3, 3), ("a", "00:30"): (4.0, 2), ("a", "01:00"): (5.0, 1)}


def test_first_arrivals_forget_and_remember(spark, tmp_path):
    schema = "user_id long, ts string"
    batches = [[(1, at(0)), (1, at(5))], [(1, at(30)), (2, at(31))], [(3, at(500))], [(1, at(501)), (3, at(502))], [(3, at(503))]]
    got = stream_batches(spark, tmp_path, schema, batches, lambda s: stm.first_arrivals(s, "user_id"))
    assert sorted(r.user_id for r in got) == [1, 1, 2, 3]


def test_session_documents_of_a_stream(spark, tmp_path):
    schema = "user_id long, role string, content string, paper_title string, paper_text string, ts string"
    row = lambda u, m, who, say: (u, who, say, f"Paper {u}.pdf", "text", at(m))
    batches = [[row(1, 0, "user", "hi"), row(2, 1, "user", "alone")], [row(1, 20, "user", "more?"), row(1, 10, "assistant", "hello")], [row(3, 600, "user", "x")], [row(3, 1200, "user", "y")]]
    got = stream_batches(spark, tmp_path, schema, batches, stm.chat_session_documents)
    assert [(r.user_id, r.session_key) for r in got] == [(1, "Paper_1_2024-01-01_00-00-00")]
    assert [m["content"] for m in json.loads(got[0].session)["messages"]] == ["hi", "hello", "more?"]


def test_session_documents(spark):
    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([("A b.pdf", "t", [("user", "x")]), ("A b.pdf", "t", [("user", "x"), ("assistant", "y")])], f"paper_title string, paper_text string, messages {m}")
    out = stm.session_documents(df.withColumn("date", F.lit("2024-01-02 03:04:05").cast("timestamp"))).collect()
    assert len(out) == 1 and out[0].session_key == "A_b_2024-01-02_03-04-05" and json.loads(out[0].session)["messages"][1]["content"] == "y"


def test_no_local_checkpoint_or_cross_join():
    from pathlib import Path

    folder = Path(__file__).resolve().parents[1] / "turnloom"
    code = "\n".join(p.read_text() for p in folder.rglob("*.py") if p.relative_to(folder).parts[0] != "llm")
    assert not re.search(r"localCheckpoint|crossJoin|\.toPandas\(|\.collect\(\)", code)


def test_steps_need_a_shared_folder_off_the_local_master(monkeypatch):
    import types

    from turnloom import session

    def fake(master, conf=None):
        sc = types.SimpleNamespace(master=master, setCheckpointDir=lambda folder: None, applicationId="x")
        return types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda key, default: conf or default))

    monkeypatch.setattr(session, "_has_checkpoint_dir", lambda spark: False)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "s3a://shared/steps")) == "s3a://shared/steps"
    assert session.shared_dir(fake("local[4]")) and session.shared_dir(fake("local"))


def test_steps_are_dropped(spark):
    import os

    from turnloom import session

    before = session.fresh_dir(spark, "probe")
    step = session.durable(spark.range(5))
    folder = step.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and session.drop_steps(spark) >= 2
    assert not os.path.isdir(folder) and not os.path.isdir(before) and session.drop_steps(spark) == 0
