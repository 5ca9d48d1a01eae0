"""Hand-written rows for the rules the shared texts cannot reach."""

import re

import pytest
from pyspark.sql import functions as F

from turnloom.functions import dialogue as dg
from turnloom.functions import parsing as ps
from turnloom.functions import text as tx
from turnloom.functions.stemming import stem
from turnloom.operators import budget as bg
from turnloom.operators import masking as mk


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


def test_strip_removes_tabs_and_breaks(spark):
    assert one(spark, " \t\n a b  \n", tx.strip) == "a b"


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, []),
        ("**Journalist**: Hi: there\n\n**Researcher Name**: Yes", [("Journalist", " Hi: there"), ("Researcher", " Yes")]),
        ("x</think>y</think>**J**: a\n\nno marker: b\n\n**Researcher (R)**: c", [("Journalist", " a"), ("Researcher", " c")]),
        ("**J**: a\n\n**Reviewer**: b", []),
        (" **Journalist** : a", [("Journalist", " a")]),
        ("plain text", []),
    ],
)
def test_parse_dialogue(spark, raw, expected):
    assert [(t.author, t.text) for t in one(spark, raw, tx.parse_dialogue)] == expected


def test_parse_dialogue_can_stop_at_the_second_colon(spark):
    got = one(spark, "**J**: Hi: there", lambda c: tx.parse_dialogue(c, keep_later_colons=False))
    assert got[0].text == " Hi"


def test_questions(spark):
    text = "What now. It is so! Can we? Doing well. \n do it"
    assert one(spark, text, tx.questions) == ["What now.?", "Can we?", "do it?"]


def test_question_lexicon(spark):
    assert one(spark, "Tell me how it works. Fine. Really? Somehow.", tx.question_sentences) == ["Tell me how it works.", "Really?"]


def test_names(spark):
    assert one(spark, "Ask Dr. Jane Doe or Dr. X.", tx.mask_names) == "Ask [name] or Dr. X."


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a.\n\nb!\n\nc", "a.\n\nb!"),
        ("a.\n\nb.\n\nc.\n\nd.", "a.\n\nb.\n\nc."),
        (" cut off", " cut off"),
        ('He said "yes."\n\n', 'He said "yes."'),
    ],
)
def test_complete_paragraphs(spark, text, expected):
    assert one(spark, text, tx.complete_paragraphs) == expected


def python_mask(context, answers):
    for answer in sorted(answers, key=len, reverse=True):
        context = re.sub(rf"(?<![\w\-–]){re.escape(answer)}(?![\w\-–])", "", context, flags=re.IGNORECASE)
    return context


@pytest.mark.parametrize(
    "context, answers",
    [
        ("The cat-like Cat sat. CAT!", ["cat"]),
        ("Costs $5 (net) or $5", ["$5 (net)", "$5"]),
        ("Élan vital and élan", ["élan", "vital and"]),
        ("a\\Eb c", ["a\\Eb"]),
        ("nothing", []),
    ],
)
def test_mask_answers(spark, context, answers):
    df = spark.createDataFrame([(context, answers)], "c string, a array<string>")
    assert df.select(tx.mask_answers(F.col("c"), F.col("a"))).first()[0] == python_mask(context, answers)


def test_clean_claim(spark):
    df = spark.createDataFrame([("the NASA Nasa probe", "nasa's PROBE -lrb- ‘nasa’ -rrb- ok. the end")], "c string, h string")
    got = df.select(tx.clean_claim(F.col("c"), F.col("h"))).first()[0]
    assert got == "Nasa's probe ( 'nasa' ) ok. The end"


def test_small_helpers(spark):
    assert one(spark, "b'hi'", tx.unwrap_bytes_literal) == "hi"
    assert one(spark, " 7 ", tx.rating) == 7 and one(spark, "seven", tx.rating) == 0
    assert one(spark, "my paper: v1.2.pdf", tx.file_key) == "my_paper_v12"
    assert one(spark, "Score: 12\nReason: x", tx.judged_score) == 12
    assert one(spark, "a\nb\n c \n\nd", tx.topic_lines) == "b\nc"
    assert one(spark, "x Press Release Article\n t ", tx.article_body) == "t"


def test_reply_parsing(spark):
    bad = one(spark, "oops", ps.parse_json_reply)
    assert (bad.score, bad.parse_ok) == (5, False)
    assert one(spark, 'Well\n{"reason": "r", "score": "2"}', ps.parse_json_reply).score == 2
    got = one(spark, 'x</think>```json {"reasons": "a",\n "score": 3} ```', ps.parse_reasoned_reply)
    assert (got.score, got.reasons) == (3, "a")
    assert one(spark, "{}", ps.parse_structured_reply).reasons == "no reason"
    df = spark.createDataFrame([('{"high_quality_questions": ["a"]}', ["a", "b"]), ("bad", ["a"]), ('{"high_quality_questions": []}', [])], "r string, q array<string>")
    assert [r.s for r in df.select(ps.parse_question_reply(F.col("r"), F.col("q"))["score"].alias("s")).collect()] == [0.5, 0.0, 0.0]


def test_open_answer_and_render(spark):
    prompt = [("system", "s"), ("user", "[PAPER-TITLE]\nt\n[PAPER]\np"), ("assistant", "Journalist: q"), ("user", "a")]
    df = spark.createDataFrame([(prompt,), (prompt[:3],), (prompt[:2],)], "p array<struct<role:string,content:string>>")
    assert [r[0] for r in df.select(dg.open_answer(F.col("p"))).collect()] == ["a", None, None]
    assert df.select(dg.render(F.col("p"))).first()[0] == "Journalist: q\n\nResearcher: a"
    assert df.select(dg.paper_of(F.col("p"))).first()[0] == "\np"


def test_sentence_budgets(spark):
    text = "One two. Three four five. Six."
    assert one(spark, text, lambda c: bg.leading_sentences(c, 4)) == "One two."
    assert one(spark, text, lambda c: bg.leading_sentences(c, 2)) == ""
    assert one(spark, text, lambda c: bg.leading_sentences(c, 100)) == text
    assert one(spark, text, lambda c: bg.leading_sentences(c, 4, include_crossing=True)) == "One two. Three four five. "


def test_paper_context(spark):
    rows = [
        (["1. Introduction", "ABSTRACT"], ["intro", "abs"], "x"), (["Methods"], ["m"], "a b c"), ([], [], "S one. S two."), (None, None, "S one."),
    ]
    df = spark.createDataFrame(rows, "n array<string>, s array<string>, a string")
    got = [r[0] for r in df.select(bg.paper_context(F.col("n"), F.col("s"), F.col("a"), limit=2)).collect()]
    assert got == ["abs\nintro", "a b c", "S one. ", "S one. "]


def test_mask_share_counts(spark):
    got = one(spark, " ".join(f"w{i}" for i in range(41)), lambda c: mk.mask_share(c, F.lit(1), 0.25))
    assert got.split().count(mk.MASK) == 10


@pytest.mark.parametrize("word, expected", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("agreed", "agre"), ("sky", "sky"), ("adjustment", "adjust"), ("controlling", "control")])
def test_stem(word, expected):
    assert stem(word) == expected


def test_case_map_keeps_the_last_spelling(spark):
    df = spark.createDataFrame([("The NATO met nato. The Nato in Paris", "the nato in paris, rome"), ("", "a b"), (None, "x y")], "c string, h string")
    known = df.select(tx.case_map(F.col("c"))).collect()
    assert known[0][0] == {"the": "The", "nato": "Nato", "met": "met", "nato.": "nato.", "in": "in", "paris": "Paris"}
    assert known[1][0] == {} and known[2][0] == {}
    got = [r[0] for r in df.select(tx.clean_claim(F.col("c"), F.col("h"))).collect()]
    assert got == ["The Nato in paris, rome", "A b", "X y"]
    assert got == [r[0] for r in df.select(tx.clean_claim_by(tx.case_map(F.col("c")), F.col("h"))).collect()]
