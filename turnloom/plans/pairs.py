"""Training pairs: many labelled-text datasets in one format.

Every dataset has a reader entry and one builder family. Output rows are
``(dataset, task, row_id, text_a, text_b array, text_c array, orig_label)``; label -1 means that ``text_b`` holds only
right and ``text_c`` only wrong texts. Input tables carry a unique ``row_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import labels as lb
from turnloom.functions import text as tx
from turnloom.functions.binding import let
from turnloom.functions.hashing import hash_index, hash_key
from turnloom.operators.keyphrases import key_phrases
from turnloom.operators.lexical import bleu_of_tokens
from turnloom.operators.masking import infill_next_word, mask_share
from turnloom.operators.stages import joined_answer
from turnloom.operators.summaries import extractive_summary
from turnloom.session import durable
from turnloom.sources import readers

Builder = Callable[[DataFrame], DataFrame]
Made = Callable[[], Column]
YES, NO = "Yes.", "No."
LETTERS = {"A": 0, "B": 1, "C": 2, "D": 3}


def _none() -> Column:
    return F.array().cast("array<string>")


def _row(a: Column, b: Column, c: Column, label: Column, *more: Column) -> list[Column]:
    return [
        F.col("row_id"), a.alias("text_a"), b.alias("text_b"), c.alias("text_c"), label.cast("double").alias("orig_label"), *more,
    ]


def _spread(df: DataFrame, entries: Column) -> DataFrame:
    """One output row per struct(a, b, c, y) of ``entries``."""
    return df.select("row_id", F.explode(entries).alias("_e")).select(
        "row_id", F.col("_e.a").alias("text_a"), F.col("_e.b").alias("text_b"), F.col("_e.c").alias("text_c"),
        F.col("_e.y").cast("double").alias("orig_label"),
    )


def _entry(a: Column, b: Column, c: Column, y: Column) -> Column:
    return F.struct(a.alias("a"), F.array(b).alias("b"), c.alias("c"), y.cast("int").alias("y"))


def plain(a: str, b: str, label: str, convert: Callable[[Column], Column] = lambda c: c, fix: Callable[[Column], Column] = lambda c: c) -> Builder:
    """Two text columns and a label, each through its conversion."""
    return lambda df: df.select(*_row(fix(F.col(a)), F.array(fix(F.col(b))), _none(), convert(F.col(label))))


def options(
    context: str, question: str, choices: Made, correct: Made, blanks: bool = False, statement: bool = False
) -> Builder:
    """One row per answer option, label 1 for the right one. ``choices`` and ``correct`` make their columns when asked.

    Options sit in ``text_c``; with ``blanks`` a gapped question is filled instead, with ``statement`` question and
    option become one text.
    """

    def entry(option: Column, i: Column) -> Column:
        q = F.col(question)
        y = (i == correct()).cast("int")
        if statement:
            told = _entry(F.col(context), joined_answer(q, option), _none(), y)
        else:
            told = _entry(F.col(context), q, F.array(option), y)
        if not blanks:
            return told
        gap = F.replace(q, F.lit("_"), F.concat(F.lit(" "), option, F.lit(" ")))
        filled = _entry(F.col(context), tx.squeeze(gap), _none(), y)
        return F.when(q.contains("_"), filled).otherwise(told)

    return lambda df: _spread(df, F.transform(choices(), entry))


def yes_no(context: Made, question: str, answer: str) -> Builder:
    """The right and the wrong short answer to a yes/no question."""

    def build(df: DataFrame) -> DataFrame:
        right = F.when(F.col(answer), F.lit(YES)).otherwise(F.lit(NO))
        wrong = F.when(F.col(answer), F.lit(NO)).otherwise(F.lit(YES))
        entry = lambda text, y: _entry(context(), F.col(question), F.array(text), F.lit(y))
        return _spread(df, F.array(entry(right, 1), entry(wrong, 0)))

    return build


def coreference(df: DataFrame) -> DataFrame:
    """The pronoun replaced by each candidate name."""
    put = lambda name: tx.substitute_span(F.col("Text"), F.col("Pronoun_offset"), F.col("Pronoun"), F.col(name))
    entry = lambda name: _entry(F.col("Text"), put(name), _none(), F.col(f"{name}_coref"))
    return _spread(df, F.array(entry("A"), entry("B")))


def passages(df: DataFrame) -> DataFrame:
    """One row per passage of a query with at least one selected passage."""
    answered = df.where(F.exists("is_selected", lambda s: s == 1))
    zipped = F.arrays_zip("passage_text", "is_selected")
    entries = F.transform(
        zipped, lambda p: _entry(p["passage_text"], F.col("query"), _none(), (p["is_selected"] == 1))
    )
    return _spread(answered, entries)


def negative_answers(
    no_answer_only: bool = True, fake: Callable[[Column, Column], Column] | None = None
) -> Builder:
    """Question answering rows ``(context, question, answers)``: a right row where answers exist, and a wrong row with
    a made-up answer where none exists (or always). The made-up answer is drawn from the context without answers."""
    fake = fake or (lambda question, context: F.coalesce(tx.first_word(context), F.lit("no answer")))

    def build(df: DataFrame) -> DataFrame:
        some = F.coalesce(F.size("answers"), F.lit(0)) > 0
        masked = tx.mask_answers(F.col("context"), F.coalesce(F.col("answers"), _none()))
        right = F.when(some, F.array(_entry(F.col("context"), F.col("question"), F.col("answers"), F.lit(1))))
        made_up = _entry(F.col("context"), F.col("question"), F.array(fake(F.col("question"), masked)), F.lit(0))
        wrong = F.array(made_up)
        if no_answer_only:
            wrong = F.when(~some, wrong)
        empty = F.array().cast("array<struct<a:string,b:array<string>,c:array<string>,y:int>>")
        return _spread(df, F.concat(F.coalesce(right, empty), F.coalesce(wrong, empty)))

    return build


def multi_hop_context(df: DataFrame, seed: object = 0) -> DataFrame:
    """Supporting paragraphs, one other paragraph when fewer than four, in hash order, joined by line breaks."""
    docs = F.transform(
        F.arrays_zip("titles", "sentences"),
        lambda d: F.struct(
            F.array_contains("supporting_titles", d["titles"]).alias("hit"), F.array_join(d["sentences"], "").alias("text")
        ),
    )

    def pick(ds: Column) -> Column:
        good, other = F.filter(ds, lambda d: d["hit"]), F.filter(ds, lambda d: ~d["hit"])
        extra = lambda o: F.slice(o, hash_index(seed, F.size(o), F.col("row_id")).cast("int") + 1, F.lit(1))
        added = let(other, lambda o: F.when(F.size(o) > 0, extra(o)).otherwise(o))
        chosen = F.when(F.size(good) < 4, F.concat(good, added)).otherwise(good)
        ordered = F.array_sort(
            F.transform(chosen, lambda d, i: F.struct(hash_key(f"{seed}-order", F.col("row_id"), i).alias("h"), d["text"].alias("t")))
        )
        return F.array_join(F.transform(ordered, lambda d: d["t"]), "\n")

    return df.select(
        "row_id", let(docs, pick).alias("context"), "question", F.array("answer").alias("answers")
    )


def story_questions(df: DataFrame, max_bad: float = 0.2) -> DataFrame:
    """Training stories to question rows; questions rated bad above the limit are dropped."""
    asked = df.where(F.col("type") == "train").select(
        "row_id", F.col("text").alias("context"), F.posexplode("questions").alias("_n", "_q")
    )
    good = asked.where(F.coalesce(F.col("_q.isQuestionBad"), F.lit(0.0)) <= max_bad)
    start, end = F.col("_q.consensus.s"), F.col("_q.consensus.e")
    found = F.when(start.isNotNull(), F.array(tx.span(F.col("context"), start, end))).otherwise(_none())
    return good.select(
        F.concat_ws("-", F.col("row_id").cast("string"), F.col("_n").cast("string")).alias("row_id"),
        "context", F.col("_q.q").alias("question"), found.alias("answers"),
    )


def extractive_answers(df: DataFrame, k: int = 5, limit: float = 0.6) -> DataFrame:
    """Right answers against key phrases of the context that do not resemble them (BLEU-3 below ``limit``)."""
    # at most k short rows per context, read three times below
    phrases = durable(key_phrases(df, "row_id", "context", k).select("row_id", "rank", "phrase"))
    listed = phrases.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("_p"))
    tokens = df.select("row_id", F.transform("answers", lambda a: tx.words(F.lower(a))).alias("_refs")).join(listed, "row_id")
    base = tokens.select("row_id", "_refs", F.transform("_p", lambda p: F.split(p["phrase"], " ")).alias("_hyps"))
    gate = bleu_of_tokens(base, "row_id", 3, (0.33, 0.33, 0.33)).where(F.col("bleu") < limit)
    wrong = (
        gate.join(phrases.withColumn("hyp", F.col("rank") - 1), ["row_id", "hyp"])
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("_w"))
    )
    full = df.join(wrong, "row_id", "left")
    right = F.transform("answers", lambda a: F.concat(F.col("question"), F.lit(" "), a))
    negatives = F.transform(
        F.coalesce(F.col("_w"), F.array().cast("array<struct<rank:int,phrase:string>>")),
        lambda w: F.concat(F.col("question"), F.lit(" "), w["phrase"]),
    )
    return full.select(*_row(F.col("context"), right, negatives, F.lit(-1)))


def statements(df: DataFrame, answer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Questions turned into statements: the first answer is right, a guess for unanswerable ones is wrong."""
    guess = answer or (lambda question, context: tx.last_word(context))
    some = F.size("answers") > 0
    told = joined_answer(
        F.col("question"), F.when(some, F.get("answers", F.lit(0))).otherwise(guess(F.col("question"), F.col("context")))
    )
    return df.select(*_row(F.col("context"), F.array(told), _none(), some.cast("int")))


def summaries(document: str, summary: str, share: float = 0.25) -> Builder:
    """Gold and extracted summary against both with a share of their words replaced."""

    def build(df: DataFrame) -> DataFrame:
        made = extractive_summary(df, document, "_extract")
        bad = lambda c, tag: infill_next_word(F.col(c), mask_share(F.col(c), F.col("row_id"), share, tag))
        return made.select(
            *_row(
                F.col(document),
                F.array(F.col(summary), F.col("_extract")),
                F.array(bad(summary, "gold"), bad("_extract", "extract")),
                F.lit(-1),
            )
        )

    return build


def paraphrases(a: str, b: str, share: float = 0.25) -> Builder:
    """A paraphrase and its corrupted copy."""

    def build(df: DataFrame) -> DataFrame:
        bad = infill_next_word(F.col(b), mask_share(F.col(b), F.col("row_id"), share, "gold"))
        return _spread(
            df,
            F.array(_entry(F.col(a), F.col(b), _none(), F.lit(1)), _entry(F.col(a), bad, _none(), F.lit(0))),
        )

    return build


@dataclass(frozen=True)
class Source:
    """Where a dataset's rows come from."""

    format: str = "parquet"
    split: str | None = "train"
    config: str | None = None


@dataclass(frozen=True)
class Dataset:
    name: str
    task: str
    build: Builder
    source: Source = Source()


def _letter(column: str) -> Column:
    out = F.lit(None).cast("int")
    for letter, i in LETTERS.items():
        out = F.when(F.col(column) == letter, F.lit(i)).otherwise(out)
    return out


def _qa(always: bool, prepare: Builder = lambda df: df) -> Builder:
    return lambda df: negative_answers(no_answer_only=not always)(prepare(df))


def _renamed(**columns: str) -> Builder:
    return lambda df: df.select("row_id", *[F.col(old).alias(new) for new, old in columns.items()])


def datasets() -> dict[str, Dataset]:
    """All dataset entries by name."""
    nli = plain("premise", "hypothesis", "label")
    sentences = plain("sentence1", "sentence2", "label")
    asked = plain("question1", "question2", "label")
    rated = plain("ref", "mt", "score")
    col = lambda name: lambda: F.col(name)
    race = ("article", "question", col("options"), lambda: _letter("answer"))
    sciq = lambda: F.array("distractor1", "distractor2", "distractor3", "correct_answer")
    lines, array = Source("json", None), Source("json_array", None)
    entries = [
        # three-way inference
        *[Dataset(n, "nli", nli) for n in ("mnli", "anli_r1", "anli_r2", "anli_r3", "snli")],
        # paraphrase
        Dataset("paws", "paraphrase", sentences, Source(config="labeled_final")),
        Dataset("paws_val", "paraphrase", sentences, Source(split="validation", config="labeled_final")),
        Dataset("paws_unlabeled", "paraphrase", sentences, Source(config="unlabeled_final")),
        Dataset("mrpc", "paraphrase", sentences),
        Dataset("mrpc_val", "paraphrase", sentences, Source(split="validation")),
        Dataset("qqp", "paraphrase", asked),
        Dataset("qqp_val", "paraphrase", asked, Source(split="validation")),
        Dataset("paws_qqp", "paraphrase", plain("sentence1", "sentence2", "label", fix=tx.unwrap_bytes_literal), Source("tsv", None)),
        Dataset("wiki103", "paraphrase", paraphrases("original_sent", "paraphrase"), lines),
        # translation quality
        *[Dataset(f"wmt{y}", "wmt", rated, lines) for y in (15, 16, 17, 18, 19)],
        # mapped labels
        Dataset("nli_fever", "fact_checking", plain("context", "query", "label", lb.fact_label), lines),
        Dataset("vitaminc", "fact_checking", plain("evidence", "claim", "label", lb.fact_label)),
        Dataset("doc_nli", "bin_nli", plain("premise", "hypothesis", "label", lb.entailment_label), array),
        Dataset("eraser_multi_rc", "qa", _multi_rc),
        Dataset("stsb", "sts", plain("sentence1", "sentence2", "label", lb.fifth)),
        Dataset("sick", "sts", plain("sentence_A", "sentence_B", "relatedness_score", lb.fifth)),
        # multiple choice
        Dataset("race", "qa", options(*race, blanks=True)),
        Dataset("race_val", "qa", options(*race, blanks=True, statement=True), Source(split="validation")),
        Dataset("race_test", "qa", options(*race, blanks=True), Source(split="test")),
        Dataset("quail", "qa", options("context", "question", col("answers"), col("correct_answer_id"))),
        Dataset("sciq", "qa", options("support", "question", sciq, lambda: F.lit(3))),
        Dataset("boolq", "qa", yes_no(col("passage"), "question", "answer")),
        Dataset("strategy_qa", "qa", yes_no(lambda: F.array_join("facts", " "), "question", "answer")),
        Dataset("gap", "coreference", coreference),
        Dataset("msmarco", "ir", passages),
        # questions with made-up answers
        Dataset("squad_v2_new", "qa", _qa(False)),
        Dataset("adversarial_qa", "qa", _qa(True)),
        Dataset("quoref", "qa", _qa(True)),
        Dataset("drop", "qa", _qa(True, _renamed(context="passage", question="question", answers="answers_spans"))),
        Dataset("duorc_self", "qa", _qa(True, _renamed(context="plot", question="question", answers="answers"))),
        Dataset("duorc_paraphrase", "qa", _qa(True, _renamed(context="plot", question="question", answers="answers"))),
        Dataset("ropes", "qa", _qa(True, _situations)),
        Dataset("newsqa", "qa", _qa(True, story_questions), array),
        Dataset("hotpot_qa_distractor", "qa", _qa(True, multi_hop_context), Source(config="distractor")),
        Dataset("hotpot_qa_fullwiki", "qa", _qa(True, multi_hop_context), Source(config="fullwiki")),
        Dataset("squad", "extractive_qa", extractive_answers),
        Dataset("squad_v2", "qa", statements),
        # summaries
        Dataset("xsum", "summarization", summaries("document", "summary")),
        Dataset("cnndm", "summarization", summaries("article", "highlights")),
        Dataset("wikihow", "summarization", summaries("text", "headline")),
    ]
    return {d.name: d for d in entries}


def _multi_rc(df: DataFrame) -> DataFrame:
    text = F.replace(F.col("query_and_answer"), F.lit("|"), F.lit(""))
    return df.select(*_row(F.col("passage"), F.array(text), _none(), F.col("label").cast("int")))


def _situations(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.concat_ws(" ", "situation", "background").alias("context"), "question", "answers")


def build_pairs(name: str, df: DataFrame) -> DataFrame:
    """Pairs of one dataset."""
    entry = datasets()[name]
    built = entry.build(df).withColumn("row_id", F.col("row_id").cast("string"))
    return built.select(F.lit(entry.name).alias("dataset"), F.lit(entry.task).alias("task"), *built.columns)


def build_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Pairs of several datasets in one table."""
    out = None
    for name, df in tables.items():
        built = build_pairs(name, df)
        out = built if out is None else out.unionByName(built)
    return out


def read_dataset(spark: SparkSession, name: str, path: str, schema: str) -> DataFrame:
    """Raw rows of a registered dataset from its file format and split."""
    source = datasets()[name].source
    if source.format == "tsv":
        return readers.delimited(spark, path, schema, "\t")
    if source.format == "json":
        return readers.json_any(spark, path, schema)
    if source.format == "json_array":
        return readers.json_array(spark, path, schema)
    if source.split:
        return readers.named_split(spark, path, source.split, source.config)
    return readers.columnar(spark, path, schema)
