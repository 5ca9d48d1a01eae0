"""Benchmark evaluation: every task projects to one pair table, one scoring stage, one metric plan per kind.

Adding a task is one registry line. All tasks (and all systems) are scored and evaluated together, grouped by
task, instead of one job per task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import labels as lb
from turnloom.functions import text as tx
from turnloom.operators import stats as st
from turnloom.operators.reports import metric_table
from turnloom.operators.stages import score_pairs
from turnloom.session import bound_batches, durable

REGRESSION, BINARY, THREE_WAY = 0, 1, 2
Project = Callable[[DataFrame], DataFrame]

# fixed values: single templates and zero-shot label templates in label order
SENTIMENT, GRAMMAR, OBJECTIVE = "It was great.", "It was correct.", "It was objective."
REVIEW_TEMPLATES = ("It was terrible.", "It was bad.", "It was ok.", "It was good.", "It was great.")
NEWS_TEMPLATES = ("It is world news.", "It is sports news.", "It is business news.", "It is science news.")
QUESTION_TEMPLATES = (
    "It is description.", "It is entity.", "It is expression.", "It is human.", "It is number.", "It is location.",
)

COLUMNS = {
    "item_id": "string", "grps": "array<string>", "pos": "int", "premise": "string", "hypothesis": "string",
    "label": "double", "label_bin": "double", "label_rel": "double", "is_answer": "boolean", "split": "string",
}


@dataclass(frozen=True)
class Task:
    """``head`` picks the scorer output, ``metrics`` the reports, ``project`` maps the raw table to pairs."""

    name: str
    head: int
    metrics: tuple[str, ...]
    project: Project


def _unified(df: DataFrame, **cols: Column | str) -> DataFrame:
    """Select the pair columns; what a task does not use is null, the group defaults to ``all``."""
    out = []
    for name, kind in COLUMNS.items():
        if name in cols:
            c = cols[name]
            c = F.col(c) if isinstance(c, str) else c
        elif name == "grps":
            c = F.array(F.lit("all"))
        elif name == "item_id":
            c = F.col("row_id")
        elif name == "split":
            c = F.lit("test")
        else:
            c = F.lit(None)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def pair(a: str, b: str, label: Column, binary: Column | None = None, rel: Column | None = None, clean: bool = False) -> Project:
    """Premise and hypothesis columns with a label, a binary label for AUC and a second label."""
    claim = tx.clean_claim(F.col(a), F.col(b)) if clean else F.col(b)
    cols = {"premise": F.col(a), "hypothesis": claim, "label": label, "label_bin": label if binary is None else binary}
    if rel is not None:
        cols["label_rel"] = rel
    return lambda df: _unified(df, **cols)


def choices(context: Column, question: str | None, options: Column, correct: Column, blanks: bool = False) -> Project:
    """One row per option; the answer is the option at ``correct``."""

    def project(df: DataFrame) -> DataFrame:
        rows = df.select("row_id", context.alias("_p"), F.col(question).alias("_q") if question else F.lit("").alias("_q"),
                         correct.alias("_y"), F.posexplode(options).alias("pos", "_o"))
        told = F.col("_o")
        if question:
            told = F.concat(F.col("_q"), F.lit(" "), F.col("_o"), F.lit(" "))
        if blanks:
            told = tx.fill_blank(F.col("_q"), F.col("_o"))
        return _unified(rows, pos="pos", premise="_p", hypothesis=told, is_answer=F.col("pos") == F.col("_y"))

    return project


def templates(text: str, label: str, names: Sequence[str]) -> Project:
    """Zero-shot classes: each text meets every template; an in-row explode of a literal list."""
    return choices(F.col(text), None, F.array(*[F.lit(t) for t in names]), F.col(label))


def template(text: str, label: Column, name: str) -> Project:
    return lambda df: _unified(df, premise=text, hypothesis=F.lit(name), label=label, label_bin=label)


def system_summaries(df: DataFrame, score: str, relevance: str | None = None, clean: bool = True) -> DataFrame:
    """Keyed documents (row_id, src, system, sys_summ, scores) as pairs."""
    claim = tx.clean_claim(F.col("src"), F.col("sys_summ")) if clean else F.col("sys_summ")
    cols = {"item_id": F.concat_ws("/", "row_id", "system"), "premise": "src", "hypothesis": claim,
            "label": F.col(score), "label_bin": lb.at_least(F.col(score), 4)}
    if relevance:
        cols["label_rel"] = F.col(relevance)
    return _unified(df, **cols)


def ranked_summaries(df: DataFrame) -> DataFrame:
    """Two systems per document; ``pos`` is the system's place (0 or 1)."""
    return _unified(df, pos="place", premise="src", hypothesis="sys_summ", label=F.col("fact"), label_bin=F.col("fact"))


def references(df: DataFrame) -> DataFrame:
    """One row per reference of a system text; the label is the text's quality."""
    rows = df.select("row_id", "sys_summ", "quality", F.posexplode("ref_summs").alias("pos", "_r"))
    return _unified(rows, pos="pos", premise="sys_summ", hypothesis="_r", label="quality")


def factuality_frank(df: DataFrame) -> DataFrame:
    """Reports per part and over both parts."""
    text = F.when(F.col("dataset") == "cnndm", F.col("document")).otherwise(F.array_join(tx.sentences(F.col("document")), " "))
    return _unified(
        df.withColumn("_d", text), grps=F.array("dataset", F.lit("all")), premise="_d",
        hypothesis=tx.clean_claim(F.col("_d"), F.col("summary")), label="score", label_bin=lb.equals(F.col("score"), 1.0),
    )


def dialogue_aspects(df: DataFrame) -> DataFrame:
    """Engagement against history and fact, grounding against the fact alone."""
    rows = F.array(
        F.struct(F.lit("engaging").alias("g"), F.concat("dialog_history", "fact").alias("p"), F.col("engaging").cast("double").alias("y")),
        F.struct(F.lit("grounded").alias("g"), F.col("fact").alias("p"), F.col("uses_knowledge").cast("double").alias("y")),
    )
    long = df.select("row_id", "response", F.explode(rows).alias("_a"))
    return _unified(long, grps=F.array("_a.g"), premise="_a.p", hypothesis="response", label="_a.y")


def by_language(df: DataFrame) -> DataFrame:
    return _unified(df, grps=F.array("lang"), premise="reference", hypothesis="candidate", label="score")


def with_validation(df: DataFrame) -> DataFrame:
    """Claims with a ``split`` of ``valid`` or ``test``; thresholds are tuned on the former."""
    claim = tx.clean_claim(F.col("document"), F.col("claim"))
    return _unified(df, premise="document", hypothesis=claim, label="label", label_bin="label", split="split")


def tasks() -> dict[str, Task]:
    """All benchmark tasks by name."""
    y = F.col("label")
    zero_is_one, neutral = lb.equals(y, 0), lb.known_or_neutral(y)
    corr, both, binary, three = ("corr",), ("corr", "auc"), ("f1", "accuracy", "auc"), ("three_way",)
    sent, nli = ("sentence1", "sentence2"), ("premise", "hypothesis")
    positive = lb.equals(F.col("label_text"), "positive")
    gap = F.array(*[tx.substitute_span(F.col("Text"), F.col("Pronoun_offset"), F.col("Pronoun"), F.col(n)) for n in "AB"])
    race = choices(F.col("article"), "question", F.col("options"), F.ascii("answer") - 65, blanks=True)
    fact3 = lb.fact_label(y)
    listed = [
        # correlation with a rating
        Task("stsb", REGRESSION, corr, pair(*sent, y)),
        Task("sick", REGRESSION, corr, pair("sentence_A", "sentence_B", F.col("relatedness_score"))),
        Task("yelp", BINARY, corr, pair("input_sent", "output_sent", F.col("preservation"))),
        # correlation and AUC
        Task("newsroom", BINARY, (*both, "corr_rel"), lambda d: system_summaries(d, "informativeness", "relevance")),
        Task("bagel", BINARY, both, _bagel),
        Task("summeval", BINARY, (*both, "corr_rel"),
             pair("document", "summary", F.col("consistency"), lb.equals(F.col("consistency"), 5.0), F.col("relevance"), True)),
        Task("qags_xsum", BINARY, both, pair("document", "summary", F.col("consistency"))),
        Task("qags_cnndm", BINARY, both, pair("document", "summary", F.col("consistency"), lb.equals(F.col("consistency"), 1.0))),
        Task("frank", BINARY, both, factuality_frank),
        Task("xsumfaith", BINARY, corr, pair("document", "claim", y, clean=True)),
        Task("samsum", BINARY, both, _samsum),
        # preference between two systems, best of several references
        Task("rank19", BINARY, ("corr", "preference"), ranked_summaries),
        Task("sfhot", BINARY, ("best_reference",), references),
        Task("sfres", BINARY, ("best_reference",), references),
        # multiple choice
        Task("race_m", BINARY, ("choice",), race),
        Task("race_h", BINARY, ("choice",), race),
        Task("boolq", BINARY, ("choice",), _boolq),
        Task("dream", BINARY, ("choice",), choices(F.array_join("dialogue", " "), "question", F.col("choice"), F.array_position("choice", F.col("answer")) - 1)),
        Task("quartz", BINARY, ("choice",), choices(F.col("para"), "question", F.col("choices.text"), F.array_position("choices.label", F.col("answerKey")) - 1)),
        Task("quail", BINARY, ("choice",), choices(F.col("context"), "question", F.col("answers"), F.col("correct_answer_id"))),
        Task("sciq", BINARY, ("choice",), choices(F.col("support"), "question", F.array("correct_answer", "distractor1", "distractor2", "distractor3"), F.lit(0))),
        Task("gap", BINARY, ("choice",), choices(F.col("Text"), None, gap, F.col("B_coref").cast("int"))),
        # three-way inference
        *[Task(n, THREE_WAY, three, pair(*nli, neutral)) for n in ("anli_1", "anli_2", "anli_3", "snli", "mnli_matched", "mnli_mismatched")],
        Task("nli_fever", THREE_WAY, three, pair("hypothesis", "premise", neutral)),
        Task("cb", THREE_WAY, three, pair(*nli, lb.commitment_label(y))),
        Task("vitaminc", THREE_WAY, ("three_way", "micro_f1"), pair("evidence", "claim", fact3)),
        # binary decisions
        Task("axb", BINARY, (*binary, "mcc"), pair(*sent, zero_is_one)),
        Task("axg", THREE_WAY, binary, pair(*nli, zero_is_one)),
        Task("rte", THREE_WAY, binary, pair(*nli, zero_is_one)),
        Task("wnli", THREE_WAY, binary, pair("text1", "text2", y)),
        Task("doc_nli", BINARY, binary, pair(*nli, lb.entailment_label(y))),
        Task("qnli", BINARY, binary, pair("sentence", "question", zero_is_one)),
        Task("eraser_multi_rc", BINARY, binary, _multi_rc),
        Task("mrpc", BINARY, binary, pair(*sent, y)),
        Task("paws", BINARY, binary, pair(*sent, y)),
        Task("paws_qqp", BINARY, binary, _wrapped),
        Task("qqp", BINARY, binary, pair("question1", "question2", y)),
        Task("sem_eval", BINARY, ("accuracy",), pair(*nli, lb.equals(F.col("entailment_judgment"), 1))),
        # one template
        *[Task(n, BINARY, binary, template("text", positive, SENTIMENT)) for n in ("sst2", "cr", "imdb", "imdb_knn")],
        Task("subj", BINARY, binary, template("text", lb.equals(F.col("label_text"), "objective"), OBJECTIVE)),
        Task("cola", BINARY, binary, template("sentence", y, GRAMMAR)),
        # one template per class
        Task("yelp_efl", BINARY, ("choice",), templates("text", "label", REVIEW_TEMPLATES)),
        Task("ag_news", BINARY, ("choice",), templates("text", "label", NEWS_TEMPLATES)),
        Task("trec", BINARY, ("choice",), templates("text", "label_coarse", QUESTION_TEMPLATES)),
        # per aspect, per language
        Task("persona_chat", BINARY, corr, dialogue_aspects),
        Task("topical_chat", BINARY, corr, dialogue_aspects),
        *[Task(f"wmt{n}", REGRESSION, corr, by_language) for n in (17, 18, 19)],
        # grounded text collections, and the ones with a tuned threshold
        *[Task(f"true_{n}", BINARY, binary, pair("grounding", "generated_text", y, clean=True)) for n in
          ("begin", "dialfact", "fever", "frank", "mnbm", "paws", "q2", "qags_cnndm", "qags_xsum", "summeval", "vitc")],
        *[Task(f"summac_{n}", BINARY, (*binary, "tuned"), with_validation) for n in
          ("cogensumm", "xsumfaith", "polytope", "factcc", "summeval", "frank")],
    ]
    return {t.name: t for t in listed}


def _bagel(df: DataFrame) -> DataFrame:
    score = F.col("informativeness")
    return _unified(df, premise=F.array_join("ref_summs", " "), hypothesis="sys_summ", label=score, label_bin=lb.at_least(score, 4.0))


def _samsum(df: DataFrame) -> DataFrame:
    y = lb.factuality_label(F.col("label"))
    return _unified(df, premise=tx.printable(F.col("article")), hypothesis="summary", label=y, label_bin=y)


def _boolq(df: DataFrame) -> DataFrame:
    rows = df.select("row_id", "passage", "question", F.col("answer").cast("int").alias("_y"),
                     F.posexplode(F.array(F.lit("No."), F.lit("Yes."))).alias("pos", "_o"))
    return _unified(rows, pos="pos", premise="passage", hypothesis=F.concat_ws(" ", "question", "_o"), is_answer=F.col("pos") == F.col("_y"))


def _multi_rc(df: DataFrame) -> DataFrame:
    claim = F.replace(F.col("query_and_answer"), F.lit("|"), F.lit(""))
    return _unified(df, premise="passage", hypothesis=claim, label=F.col("label").cast("int"), label_bin=F.col("label").cast("int"))


def _wrapped(df: DataFrame) -> DataFrame:
    fix = lambda c: tx.unwrap_bytes_literal(F.col(c))
    return _unified(df, premise=fix("sentence1"), hypothesis=fix("sentence2"), label="label", label_bin="label")


def candidate_pairs(tables: Mapping[str, DataFrame], system: str = "default") -> DataFrame:
    """All tasks' pairs in one table."""
    known, parts = tasks(), []
    for name, df in tables.items():
        bound_batches(df.sparkSession)
        task = known[name]
        parts.append(task.project(df).select(
            F.lit(system).alias("system"), F.lit(name).alias("task"), F.lit(task.head).alias("head"),
            F.array(*[F.lit(m) for m in task.metrics]).alias("metrics"), "*",
        ))
    while len(parts) > 1:  # in pairs, so that the plan is not analysed anew for every task
        parts = [a.union(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) - len(parts) % 2 :]
    return parts[0]


def scored_pairs(pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame] = score_pairs) -> DataFrame:
    """Scores of all pairs, written once because every metric reads them. ``pred`` is the task's head."""
    scored = scorer(pairs)
    pred = (
        F.when(F.col("head") == REGRESSION, F.col("reg"))
        .when(F.col("head") == BINARY, F.col("bin"))
        .otherwise(F.get("tri", F.lit(0)))
    )
    return durable(scored.withColumn("pred", pred).drop("premise", "hypothesis", "reg", "bin"))


def metrics(scored: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Long table ``(system, task, grp, metric, value)``; kinds no task asks for are not planned."""
    by = ["system", "task", "grp"]
    test = scored.where("split = 'test'").withColumn("grp", F.explode("grps"))
    kinds = list(kinds) if kinds is not None else sorted({m for t in tasks().values() for m in t.metrics})
    asked = lambda kind: test.where(F.array_contains("metrics", kind))
    out: list[DataFrame] = []

    def report(wide: DataFrame, names: Mapping[str, str]) -> None:
        # each kind's few result rows are written on their own, so the kinds never form one giant plan
        long = metric_table(wide.select(*by, *[F.col(c).alias(n) for c, n in names.items()]), by, list(names.values()))
        out.append(durable(long))

    same = {"pearson": "pearson", "spearman": "spearman", "kendall": "kendall"}
    if "corr" in kinds:
        report(st.correlations(asked("corr"), by), same)
    if "corr_rel" in kinds:
        report(st.correlations(asked("corr_rel"), by, "label_rel"), {k: f"{v}_rel" for k, v in same.items()})
    if "auc" in kinds:
        report(st.auc(asked("auc"), by, "label_bin"), {"auc": "auc"})
    for kind in ("f1", "accuracy", "mcc"):
        if kind in kinds:
            report(st.class_metrics(asked(kind), by, "label_bin"), {kind: kind})
    if "three_way" in kinds:
        report(st.three_way_accuracy(asked("three_way"), by), {"accuracy": "accuracy"})
    if "micro_f1" in kinds:
        report(st.three_way_accuracy(asked("micro_f1"), by), {"micro_f1": "micro_f1"})
    if "choice" in kinds:
        report(st.choice_accuracy(asked("choice"), "item_id", by, "pos", "pred"), {"accuracy": "accuracy"})
    if "preference" in kinds:
        ranked = asked("preference").withColumn("_pair", F.concat_ws("/", *by, "item_id"))
        called = st.pair_preference(ranked, "_pair", "pos")
        report(st.class_metrics(called, by, "label", "preferred"), {"accuracy": "accuracy"})
        report(st.auc(called, by, "label", "preferred"), {"auc": "auc"})
    if "best_reference" in kinds:
        best = st.best_reference(asked("best_reference"), "item_id", "pred", "label", by)
        report(st.correlations(best, by), same)
        report(st.auc(best, by), {"auc": "auc"})
    if "tuned" in kinds:
        valid = scored.where("split = 'valid'").withColumn("grp", F.explode("grps"))
        tuned = st.tune_threshold(valid, by, "label_bin")
        applied = st.apply_threshold(asked("tuned"), tuned, by, "label_bin")
        report(applied, {"balanced_accuracy": "balanced_accuracy", "threshold": "threshold"})
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def run_benchmark(
    tables: Mapping[str, DataFrame],
    scorers: Mapping[str, Callable[[DataFrame], DataFrame]] | Callable[[DataFrame], DataFrame] = score_pairs,
) -> DataFrame:
    """Metrics of all given tasks for one scorer, or for several named systems (checkpoints) at once."""
    named = scorers if isinstance(scorers, Mapping) else {"default": scorers}
    scored = None
    for system, scorer in named.items():
        part = scored_pairs(candidate_pairs(tables, system), scorer)
        scored = part if scored is None else scored.unionByName(part, allowMissingColumns=True)
    known = tasks()  # a second to make, so not once per table
    return metrics(scored, sorted({m for n in tables for m in known[n].metrics}))
