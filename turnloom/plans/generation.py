"""Text and conversation generation around a plug-in model.

Conversations grow in a log of turns: each step of a conversation appends a table of keys and replies, and the papers,
stored once, meet the log only when a prompt is made. A log that was given a folder goes on from its last whole step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import dialogue as dg
from turnloom.functions import text as tx
from turnloom.operators.budget import leading_sentences, within_budget
from turnloom.operators.judging import input_column
from turnloom.operators.rubrics import FIXED_QUESTIONS, Rubric
from turnloom.operators.stages import Client, echo_reply, generate
from turnloom.session import fresh_dir, path_exists

Model = Callable[[Column], Column] | Callable[[], Client]


def generate_from_prompt(
    df: DataFrame,
    prompt: Rubric,
    output: str,
    model: Model = echo_reply,
    native: bool = True,
    max_input_tokens: int = 15000,
    cut: bool = True,
) -> DataFrame:
    """One generated text per row; the inputs are cut to the token budget, or over-long rows dropped.

    The instruction goes in front of the inputs and does not count towards the budget.
    """
    ready = df.withColumn("_inputs", input_column(prompt, df.columns, ":\n"))
    if cut:
        ready = ready.withColumn("_inputs", leading_sentences(F.col("_inputs"), max_input_tokens))
    else:
        ready = within_budget(ready, "_inputs", max_input_tokens, name="_n").drop("_n")
    full = F.concat_ws("\n\n", F.lit(prompt.instruction), F.col("_inputs"))
    return generate(ready, full, output, model, native).drop("_inputs", f"{output}_error")


def full_conversations(df: DataFrame, prompt: Rubric, model: Model, native: bool = True, **how) -> DataFrame:
    """One-shot dialogue generation, parsed into turns."""
    made = generate_from_prompt(df, prompt, "conversation", model, native, **how)
    return made.withColumn("parsed_conv", tx.parse_dialogue(F.col("conversation")))


def press_releases(df: DataFrame, prompt: Rubric, model: Model = echo_reply, native: bool = True, limit: int = 5000) -> DataFrame:
    made = generate_from_prompt(df, prompt, "gen_pr", model, native, limit)
    return made.withColumn("parsed_pr_article", tx.article_body(F.col("gen_pr")))


def paper_releases(
    df: DataFrame, instruction: str, model: Model = echo_reply, native: bool = True, conversation: str | None = None
) -> DataFrame:
    """Press release from the paper alone, or from the paper and a conversation."""
    text = F.concat(F.lit(instruction + "\n\n[PAPER]:"), F.col("paper_text"))
    if conversation:
        text = F.concat(text, F.lit("\n\n[CONVERSATION]:"), F.col(conversation))
    return generate(df, text, "press_release", model, native).withColumn("press_release", tx.strip(F.col("press_release")))


def topics(df: DataFrame, prompt: Rubric, model: Model = echo_reply, native: bool = True, limit: int = 15000) -> DataFrame:
    """Topic lists; over-long inputs are left out."""
    made = generate_from_prompt(df, prompt, "topics_raw", model, native, limit, cut=False)
    return made.withColumn("parsed_topics", tx.topic_lines(F.col("topics_raw")))


#: What an article is turned into a paragraph by.
SUMMARY_INSTRUCTION = "Summarise this article in one paragraph."


def article_summaries(
    df: DataFrame, model: Model = echo_reply, native: bool = True, source: str = "pr_article", output: str = "pr_summary", instruction: str = SUMMARY_INSTRUCTION
) -> DataFrame:
    """One paragraph per article, whole articles as input; a null article has no summary and is not sent."""
    asked = df.where(F.col(source).isNotNull())
    made = generate(asked, F.concat(F.lit(instruction + "\n\n"), F.col(source)), output, model, native)
    made = made.withColumn(output, tx.strip(F.col(output)))
    rest = df.where(F.col(source).isNull()).withColumn(output, F.lit(None).cast("string"))
    return made.unionByName(rest, allowMissingColumns=True)


def _reply(prompt: Column, df: DataFrame, model: Model, native: bool) -> DataFrame:
    made = generate(df, prompt, "reply", model, native)
    return made.withColumn("reply", tx.complete_paragraphs(tx.strip(F.col("reply"))))


def _views(title: Column, paper: Column, history: Column) -> tuple[Column, Column]:
    """The same history as each speaker sees it: own turns as assistant, the other's as user."""
    swapped = F.transform(
        history,
        lambda m: dg.message(
            F.when(m["role"] == "assistant", F.lit("user")).otherwise(F.lit("assistant")), m["content"]
        ),
    )
    return dg.chat("Journalist", title, paper, history), dg.chat("Researcher", title, paper, swapped)


class TurnLog(NamedTuple):
    """A folder with the papers and one table of replies per step, and the papers as they are stored.

    ``papers`` has a column ``_paper``, a number for each of its rows, by which replies are kept.
    """

    folder: str
    papers: DataFrame

    def step_folder(self, step: int) -> str:
        return f"{self.folder}/turns/step={step}"

    def turns(self, steps: int) -> DataFrame:
        """``_paper, step, role, content, error`` of the first ``steps`` steps; steps behind them are not read."""
        spark = self.papers.sparkSession
        found = spark.createDataFrame([], "_paper long, step int, role string, content string, error string")
        if steps:
            paths = [self.step_folder(k) for k in range(steps)]
            read = spark.read.schema(found.schema).option("basePath", f"{self.folder}/turns").parquet(*paths)
            found = read.select(*found.columns)
        return found

    def with_history(self, steps: int) -> DataFrame:
        """The papers with ``history``, the messages of the first ``steps`` steps in order: two short rows per round."""
        message = F.struct("step", dg.message(F.col("role"), F.col("content")).alias("m"))
        told = self.turns(steps).groupBy("_paper").agg(F.array_sort(F.collect_list(message)).alias("_h"))
        told = told.select("_paper", F.transform("_h", lambda h: h["m"]).alias("history"))
        none = F.array().cast("array<struct<role:string,content:string>>")
        return self.papers.join(told, "_paper", "left").withColumn("history", F.coalesce("history", none))

    def append(self, step: int, role: str, prompt: Column, model: Model, native: bool) -> None:
        """Answer ``prompt`` for every paper and store the replies; a step that is stored already is left as it is."""
        if path_exists(self.papers.sparkSession, f"{self.step_folder(step)}/_SUCCESS"):
            return
        made = _reply(prompt, self.with_history(step).select("_paper", "paper_title", "paper_text", "history"), model, native)
        error = F.col("reply_error") if "reply_error" in made.columns else F.lit(None).cast("string")
        rows = made.select("_paper", F.lit(role).alias("role"), F.col("reply").alias("content"), error.alias("error"))
        rows.write.mode("overwrite").parquet(self.step_folder(step))


def open_log(df: DataFrame, keep: Sequence[str], max_input_tokens: int, folder: str | None = None) -> TurnLog:
    """A log over the papers of ``df``, cut to their budget; a folder that has papers already keeps those."""
    spark = df.sparkSession
    folder = folder or fresh_dir(spark, "conversations")
    papers = df.select(
        F.monotonically_increasing_id().alias("_paper"), *keep, "paper_title",
        leading_sentences(F.col("paper_text"), max_input_tokens).alias("paper_text"),
    )
    if not path_exists(spark, f"{folder}/papers/_SUCCESS"):
        papers.write.mode("overwrite").parquet(f"{folder}/papers")
    return TurnLog(folder, spark.read.schema(papers.schema).parquet(f"{folder}/papers"))


def interactive_conversations(
    df: DataFrame,
    journalist: Model = echo_reply,
    researcher: Model = echo_reply,
    native: bool = True,
    rounds: int = 5,
    max_input_tokens: int = 1500,
    keep: Sequence[str] = ("paper_id",),
    folder: str | None = None,
) -> DataFrame:
    """``rounds`` question and answer rounds per paper; journalist turns are ``assistant`` in the result.

    With ``folder`` the turns are kept there, and a run that ended early goes on behind its last whole step.
    """
    log = open_log(df, keep, max_input_tokens, folder)
    title, paper, history = F.col("paper_title"), F.col("paper_text"), F.col("history")
    views = _views(title, paper, history)
    for k in range(2 * rounds):
        model, role = (journalist, "assistant") if k % 2 == 0 else (researcher, "user")
        log.append(k, role, dg.chat_template(views[k % 2]), model, native)
    full = log.with_history(2 * rounds).withColumn("generated_conversation", dg.chat("Journalist", title, paper, history))
    return full.drop("history", "_paper").withColumn("conversation", dg.render(F.col("generated_conversation")))


def fixed_question_conversations(
    df: DataFrame,
    researcher: Model = echo_reply,
    native: bool = True,
    questions: Sequence[str] = FIXED_QUESTIONS,
    max_input_tokens: int = 1500,
    keep: Sequence[str] = ("paper_id",),
    folder: str | None = None,
) -> DataFrame:
    """An interview of constant questions: the researcher (assistant) answers each in turn; ``folder`` as above."""
    log = open_log(df, keep, max_input_tokens, folder)
    listed = F.array(*[dg.message("user", F.lit(q)) for q in questions])

    def chat(steps: int, asked: int) -> Column:
        answers = F.concat(F.col("history"), F.array_repeat(F.lit(None).cast("struct<role:string,content:string>"), asked - steps))
        both = F.zip_with(F.slice(listed, 1, asked), answers, lambda q, a: F.array(q, a)) if asked else F.array()
        spoken = F.filter(F.flatten(both), lambda m: m.isNotNull())
        return dg.chat("Researcher", F.col("paper_title"), F.col("paper_text"), spoken)

    for k in range(len(questions)):
        log.append(k, "assistant", dg.chat_template(chat(k, k + 1)), researcher, native)
    full = log.with_history(len(questions)).withColumn("generated_conversation", chat(len(questions), len(questions)))
    return full.drop("history", "_paper").withColumn("conversation", dg.render(F.col("generated_conversation"), style="both"))
