"""Model-backed stages: a plug-in model sees one column, in mini-batches, one client per task.

Only the input column travels to Python. Replies come back next to their row, so nothing is matched by
position. Each stage also has a rule-based stand-in made of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.functions.lookup import token_share
from turnloom.session import bound_batches

Client = Callable[[list], Sequence]
RETRIES = 5
BATCH = 32


def with_retry(client: Client, batch: list, retries: int = RETRIES) -> tuple[list, list]:
    """Replies and errors of a batch; a batch that keeps failing is retried row by row, then left null."""
    error = None
    for _ in range(retries):
        try:
            replies = list(client(batch))
            if len(replies) != len(batch):
                raise ValueError(f"{len(replies)} replies for {len(batch)} inputs")
            return replies, [None] * len(batch)
        except Exception as exc:  # the model is foreign code: any failure becomes an error value
            error = f"{type(exc).__name__}: {exc}"
    if len(batch) == 1:
        return [None], [error]
    replies, errors = [], []
    for one in batch:
        r, e = with_retry(client, [one], retries)
        replies += r
        errors += e
    return replies, errors


def batch_stage(
    df: DataFrame,
    make_client: Callable[[], Client],
    source: Column,
    output: str,
    returns: str = "string",
    batch: int = BATCH,
    retries: int = RETRIES,
) -> DataFrame:
    """Add ``output`` and ``<output>_error``: the client's reply to ``source`` for every row."""

    @F.pandas_udf(f"reply {returns}, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for part in parts:
            replies, errors = [], []
            items = part.tolist()
            for i in range(0, len(items), batch):
                r, e = with_retry(client, items[i : i + batch], retries)
                replies += r
                errors += e
            yield pd.DataFrame({"reply": replies, "error": errors})

    called = df.withColumn("_call", run.asNondeterministic()(source))
    return called.withColumn(output, F.col("_call.reply")).withColumn(f"{output}_error", F.col("_call.error")).drop("_call")


def generate(
    df: DataFrame, source: Column, output: str, model: Callable[[], Client] | Callable[[Column], Column] | None = None,
    native: bool = True,
) -> DataFrame:
    """Text generation. ``native`` models map a column to a column; others are client factories."""
    if model is None:
        model, native = echo_reply, True
    if native:
        return df.withColumn(output, model(source))
    return batch_stage(df, model, source, output)


# --- rule-based stand-ins ---------------------------------------------------------------------------------


def echo_reply(prompt: Column) -> Column:
    """Template reply: an opening and the prompt's last sentence."""
    return F.concat(F.lit("In short: "), F.coalesce(F.element_at(tx.sentences(prompt), -1), F.lit("nothing to add.")))


def rubric_reply(prompt: Column) -> Column:
    """JSON judgement by a length rule: 1 to 3 points for short, medium and long prompts."""
    n = tx.word_count(prompt)
    score = F.when(n < 50, F.lit(1)).when(n < 150, F.lit(2)).otherwise(F.lit(3))
    return F.concat(F.lit('{"reasons": "'), n.cast("string"), F.lit(' words", "score": '), score.cast("string"), F.lit("}"))


def question_reply(prompt: Column) -> Column:
    """JSON list of the questions a prompt lists that have more words than its instruction has beyond six."""
    needed = tx.word_count(F.substring_index(prompt, "\n\n", 1)) - 6
    asked = F.from_json(F.regexp_extract(prompt, r"(?s)Questions: (.*)$", 1), "array<string>")
    good = F.filter(asked, lambda q: tx.word_count(q) > needed)
    return F.to_json(F.struct(good.alias("high_quality_questions")))


def quality_reply(answer: Column) -> Column:
    """Answer rating: vague below twelve words; words of twelve letters or more count as complex."""
    vague = (tx.word_count(answer) < 12).cast("int")
    hard = F.array_distinct(F.filter(tx.lexical_tokens(answer), lambda t: F.length(t) >= 12))
    return F.to_json(F.struct(vague.alias("is_vague"), hard.alias("complex_aspects")))


def joined_answer(question: Column, answer: Column) -> Column:
    """Question and answer as one statement; the constant ``no answer`` stands for a missing answer."""
    return F.concat(question, F.lit(" "), F.coalesce(answer, F.lit("no answer")))


def hashed_embedding(size: int = 64) -> Callable[[], Client]:
    """Bag-of-words encoder: token counts hashed into ``size`` slots."""

    def make() -> Client:
        import zlib

        def encode(texts: list) -> list:
            out = []
            for text in texts:
                vec = np.zeros(size)
                for token in str(text or "").lower().split():
                    vec[zlib.crc32(token.encode()) % size] += 1
                out.append(vec.tolist())
            return out

        return encode

    return make


def embed(df: DataFrame, text: str, output: str = "embedding", make_client: Callable[[], Client] | None = None) -> DataFrame:
    """Sentence vectors; a failed row keeps a null vector and its error."""
    return batch_stage(df, make_client or hashed_embedding(), F.col(text), output, "array<double>")


# --- pair scoring ------------------------------------------------------------------------------------------


def containment(premise: Column, claim: Column) -> Column:
    """Share of the claim's distinct tokens found among the premise's; the claim is a distinct token list."""
    both = F.size(F.array_intersect(claim, premise)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(claim).cast("double")), F.lit(0.0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tx.lexical_tokens(text))


def score_pairs(
    pairs: DataFrame, premise: str = "premise", claim: str = "hypothesis", make_client: Callable[[], Client] | None = None
) -> DataFrame:
    """Add the three heads ``reg``, ``bin`` and ``tri`` to each pair.

    The stand-in puts token containment c into ``reg`` and ``bin`` and (c, 0, 1 - c) into ``tri``. A client
    receives structs of both texts and returns ``(reg, bin, [three])``.
    """
    if make_client is None:
        # every head is made from one containment: the claim's tokens are looked for in the premise once
        bound_batches(pairs.sparkSession)
        scored = pairs.withColumn("reg", token_share(F.lower(F.col(premise)), F.lower(F.col(claim))))
        return scored.withColumn("bin", F.col("reg")).withColumn("tri", F.array("reg", F.lit(0.0), 1 - F.col("reg")))
    wrapped = lambda: named_heads(make_client())
    both = F.to_json(F.struct(F.col(premise).alias("premise"), F.col(claim).alias("hypothesis")))
    scored = batch_stage(pairs, wrapped, both, "_heads", "string")
    heads = F.from_json("_heads", "reg double, bin double, tri array<double>")
    return (
        scored.withColumn("_h", heads)
        .select(*pairs.columns, "_h.reg", "_h.bin", "_h.tri", F.col("_heads_error").alias("score_error"))
    )


def named_heads(client: Client) -> Client:
    """A pair client for a stage over one column: JSON pairs in, the three heads as JSON out."""
    import json

    def call(batch: list) -> list:
        texts = [json.loads(x) for x in batch]
        return [
            json.dumps({"reg": float(r), "bin": float(b), "tri": [float(v) for v in t]})
            for r, b, t in client([(t["premise"], t["hypothesis"]) for t in texts])
        ]

    return call
