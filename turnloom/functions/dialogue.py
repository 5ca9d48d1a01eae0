"""Chat messages: composing, relabelling, rendering and taking apart."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the two chat roles' system prompts
ROLE_PROMPTS = {
    "Journalist": "You are a helpful and knowledgeable journalist asking questions about a scientific paper.",
    "Researcher": "You are a helpful and expert researcher answering questions about your scientific paper.",
}
ROLE_TO_AUTHOR = {"assistant": "Journalist", "user": "Researcher"}
PAPER_MARK = "[PAPER]"


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def paper_message(title: Column, paper: Column) -> Column:
    return F.concat(F.lit("[PAPER-TITLE]\n"), title, F.lit("\n" + PAPER_MARK + "\n"), paper)


def chat(role: str, title: Column, paper: Column, history: Column) -> Column:
    """System prompt of ``role``, the paper, then ``history``."""
    prompt = ROLE_PROMPTS.get(role, ROLE_PROMPTS["Researcher"])
    opening = F.array(message("system", F.lit(prompt)), message("user", paper_message(title, paper)))
    return F.concat(opening, history)


def relabel(value: Column, mapping: Mapping[str, str]) -> Column:
    """Map a role or author; values outside the mapping stay."""
    out = F.lit(None).cast("string")
    for old, new in mapping.items():
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return F.coalesce(out, value)


def author_of(role: Column) -> Column:
    return F.when(role == "assistant", F.lit("Journalist")).otherwise(F.lit("Researcher"))


def without_prefixes(content: Column) -> Column:
    return F.replace(F.replace(content, F.lit("Researcher: "), F.lit("")), F.lit("Journalist: "), F.lit(""))


def dialogue_line(role: Column, content: Column, style: str = "journalist") -> Column:
    """One rendered turn. Styles: ``journalist`` cleans speaker prefixes out of journalist turns only,
    ``both`` out of all turns with the researcher as assistant, ``plain`` and ``bare`` out of none; ``bare`` has no
    blank behind the speaker."""
    if style == "both":
        who = F.when(role == "assistant", F.lit("Researcher")).otherwise(F.lit("Journalist"))
        return F.concat(who, F.lit(": "), without_prefixes(content))
    if style == "bare":
        return F.concat(author_of(role), F.lit(":"), content)
    if style == "plain":
        return F.concat(author_of(role), F.lit(": "), content)
    body = F.when(role == "assistant", without_prefixes(content)).otherwise(content)
    return F.concat(author_of(role), F.lit(": "), body)


def render(messages: Column, skip: int = 2, sep: str = "\n\n", style: str = "journalist") -> Column:
    """Messages after the first ``skip`` as one text."""
    tail = F.slice(messages, F.lit(skip + 1), F.greatest(F.size(messages) - skip, F.lit(0)))
    return F.array_join(F.transform(tail, lambda m: dialogue_line(m["role"], m["content"], style)), sep)


def contents_of(messages: Column, role: str = "assistant") -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])


def paper_of(prompt: Column) -> Column:
    """Text after the last paper mark of the second message."""
    return F.element_at(F.split(F.get(prompt, F.lit(1))["content"], r"\[PAPER\]"), -1)


def history_of(prompt: Column) -> Column:
    return F.slice(prompt, F.lit(3), F.greatest(F.size(prompt) - 2, F.lit(0)))


def open_answer(prompt: Column) -> Column:
    """The last history message when the researcher (user) wrote it, else null."""
    history = history_of(prompt)
    last = F.get(history, F.size(history) - 1)
    return F.when(last["role"] == "user", last["content"])


def chat_template(messages: Column, tag: str = "<|{}|>", end: str = "\n", generate: bool = True) -> Column:
    """Role-tagged rendering, closed by an assistant tag when a reply is to be generated."""
    left, right = tag.split("{}")
    lines = F.transform(
        messages, lambda m: F.concat(F.lit(left), m["role"], F.lit(right), m["content"], F.lit(end))
    )
    text = F.array_join(lines, "")
    return F.concat(text, F.lit(tag.format("assistant"))) if generate else text


def fill_inputs(inputs: list[tuple[str, Column]], sep: str = ": ") -> Column:
    """One ``label<sep>value`` block per input, blank lines between; a null prints as ``None``."""
    blocks = [F.concat(F.lit(label + sep), F.coalesce(c.cast("string"), F.lit("None"))) for label, c in inputs]
    return F.concat_ws("\n\n", *blocks)
