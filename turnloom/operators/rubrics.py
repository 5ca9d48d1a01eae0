"""Judging rubrics and generation prompts as plain specs. The wording is our own; names, inputs and scales are fixed."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rubric:
    """One prompt: its subject and aspect key a score, ``inputs`` maps labels to columns in order."""

    subject: str
    aspect: str
    instruction: str
    inputs: tuple[tuple[str, str], ...]
    scale: int | None = None
    tags: tuple[str, ...] = field(default=())


def _ask(what: str, goal: str, scale: int) -> str:
    return f"Rate how well the {what} {goal}, from 1 (poor) to {scale} (very good). Reply as JSON with reasons and score."


# fixed values: aspect -> (goal, points)
_ASPECTS = {
    "factuality": ("states facts correctly", 3),
    "faithfulness": ("stays true to the paper", 5),
    "societal": ("explains the impact of the research on society", 3),
    "scientific": ("places the research in its scientific context", 3),
    "clarity": ("is clear to readers outside the field", 5),
    "relevancy": ("covers what the gold press release covers", 5),
}
_EXTRA = {
    ("conversation", "faithfulness"): (("Scientific Paper", "sc_intro"),),
    ("conversation", "relevancy"): (("Gold Standard Press Release", "pr_article"),),
    ("press_release", "faithfulness"): (("Scientific Paper", "sc_intro"),),
    ("press_release", "relevancy"): (("Gold Standard Press Release", "pr_article"),),
}
_MAIN = {
    "conversation": ("Conversation", "conversation", "conversation between a journalist and a researcher"),
    "press_release": ("Press Release", "parsed_pr_article", "press release"),
}

RUBRICS: tuple[Rubric, ...] = tuple(
    Rubric(
        subject,
        aspect,
        _ask(_MAIN[subject][2], goal, scale),
        ((_MAIN[subject][0], _MAIN[subject][1]), *_EXTRA.get((subject, aspect), ())),
        scale,
    )
    for subject in ("conversation", "press_release")
    for aspect, (goal, scale) in _ASPECTS.items()
)

QUESTION_RUBRICS: tuple[Rubric, ...] = tuple(
    Rubric("questions", aspect, f"List the questions that {goal}. Reply as JSON.", (("Questions", "questions"),))
    for aspect, goal in (
        ("societal", "ask about the impact on society"),
        ("scientific", "ask about the scientific context"),
        ("clarity", "ask to clarify technical terms"),
    )
)

GENERATION_PROMPTS: tuple[Rubric, ...] = (
    Rubric("press_release", "baseline", "Write a press release about this paper.", (("Scientific paper", "paper_text"),)),
    Rubric(
        "press_release", "stepwise",
        "List the key findings first, then write the text under the heading Press Release Article.",
        (("Scientific paper", "paper_text"),),
    ),
    Rubric(
        "press_release", "with_conversation", "Write a press release with the help of the conversation.",
        (("Scientific paper", "paper_text"), ("Conversation", "conversation")),
    ),
    Rubric(
        "press_release", "conversation_summary", "Summarise this conversation as a press release.",
        (("Conversation", "conversation"),),
    ),
    Rubric("topics", "topics", "List the topics of this press release, one per line.", (("Press Release", "pr_article"),)),
)

DIALOGUE_PROMPT = (
    "Simulate a conversation between a researcher and a journalist about the researcher's paper.\n"
    "Researcher guidelines:\n[researcher-guidelines]\nJournalist guidelines:\n[journalist-guidelines]"
)
RESEARCHER_GUIDELINES = {
    "na": "",
    "experienced-researcher": "Explain the research, its impact on society and its scientific context in simple words.",
}
JOURNALIST_GUIDELINES = {
    "na": "",
    "generic-guidelines": "Ask for societal and scientific context, for novel results, and follow up on unclear terms.",
    "pr-guided": "Ask questions that cover the gold press release and follow up until its points are answered.",
}

# fixed values: the interview of three constant questions
FIXED_QUESTIONS = (
    "What is the research questions addressed in this paper?",
    "What is the societal impact of this research?",
    "How this paper is compared to other research on the topic?",
)


def dialogue_prompts() -> tuple[Rubric, ...]:
    """All researcher x journalist guideline combinations; the guided journalist also reads the press release."""
    out = []
    for r_name, r_text in RESEARCHER_GUIDELINES.items():
        for j_name, j_text in JOURNALIST_GUIDELINES.items():
            inputs = [("Scientific paper", "sc_intro")]
            if j_name == "pr-guided":
                inputs.append(("Journalistic report", "pr_article"))
            text = DIALOGUE_PROMPT.replace("[journalist-guidelines]", j_text).replace("[researcher-guidelines]", r_text)
            out.append(Rubric("dialogue", f"composite-{r_name}-{j_name}", text, tuple(inputs)))
    return tuple(out)
