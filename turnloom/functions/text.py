"""Text functions over string columns: splitting, counting, cleaning and parsing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.binding import let
from turnloom.functions.grams import by_run, run_starts
from turnloom.functions.lookup import respelt_words

TokenCounter = Callable[[Column], Column]

# fixed values: words that open a question, then words tagged as interrogative pronoun or adverb
QUESTION_OPENERS = (
    "who what when where why how is are can could would should do does did will shall"
).split()
INTERROGATIVES = "what who whom whoever whatever how when where why whenever wherever".split()

# fixed values: speaker markers of raw dialogues and the speaker each label stands for
SPEAKER_MARKERS = ("**Journalist", "**Researcher", "**J", "**R")
SPEAKERS = {
    "J": "Journalist",
    "R": "Researcher",
    "Journalist": "Journalist",
    "Researcher": "Researcher",
    "Journalist (J)": "Journalist",
    "Researcher (R)": "Researcher",
}
REASONING_END = "</think>"
# fixed values: patterns of names and of the end of a paragraph
NAME_PATTERN = r"\bDr\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
COMPLETE_END = "[.?!…](['”\"\\)]*)\\s*$"
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SENTENCE_BREAK = r"(?<=[.!?…])\s+"
# fixed values: the characters of Unicode's White_Space property
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NAIVE_SENTENCE_BREAK = r"(?<=[?.!])\s+"


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks; only the ends of a text are looked at."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    """White-space separated words without empty pieces."""
    return F.array_remove(F.split(text, r"\s+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def first_word(text: Column) -> Column:
    """The first of ``words``, null where there is none; the rest of the text is not cut."""
    return F.nullif(F.regexp_extract(text, r"\S+", 0), F.lit(""))


def last_word(text: Column) -> Column:
    """The last of ``words``, null where there is none; the rest of the text is not cut."""
    return F.reverse(first_word(F.reverse(text)))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def token_count(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Tokens matching ``pattern``: words and single punctuation marks by default."""
    return F.regexp_count(text, F.lit(pattern))


def tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def cut_tokens(text: Column, n: int, pattern: str = TOKEN_PATTERN, suffix: str = "...") -> Column:
    """Hard cut after ``n`` tokens, marked by ``suffix``; shorter texts stay unchanged."""
    cut = lambda found: F.concat(F.array_join(F.slice(found, 1, n), " "), F.lit(suffix))
    return let(tokens(text, pattern), lambda found: F.when(F.size(found) > n, cut(found)).otherwise(text))


def sentences(text: Column) -> Column:
    """Split after sentence-ending punctuation followed by white space."""
    return F.array_remove(F.split(strip(text), SENTENCE_BREAK), "")


def naive_sentences(text: Column) -> Column:
    return F.split(strip(text), NAIVE_SENTENCE_BREAK)


def lexical_tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens, the unit of the overlap metrics."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def is_complete(paragraph: Column) -> Column:
    """A paragraph ends with sentence punctuation, perhaps inside quotes or brackets."""
    return strip(paragraph).rlike(COMPLETE_END)


def complete_paragraphs(text: Column, limit: int = 3) -> Column:
    """Leading complete paragraphs, at most ``limit``; the untouched text if the first one is cut off."""

    def leading(blocks: Column) -> Column:
        first_cut = F.array_position(F.transform(blocks, is_complete), F.lit(False))
        whole = F.when(first_cut == 0, F.size(blocks)).otherwise(first_cut - 1)
        kept = lambda n: F.array_join(F.slice(blocks, F.lit(1), n), "\n\n")
        return let(F.least(whole, F.lit(limit)).cast("int"), lambda n: F.when(n > 0, kept(n)).otherwise(text))

    return let(F.filter(F.transform(F.split(strip(text), "\n\n"), strip), lambda p: p != ""), leading)


def mask_names(text: Column) -> Column:
    return F.regexp_replace(text, NAME_PATTERN, "[name]")


def drop_reasoning(text: Column) -> Column:
    """Keep what follows the last end-of-reasoning tag."""
    return F.element_at(F.split(text, REASONING_END), -1)


def opens_question(sentence: Column) -> Column:
    return F.lower(sentence).rlike("^(" + "|".join(QUESTION_OPENERS) + r")([^\p{L}\p{N}_]|$)")


def questions(text: Column) -> Column:
    """Sentences that end with ``?`` or open like a question; the latter get a ``?`` appended."""
    parts = F.transform(naive_sentences(text), strip)
    asked = F.filter(parts, lambda s: s.endswith("?") | opens_question(s))
    return F.transform(asked, lambda s: F.when(s.endswith("?"), s).otherwise(F.concat(s, F.lit("?"))))


def is_question(sentence: Column) -> Column:
    """Lexicon form of the tagged question test: an interrogative word anywhere, or a final ``?``."""
    word = r"(^|[^\p{L}\p{N}_])(" + "|".join(INTERROGATIVES) + r")([^\p{L}\p{N}_]|$)"
    return strip(sentence).endswith("?") | F.lower(sentence).rlike(word)


def question_sentences(text: Column) -> Column:
    return F.filter(sentences(text), is_question)


def parse_dialogue(raw: Column, keep_later_colons: bool = True) -> Column:
    """Raw dialogue text to ``array<struct<author, text>>``.

    Blocks are separated by a blank line and carry a bold speaker marker. One unknown speaker empties the
    whole dialogue, and so does a null. ``keep_later_colons=False`` ends a turn at its second colon.
    """
    blocks = F.split(drop_reasoning(raw), "\n\n")

    def marked(block: Column) -> Column:
        hit = F.lit(False)
        for marker in SPEAKER_MARKERS:
            hit = hit | block.contains(marker)
        return hit & block.contains(":")

    speaker_map = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])

    def to_turn(block: Column) -> Column:
        pieces = F.split(block, ":", 2) if keep_later_colons else F.split(block, ":")
        label = F.replace(F.get(pieces, F.lit(0)), F.lit("**"), F.lit(""))
        label = strip(F.regexp_replace(label, "Researcher .*", "Researcher"))
        return F.struct(
            F.try_element_at(speaker_map, label).alias("author"),
            F.replace(F.get(pieces, F.lit(1)), F.lit("**"), F.lit("")).alias("text"),
        )

    turns = F.transform(F.filter(blocks, marked), to_turn)
    empty = F.array().cast("array<struct<author:string,text:string>>")
    unknown = lambda ts: F.exists(ts, lambda t: t["author"].isNull())
    return let(turns, lambda ts: F.when(raw.isNull() | unknown(ts), empty).otherwise(ts))


def article_body(generated: Column, heading: str = "Press Release Article") -> Column:
    """Text after the first heading, stripped; everything when the heading is missing."""
    at = F.instr(generated, heading)
    body = strip(F.substr(generated, at + F.lit(len(heading))))
    return F.when(at > 0, body).otherwise(generated)


def topic_lines(generated: Column) -> Column:
    """Drop the first and last line of a topic list, then blank lines."""
    lines = F.split(generated, "\n")
    inner = let(lines, lambda ls: F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 2, F.lit(0))))
    return F.array_join(F.filter(F.transform(inner, strip), lambda x: x != ""), "\n")


def case_map(context: Column) -> Column:
    """Each word of a text in lower case with its last spelling: one pass over the text, for all claims about it; null has none."""
    last = lambda run: let(F.element_at(run, -1), lambda e: F.struct(e["low"].alias("key"), e["word"].alias("value")))
    entries = F.transform(words(context), lambda w, i: F.struct(F.lower(w).alias("low"), i.alias("at"), w.alias("word")))
    found = lambda es: let(run_starts(es, lambda e: e["low"]), lambda starts: by_run(es, starts, last))
    return let(F.sort_array(entries), lambda es: F.map_from_entries(found(es)))


def clean_claim(context: Column, claim: Column) -> Column:
    """Restore the context's word case (its last spelling wins), plain quotes and brackets, sentence capitals.

    Each word of the claim is looked for from the end of the context, in Python; nothing is sorted or cut into words.
    """
    beyond_ascii = F.when(F.length(context) != F.octet_length(context), F.lower(context))
    return _claim_text(respelt_words(context, beyond_ascii, claim, F.lower(claim)))


def clean_claim_by(known: Column, claim: Column) -> Column:
    """``clean_claim`` with the context's ``case_map``; without one every word stays as it is."""
    respelled = F.transform(words(claim), lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w))
    return _claim_text(F.array_join(respelled, " "))


def _claim_text(respelled: Column) -> Column:
    text = F.translate(respelled, "“”’‘`", "\"\"'''")
    text = F.replace(F.replace(text, F.lit("-lrb-"), F.lit("(")), F.lit("-rrb-"), F.lit(")"))
    capital = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    return F.array_join(F.transform(sentences(text), capital), " ")


def printable(text: Column) -> Column:
    """Only printable ASCII and ASCII white space."""
    return F.regexp_replace(text, r"[^\x20-\x7E\t\n\r\x0B\x0C]", "")


def squeeze(text: Column) -> Column:
    return F.array_join(words(text), " ")


def fill_blank(question: Column, option: Column, tail: str = " ") -> Column:
    """Put the option into the question's ``_`` gaps, or append it when there is no gap."""
    gap = F.replace(question, F.lit("_"), F.concat(F.lit(" "), option, F.lit(" ")))
    return F.when(question.contains("_"), squeeze(gap)).otherwise(F.concat(question, F.lit(" "), option, F.lit(tail)))


def mask_answers(context: Column, answers: Column) -> Column:
    """Delete every answer, longest first, where it stands as a whole (hyphenated) word; case is ignored, and so are nulls."""
    ordered = F.array_sort(F.filter(answers, lambda a: a.isNotNull()), lambda a, b: F.length(b) - F.length(a))
    edge = r"[\w\-–]"

    def pattern(answer: Column) -> Column:
        literal = F.replace(answer, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        # the literal comes first: what stands before it is only looked at where it matches
        return F.concat(F.lit(r"(?iU)\Q"), literal, F.lit(rf"\E(?!{edge})(?<!{edge}\Q"), literal, F.lit(r"\E)"))

    return F.aggregate(ordered, context, lambda acc, a: F.regexp_replace(acc, pattern(a), F.lit("")))


def substitute_span(text: Column, offset: Column, old: Column, new: Column) -> Column:
    """Replace ``old``, found at the 0-based ``offset``, by ``new``."""
    head = F.substr(text, F.lit(1), offset)
    return F.concat(head, new, F.substr(text, offset + F.length(old) + 1))


def unwrap_bytes_literal(text: Column) -> Column:
    """``b'...'`` to its content: drop two leading and one trailing character."""
    return F.substr(text, F.lit(3), F.greatest(F.length(text) - 3, F.lit(0)))


def span(text: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` (0-based) up to ``end``, stripped."""
    return strip(F.substr(text, start + 1, F.greatest(end - start, F.lit(0))))


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def rating(reply: Column) -> Column:
    """Integer in a rater's reply, 0 when there is none."""
    return F.coalesce(strip(reply).try_cast("int"), F.lit(0))


def strip_address(reply: Column, prefixes: Sequence[str] = ("Journalist:", "[name],")) -> Column:
    for prefix in prefixes:
        reply = F.replace(reply, F.lit(prefix), F.lit(""))
    return strip(reply)


def file_key(title: Column) -> Column:
    """File-safe title: extension and punctuation dropped, blanks as underscores."""
    base = F.regexp_replace(title, r"(?<=.)\.[^.]*$", "")
    return F.replace(strip(F.regexp_replace(base, r"(?U)[^\w\s-]", "")), F.lit(" "), F.lit("_"))


def judged_text(score: Column, reasons: Column) -> Column:
    return F.concat(F.lit("Score: "), score.cast("string"), F.lit("\nReason: "), reasons)


def judged_score(text: Column) -> Column:
    return F.regexp_extract(text, r"^Score: (\d+)", 1).try_cast("int")
