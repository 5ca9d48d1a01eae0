"""Key phrases (RAKE) per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.binding import let
from turnloom.functions.grams import by_run, run_starts

# fixed values: English function words that end a phrase
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()


def candidate_phrases(text: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Runs of lower-case words between stop words and punctuation."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))
    breaks = lambda w: w.isin(*stop_words) | ~w.rlike(r"^[\p{L}\p{N}_]")
    marked = F.transform(pieces, lambda w: F.when(breaks(w), F.lit("\u0001")).otherwise(w))
    runs = F.split(F.array_join(marked, " "), "\u0001")
    return F.filter(F.transform(runs, lambda r: F.trim(r)), lambda p: p != "")


def ranked_phrases(phrases: Column, k: int) -> Column:
    """Best ``k`` phrases by the summed degree/frequency ratio of their words; ties by phrase, descending.

    Occurrences of words are sorted by word, where each run gives a ratio, then back by phrase, where each run gives a
    score: no word is looked up.
    """

    def rated(words: Column) -> Column:
        ratio = lambda run: F.aggregate(run, F.lit(0), lambda acc, e: acc + e["n"]) / F.size(run)
        spread = lambda run: let(ratio(run), lambda r: F.transform(run, lambda e: F.struct(e["at"].alias("at"), r.alias("r"))))
        return let(run_starts(words, lambda e: e["w"]), lambda starts: F.flatten(by_run(words, starts, spread)))

    def scored(ratios: Column, ps: Column) -> Column:
        total = lambda run: F.aggregate(run, F.lit(0.0), lambda acc, e: acc + e["r"])
        entry = lambda run: F.struct(F.round(total(run), 9).alias("phrase_score"), F.get(ps, F.get(run, F.lit(0))["at"]).alias("phrase"))
        return let(run_starts(ratios, lambda e: e["at"]), lambda starts: by_run(ratios, starts, entry))

    def best(ps: Column) -> Column:
        split = lambda p, at: let(F.split(p, " "), lambda ws: F.transform(ws, lambda w: F.struct(w.alias("w"), at.alias("at"), F.size(ws).alias("n"))))
        words = F.sort_array(F.flatten(F.transform(ps, split)))
        return let(F.sort_array(let(words, rated)), lambda ratios: F.slice(F.sort_array(scored(ratios, ps), asc=False), 1, k))

    return let(phrases, lambda ps: F.when(F.size(ps) > 0, best(ps)))


def key_phrases(
    docs: DataFrame, ident: str, text: str, k: int = 5, stop_words: Sequence[str] = tuple(STOP_WORDS)
) -> DataFrame:
    """Top ``k`` phrases per document as ``(ident, rank, phrase, phrase_score)``.

    Word statistics are those of the document alone, so a document is ranked in its row without any shuffle.
    """
    # exploding the ranking itself would let the optimizer evaluate it again in an inferred filter
    rows = docs.select(ident, F.posexplode_outer(ranked_phrases(candidate_phrases(F.col(text), stop_words), k)).alias("_at", "_p"))
    return rows.where("_at is not null").select(ident, (F.col("_at") + 1).alias("rank"), "_p.phrase", "_p.phrase_score")
