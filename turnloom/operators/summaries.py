"""Extractive summaries: sentence graph and PageRank inside each document row."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions import text as tx

DAMPING = 0.85
ROUNDS = 30


#: Cells of the sentence graph that are counted at once, and those that a graph may have to be ranked as a whole matrix.
CELLS, WHOLE = 1 << 18, 1 << 14
#: Greatest change of a round after which ranks stay as they are, far below the twelve digits that order them.
SETTLED = 1e-17


def sentence_edges(sents: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, other, weight``: sentences that share words, over an index from words to sentences.

    Row ``i`` of the graph is ``other[start[i]:start[i + 1]]``. The weight is the number of shared words over the sum of
    the logarithms of both lengths. Sentences are taken in blocks, each meeting the places of its words at once; what is
    held follows the number of pairs that share words.
    """
    n = len(sents)
    sets = [set(s.lower().split()) for s in sents]
    number: defaultdict[str, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    word = np.fromiter(map(number.__getitem__, chain.from_iterable(sets)), np.int64, int(sizes.sum()))
    at = np.repeat(np.arange(n), sizes)
    times = np.bincount(word, minlength=len(number))
    kept = times[word] > 1
    word, at = word[kept], at[kept]
    # the sentences of a word stand together, from ``first[word]`` on
    places, first = at[np.argsort(word, kind="stable")], np.cumsum(np.where(times > 1, times, 0)) - times
    met = times[word]
    ends = np.searchsorted(at, np.arange(n), "right")
    pairs = np.concatenate([[0], np.cumsum(met)])[ends]
    logs = np.array([math.log10(max(len(s), 1)) for s in sents])
    others, weights, degrees = [], [], []
    low, step = 0, max(1, CELLS // max(n, 1))
    while low < n:
        # at least a sentence, and no more than bring ``CELLS`` meetings
        most = (pairs[low - 1] if low else 0) + CELLS
        high = min(n, low + step, max(low + 1, int(np.searchsorted(pairs, most, "right"))))
        own = slice(ends[low - 1] if low else 0, ends[high - 1])
        reps = met[own]
        to = np.arange(int(reps.sum())) + np.repeat(first[word[own]] - (np.cumsum(reps) - reps), reps)
        shared = np.bincount(np.repeat((at[own] - low) * n, reps) + places[to], minlength=(high - low) * n)
        cell = np.flatnonzero(shared)
        row, other = np.divmod(cell, n)
        lengths = logs[row + low] + logs[other]
        real = (row + low != other) & (lengths > 0)
        others.append(other[real].astype(np.int32))
        weights.append(shared[cell[real]] / lengths[real])
        degrees.append(np.bincount(row[real], minlength=high - low))
        low = high
    return np.concatenate([[0], np.cumsum(np.concatenate(degrees))]), np.concatenate(others), np.concatenate(weights)


def sentence_ranks(sents: list[str]) -> np.ndarray:
    """PageRank over the edges, a fixed number of rounds; those that change nothing any more are left out."""
    n = len(sents)
    start, other, weight = sentence_edges(sents)
    row, other = np.repeat(np.arange(n), np.diff(start)), other.astype(np.intp)
    # the weights are the same both ways: a sentence's sum is that of its row
    share = DAMPING * weight / np.bincount(row, weight, n)[other]
    rank, least = np.full(n, 1.0 / n), (1 - DAMPING) / n
    if n * n <= WHOLE:
        matrix = np.zeros((n, n))
        matrix[row, other] = share
        for _ in range(ROUNDS):
            rank = least + matrix @ rank
        return rank
    linked = np.flatnonzero(np.diff(start))
    for _ in range(ROUNDS):
        flow = np.full(n, least)
        if len(linked):
            flow[linked] += np.add.reduceat(share * rank[other], start[linked])
        change, rank = np.abs(flow - rank).max(), flow
        if change <= SETTLED:
            break
    return rank


def _summary(sents: list[str]) -> str:
    """Smallest share i/20 of the sentences (i < 20) that is not empty, best ranks first, printed in text order."""
    n = len(sents)
    size = next((int(n * i / 20) for i in range(1, 20) if int(n * i / 20) > 0), 0)
    if not size:
        return ""
    order = np.lexsort((np.arange(n), -np.round(sentence_ranks(sents), 12)))[:size]
    return "\n".join(sents[i] for i in sorted(order))


@F.pandas_udf(T.StringType())
def _summarised(sents: pd.Series) -> pd.Series:
    return sents.map(lambda s: _summary(list(s)) if s is not None else None)


def extractive_summary(docs: DataFrame, text: str, output: str = "summary") -> DataFrame:
    return docs.withColumn(output, _summarised(tx.sentences(F.col(text))))
