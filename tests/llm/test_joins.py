"""N-gram links, lexical search and the filter audit against plain forms, with odd rows."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from cases import LONG, ODD, WORD, ascii_lower

from pyspark.sql import functions as F

from turnloom.llm import filter_audit, lexical_search, ngram_join

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# n-gram links


def grams(text):
    words = WORD.findall(ascii_lower(text or ""))
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def linked(rows):
    """(id, shingles, component) of ``(id, text)`` rows by all pairs."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def edited(seed):
    """Groups of copies with a few words changed, dropped, added or appended, and a template with much text of its own."""
    pick, words, rows = random.Random(seed), [f"W{i}" for i in range(300)], []
    for size in (4, 6, 7, 12, 40, 90, 200, 420):
        base = [pick.choice(words) for _ in range(size)]
        for _ in range(pick.choice([1, 3, 12])):
            text = list(base)
            for _ in range(pick.randint(0, max(1, size // 14))):
                k, op = pick.randrange(len(text)), pick.random()
                if op < 0.4:
                    text[k] = pick.choice(words)
                elif op < 0.7 and len(text) > 1:
                    del text[k]
                else:
                    text.insert(k, pick.choice(words))
            if pick.random() < 0.3:
                text += [pick.choice(words) for _ in range(size // 8)]
            rows.append(" ".join(text))
    template = [pick.choice(words) for _ in range(120)]
    rows += [" ".join(template + [pick.choice(words) for _ in range(80)]) for _ in range(12)]
    return list(enumerate(rows))


@pytest.mark.parametrize("cells, range_bytes", [(1 << 17, 1 << 24), (500, 4000)])
def test_links_are_those_of_all_pairs(spark, cells, range_bytes):
    """However small blocks and ranges are."""
    rows = edited(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.linked_documents(df, cells=cells, range_bytes=range_bytes)
    want = linked(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(want)
    assert len({c for *_, c in want}) < len(rows) - 20


def test_links_of_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked_documents(odd).collect()]
    want = [(d, n, c if n else d) for d, n, c in linked([(r[0], r[1]) for r in ODD])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ngram_join.linked_documents(none).collect() == []


def test_leaders_find_most_links(spark):
    """Copies with one word changed are all linked by the round of leaders; hashes above and below the sign bit alike."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if k != 2 * i else "x" for k, w in enumerate(words))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.prefixes(df, 1)
    meeting = ngram_join.members(found)
    held = ngram_join.contents(df, ngram_join.sets(df), meeting)
    links = ngram_join.led(meeting, held).collect()
    assert len({x for r in links for x in (r.a, r.b)}) == 40


def test_templates_meet_nobody(spark):
    """Texts that share 60 % and no more have enough shingles of their own: candidates do not grow with their number."""
    pick = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    shared = [pick.choice(words) for _ in range(120)]
    rows = [(i, " ".join(shared + [pick.choice(words) for _ in range(80)])) for i in range(400)]
    assert ngram_join.prefixes(spark.createDataFrame(rows, "doc_id long, text string"), 2).count() == 0


def test_bitmaps_bound_the_overlap():
    make = np.random.default_rng(1)
    for size in (1, 5, 70, 400, 3000):
        x = np.unique(make.integers(0, 1 << 63, size, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: size * 2 // 3], make.integers(0, 1 << 63, max(1, size // 2), dtype=np.uint64)]))
        p, q = ngram_join.bitmap(x), ngram_join.bitmap(y)
        few = min(len(p), len(q))
        bound = ngram_join.most_shared(ngram_join.folded(p, few)[None], np.array([len(x)]), ngram_join.folded(q, few), len(y))[0]
        assert ngram_join.overlap(x, y) == len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))


def test_tile_links_unite_and_no_more():
    sets = [np.arange(a, b, dtype=np.uint64) * np.uint64(7919) for a, b in ((0, 100), (5, 105), (10, 110), (60, 160), (0, 100))]
    bits = [ngram_join.bitmap(s) for s in sets]
    sizes = np.array([len(s) for s in sets])
    found = ngram_join.compare([b"a", b"b", b"c", b"d", b"a"], np.zeros(5, int), sizes, bits, sets, True)
    assert found == [(0, 1), (0, 2)]  # the first and last are one component already, the fourth is alike to none
    assert ngram_join.compare([b"a", b"b", b"c", b"d", b"a"], np.array([0, 0, 1, 1, 1]), sizes, bits, sets, False) == [(0, 2), (1, 2)]


# lexical search


def best(docs, items, depth=50):
    """(item, rank, id, score) by the definition."""
    cut = lambda text: TERM.findall(ascii_lower(text or ""))
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    if not held:
        return []
    number, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(cut(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c, n in held:
            m = 50 + 50 * n * number // length
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:depth], 1)]
    return out


def same(got, want):
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("depth, block", [(50, 100_000), (3, 20)])
def test_search_is_exact(spark, depth, block, monkeypatch):
    """Also with few documents at a time, so that later ones meet the best of earlier ones, and in blocks of queries."""
    monkeypatch.setattr(lexical_search, "DOCUMENTS", 30)
    pick = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "A1"]
    text = lambda n: " ".join(pick.choice(words[: pick.choice([5, 20, 63])]) for _ in range(n))
    docs = [(i, text(pick.choice([0, 1, 5, 30, 100]))) for i in range(300)]
    docs += [(1000 + i, docs[5 + i % 3][1]) for i in range(20)]  # ties
    items = [(i, text(pick.choice([1, 4, 12]))) for i in range(25)]
    got = lexical_search.ranked(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), depth, block
    )
    same([(r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()], best(docs, items, depth))


def test_search_of_odd_rows(spark, odd, none):
    items = [(1, "The brown FOX and next"), (1, "fox w5"), (2, None), (3, ""), (4, " \t"), (None, "id here"), (5, "absent"), (6, LONG), (7, "ñandú-öl Äpfel")]
    frame_ = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.ranked(odd, frame_).collect()]
    same(got, best([(r[0], r[1]) for r in ODD], items))
    assert lexical_search.ranked(none, frame_).collect() == []
    assert lexical_search.ranked(odd, frame_.where("item_id = 2")).collect() == []


def test_accumulators_stop():
    """Behind a rare term that outweighs the rest no document is added, and those that exist get their exact score."""
    rare = (np.array([0, 1]), np.array([100, 90]))
    often = (np.arange(6), np.array([5, 6, 7, 8, 9, 10]))
    assert lexical_search.search([rare, often], 6, 2).tolist() == [105, 96, 0, 0, 0, 0]
    assert lexical_search.search([rare, often], 6, 3).tolist() == [105, 96, 7, 8, 9, 10]
    assert lexical_search.search([rare, often], 6, 3, floor=50).tolist() == [105, 96, 0, 0, 0, 0]


# filter audit


def audited(docs, labels):
    """Rows of the audit, one document after the other."""
    first, marks = {}, {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, q, x in labels:
        good, toxic = marks.get(d, (False, False))
        marks[d] = (good or q == 1, toxic or x == 1)
    parts = {}
    for d, t, part in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            fails.add("C")
        if any(c in "#$%&*|" for c in t):
            fails.add("D")
        if d is not None and d > first[t]:
            fails.add("E")
        good, toxic = marks.get(d, (False, False)) if d is not None else (False, False)
        parts.setdefault(part or "", []).append((fails, good, toxic))
    out, total = [], Counter()
    for part, found in parts.items():
        for order in permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                everywhere = sum(f in x[0] for x in found)
                total[part, f] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), everywhere - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone)))
    return [(*row, total[row[0], row[1][row[2] - 1]]) for row in out]


def test_audit_of_odd_rows(spark, odd, none):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(odd, marks).collect()
    assert sorted(tuple(r) for r in got) == sorted(audited([(r[0], r[1], r[2]) for r in ODD], labels))
    assert filter_audit.audit(none, marks).collect() == []


def test_audit_of_random_texts(spark):
    pick = random.Random(2)
    texts = [" ".join(pick.choice(["a", "B", "c#", "D$d", "eE", "f", "g" * 3, str(i)]) for i in range(pick.choice([0, 3, 99, 100, 101, 400]))) for _ in range(60)]
    docs = [(i, pick.choice(texts), pick.choice(["x", "y", None])) for i in range(300)]
    labels = [(i, pick.randint(0, 1), pick.randint(0, 1)) for i in range(0, 300, 2)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(audited(docs, labels))


def test_walk_and_shapley_by_definition():
    pick = random.Random(1)
    cells = [(m, pick.randint(0, 9), pick.randint(0, 3), pick.randint(0, 3)) for m in range(32) if pick.random() < 0.7]
    left = filter_audit.states(cells)
    for subset in range(32):
        assert left[subset].tolist() == [sum(c[k] for c in cells if not c[0] & subset) for k in (1, 2, 3)]
    rows = filter_audit.steps(cells)
    for f, worth in zip("ABCDE", filter_audit.shapley(left[:, 0])):
        assert worth == sum(r[3] for r in rows if r[0][r[1] - 1] == f) and {r[8] for r in rows if r[0][r[1] - 1] == f} == {worth}
    assert filter_audit.states([]).tolist() == [[0, 0, 0]] * 32


# components in parts


def test_components_in_parts(spark):
    from turnloom.llm.unions import united

    pick = random.Random(9)
    edges = [(pick.randrange(400), pick.randrange(400)) for _ in range(260)] + [(5, 5), (None, 3)]
    root = {n: n for n in range(400)}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges[:-1]:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {n: find(n) for n in root if find(n) != n}
    df = spark.createDataFrame(edges, "a long, b long")
    for part in (1 << 20, 40):
        assert {r.node: r.component for r in united(df, part).collect()} == want
    name = lambda c: F.lpad(F.col(c).cast("string"), 4, "0").cast("binary").alias(c)
    names = df.select(name("a"), name("b"))
    assert {int(r.node): int(r.component) for r in united(names).collect()} == want
    assert united(df.where("a < 0")).collect() == []
