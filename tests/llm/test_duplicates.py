"""SimHash, exact copies, recurring lines and fingerprints against plain forms, with odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import LONG, ODD, frame, reach, simhash, winnowed

from turnloom.llm import exact_dedup, line_dedup, near_copies, simhash as sh, winnowing
from turnloom.llm.components import components


def signed(value):
    return value - (1 << 64) if value >> 63 else value


# SimHash


def test_simhash_of_odd_rows(spark, odd, none):
    got = sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id, r.links) for r in sh.near_duplicates(odd).collect())
    prints = [simhash(r[1]) for r in ODD]
    ids = [r[0] for r in ODD]
    root = reach(prints, 2)
    least = {g: min((i for i, r in zip(ids, root) if r == g and i is not None), default=None) for g in set(root)}
    other = [len({p for p in prints if p != q and (p ^ q).bit_count() <= 2}) for q in prints]
    assert got == sorted((i or -1, p, least[r], n) for i, p, r, n in zip(ids, prints, root, other))
    assert sh.near_duplicates(none).collect() == []


def test_one_per_group_keeps_all_columns(odd, none):
    kept = sh.one_per_group(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # 1 stands for its copies, 3 for all texts without words; the row without an id stays alone
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10, 11] and ids.count(None) == 1
    assert sh.one_per_group(none).collect() == []


def clustered(seed, bases=4, each=250):
    pick, found = random.Random(seed), set()
    for _ in range(bases):
        base = pick.getrandbits(64)
        for _ in range(each):
            found.add(base ^ sum(1 << b for b in set(pick.choices(range(64), k=pick.randint(0, 3)))))
    return sorted(found)


@pytest.mark.parametrize("group", [2048, 40, 2])
def test_every_link_is_found_once(spark, group):
    """However deep groups are split, links and components are those of brute force."""
    values = clustered(5)
    rows = sh.linked(spark.createDataFrame([(signed(v),) for v in values], "fp long"), 2, group).collect()
    links = Counter()
    for r in rows:
        links[r.fp % (1 << 64)] += r.links
    near = np.bitwise_count(np.array(values, np.uint64)[:, None] ^ np.array(values, np.uint64)[None, :]) <= 2
    assert {v: int(n) - 1 for v, n in zip(values, near.sum(axis=1)) if n > 1} == dict(links)
    edges = spark.createDataFrame([(r.fp, r.root) for r in rows if r.fp != r.root], "a long, b long")
    label = {r.node: r.component for r in components(edges).collect()}
    root = reach(values, 2)
    together = {}
    for v, r in zip(values, root):
        together.setdefault(r, set()).add(label.get(signed(v), signed(v)))
    assert all(len(s) == 1 for s in together.values()) and len({s.pop() for s in together.values()}) == len(set(root))


def test_walk_in_small_chunks(monkeypatch):
    monkeypatch.setattr(sh, "PAIRS", 64)
    values = np.array(clustered(6, 2, 100), np.uint64)
    pairs = {tuple(sorted(p)) for i, j in sh.walk(values, np.zeros(1, np.int64), 2) for p in zip(i.tolist(), j.tolist())}
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    assert pairs == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if apart[i, j] <= 2}


def test_long_text_in_chunks(monkeypatch):
    whole = sh.fingerprint(LONG)
    monkeypatch.setattr(sh, "SHINGLES", 1000)
    assert sh.fingerprint(LONG) == whole


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, n) for n in range(101, 160)] + [(7, 7), (None, 3), (101, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 1 for n in range(2, 41)}, **{n: 100 for n in range(101, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# exact copies


def test_exact_copies_of_odd_rows(odd, none):
    for capacity in (4096, 1):
        got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(odd, capacity).collect())
        groups = {}
        for r in ODD:
            groups.setdefault(r[1] or "", []).append(r[0])
        want = []
        for r in ODD:
            ids = groups[r[1] or ""]
            keep = max((i for i in ids if i is not None), default=None)
            want.append((r[0] or -1, keep or -1, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
        assert got == sorted(want)
    assert exact_dedup.exact_dedup(none).collect() == []


def test_directory_doubles_until_buckets_fit(spark):
    hashes = spark.range(3000).selectExpr("xxhash64(id) AS hash")
    slots = exact_dedup.directory(hashes.unionByName(hashes), capacity=100).collect()
    depth = slots[0].global_depth
    assert sorted(s.slot for s in slots) == list(range(2**depth))
    fill = Counter()
    where = {s.slot: s.bucket for s in slots}
    for r in hashes.collect():
        fill[where[(r.hash % (1 << 64)) >> (64 - depth)]] += 1
    assert max(fill.values()) <= 100 and Counter(s.bucket for s in slots)[slots[0].bucket] == 2 ** (depth - slots[0].local_depth)


def test_colliding_hashes_are_chained(spark, monkeypatch):
    """Texts of one hash share a bucket that no doubling splits; their bytes tell them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.lit(5).cast("long"))
    docs = frame(spark, [(i, f"text {i % 3}", *[None] * 8) for i in range(9)])
    index = exact_dedup.text_index(docs, capacity=1).collect()
    assert sorted(r["chain"] for r in index) == [1, 2, 3] and {r.group_size for r in index} == {3}
    assert {r.doc_id for r in exact_dedup.exact_dedup(docs, 1).where("kept").collect()} == {6, 7, 8}


# near copies of the pipeline


def test_near_copies_are_those_of_five_word_jaccard(spark, odd):
    """Edited copies many fingerprint bits apart are linked, also over a middle text; texts alike below 0.8 are not."""
    from corpus_pipeline import drop_near_copies

    def text(seed, changed=()):
        return " ".join(f"e{seed}x{i}" if i in changed else f"w{seed}x{i}" for i in range(300))

    texts = [text(1), text(1, {50, 150}), text(1, {20, 50, 80, 110, 150, 200, 250, 280}), text(2), text(2, range(10, 300, 20)), text(3), text(3)]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(296)}
    like = lambda a, b: len(grams(texts[a]) & grams(texts[b])) / len(grams(texts[a]) | grams(texts[b]))
    assert like(0, 1) >= 0.8 and like(1, 2) >= 0.8 > max(like(0, 2), like(3, 4))
    assert all((simhash(texts[i]) ^ simhash(texts[j])).bit_count() > 2 for i, j in ((0, 1), (1, 2), (0, 2)))
    docs = frame(spark, [(i, t, *[None] * 8) for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in drop_near_copies(spark, docs, "").collect()) == [0, 3, 4, 5]
    kept = [r.doc_id for r in drop_near_copies(spark, odd, "").collect()]
    assert sorted(k or -1 for k in kept) == [-1, 1, 3, 6, 7, 8, 9, 10, 11]
    assert drop_near_copies(spark, odd.where("doc_id > 100"), "").collect() == []


@pytest.mark.parametrize("cells, range_bytes", [(1 << 17, 1 << 24), (500, 4000)])
def test_near_copies_of_random_texts(spark, cells, range_bytes):
    """All components of the similarity join by all pairs are found, whatever the size of blocks; no others are."""
    from test_joins import edited, linked

    rows = edited(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.classes(df, cells, range_bytes).collect()}
    assert got == {d: c for d, _, c in linked(rows)}


def test_trie_finds_the_links_of_a_tile():
    make = np.random.default_rng(3)
    base = np.unique(make.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([make.choice(base, 190, replace=False), make.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(20)]
    sets += [np.unique(make.integers(0, 1 << 63, 150, dtype=np.uint64)) for _ in range(10)]
    label, sizes = list(range(30)), np.array([len(s) for s in sets])
    bits = [near_copies.fingerprint(s) for s in sets]
    plain = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in sets]
    assert [int(b[0]) for b in bits] == plain
    found = near_copies.trie_links(label, np.zeros(30, int), sizes, bits, sets, True)
    assert len(found) == 19 and {x for pair in found for x in pair} == set(range(20))
    side = np.array([0] * 10 + [1] * 20)
    assert all(side[i] != side[j] for i, j in near_copies.trie_links(label, side, sizes, bits, sets, False))


# lines


def test_lines_of_odd_rows(odd, none):
    got = {(r.row.doc_id, r.row.text): (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(odd).collect()}
    assert got[1, ODD[0][1]] == (ODD[0][1], 1, 0)
    assert got[2, ODD[1][1]] == ("", 1, 1)
    assert got[3, None] == (None, 0, 0) and got[4, ""] == ("", 1, 0) and got[5, " \t\n "] == (" \t\n ", 2, 0)
    assert got[9, ODD[11][1]][1:] == (3, 0) and got[8, LONG][2] == 0
    assert line_dedup.drop_lines(odd).count() == len(ODD)
    assert line_dedup.drop_lines(none).collect() == []


def test_variable_fields_are_generalised(spark):
    texts = [
        "Posted in the open forum by Ann on day 12 of March\nown words of one",
        "Posted in the open forum by Bob on day 7 of March\nyet other words here",
        "Posted in the open forum by Cleo on day 9 of March",
        "Posted in the hope that nobody reads it on that wall here",  # same leaf, other line
        "1 2 3 4 5 6 7 8\nPosted 99 times",
        "9 8 7 6 5 4 3 2",  # digits alone are no template
    ]
    docs = frame(spark, [(i, t, *[None] * 8) for i, t in enumerate(texts)])
    got = {r.row.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_lines(docs).collect()}
    assert got[0] == (texts[0], 0)
    assert got[1] == ("yet other words here", 1) and got[2] == ("", 1)
    assert all(got[i] == (texts[i], 0) for i in (3, 4, 5))


def test_lines_that_differ_in_their_fourth_word_share_a_leaf(spark):
    texts = ["And edon en for ndesea be edon lis", "And edon en to ndesea be edon lis"]
    docs = frame(spark, [(i, t, *[None] * 8) for i, t in enumerate(texts)])
    assert {r.row.doc_id: r.n_dropped for r in line_dedup.drop_lines(docs).collect()} == {0: 0, 1: 1}


def test_short_lines_and_lines_of_many_fields_recur(spark):
    texts = [
        "Menu\nRead more\nPage 3 of 10\nat 10:01 node 7 sent 12 bytes in 9 ms\n1 2 3\n| 4 | 5 |\nHello world",
        "Menu\nRead more\nPage 4 of 12\nat 11:30 node 2 sent 88 bytes in 1 ms\n4 5 6\n| 6 | 7 |\nHello there\n",
    ]
    docs = frame(spark, [(i, t, *[None] * 8) for i, t in enumerate(texts)])
    got = {r.row.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_lines(docs).collect()}
    assert got == {0: (texts[0], 0), 1: ("4 5 6\n| 6 | 7 |\nHello there\n", 4)}


def test_repeats_within_one_document_stay(spark):
    line = "the same five words again"
    docs = frame(spark, [(1, f"{line}\n{line}", *[None] * 8), (2, "another line of five words", *[None] * 8)])
    assert line_dedup.drop_lines(docs).agg({"n_dropped": "sum"}).first()[0] == 0
    # across documents all but the very first go
    more = docs.unionByName(frame(spark, [(3, f"x\n{line}", *[None] * 8)]))
    assert {r.row.doc_id: r.n_dropped for r in line_dedup.drop_lines(more).collect()} == {1: 1, 2: 0, 3: 1}


# fingerprints


def test_winnowing_of_odd_rows(odd, none):
    got = winnowing.compare_neighbours(odd).collect()
    rows = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in ODD))
    want = []
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        part = len(text) // 4
        edited = text[: len(text) - part] + after[:part]
        sets = [set(winnowing.winnow(t)[0].tolist()) for t in (text, edited, after)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(sets[0], sets[1]), like(sets[0], sets[2])))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted(want)
    copies = [r.fingerprint for r in got if r.doc_id in (1, 2)]
    assert len(set(copies)) == 1
    assert winnowing.compare_neighbours(none).collect() == []


def test_successors_across_buckets(spark):
    docs = frame(spark, [(7 * i, f"text number {i} " * (i % 5), *[None] * 8) for i in range(50)]).repartition(4)
    rows = winnowing.in_order(docs, rows_per_bucket=6).collect()
    by = {}
    for r in rows:
        by.setdefault(r.bucket, []).append((r.tail, r.order))
    seen = {}
    for found in by.values():
        found.sort()
        assert [t for t, _ in found] == [False] * (len(found) - 1) + [True]
        for (_, a), (_, b) in zip(found, found[1:]):
            seen[a] = b
    assert len(by) > 5 and seen == {7 * i: 7 * ((i + 1) % 50) for i in range(50)}


def test_winnow_is_the_definition():
    pick = random.Random(2)
    texts = ["", "a", "short", "x" * 200, "ab" * 150, "".join(pick.choices("abcdé ", k=700))]
    want = [winnowed(t, winnowing._BASE) for t in texts]
    assert [list(zip(*(a.tolist() for a in winnowing.winnow(t)))) for t in texts] == want


def test_winnow_across_segments():
    """A text longer than a segment: windows at the border are whole and positions go on."""
    text = "".join(random.Random(3).choices("abcdefgh ", k=winnowing.SEGMENT + 5000))
    hashes, places = winnowing.winnow(text)
    assert np.all(np.diff(places) > 0) and np.diff(places).max() <= winnowing.WINDOW
    tail = text[winnowing.SEGMENT - 3000 :]
    h, p = winnowing.winnow(tail)
    shift = winnowing.SEGMENT - 3000
    inside = (places >= shift + 100) & (places < len(text) - 100)
    own = (p + shift >= shift + 100) & (p + shift < len(text) - 100)
    assert places[inside].tolist() == (p + shift)[own].tolist() and hashes[inside].tolist() == h[own].tolist()


def test_shared_passage_is_always_met():
    pick = random.Random(4)
    for _ in range(200):
        passage = "".join(pick.choices("abcdefgh ", k=winnowing.GRAM + winnowing.WINDOW - 1))
        a, b = ("".join(pick.choices("ijklmnop ", k=90)) + passage + "".join(pick.choices("ijklmnop ", k=90)) for _ in range(2))
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())
