"""Operators against brute force, including the paths taken only by large groups."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import agreement as ag
from turnloom.operators import alignment as al
from turnloom.operators import judging as jd
from turnloom.operators import lexical as lx
from turnloom.operators import preferences as pf
from turnloom.operators import ranking as rk
from turnloom.operators import reports as rp
from turnloom.operators import retrieval as rt
from turnloom.operators import rubrics as rb
from turnloom.operators import sampling as sm
from turnloom.operators import similarity as sim
from turnloom.operators import stages as sg
from turnloom.operators import stats as st
from turnloom.operators import summaries as su
from turnloom.operators import turns as tn


def pairs(spark, rows, schema="grp string, label double, pred double"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def noisy():
    rng = random.Random(3)
    return [(f"g{i % 2}", float(rng.randint(0, 6)), round(rng.random(), 2)) for i in range(120)]


def tau_b(x, y):
    con = dis = tx = ty = 0
    for (a, b), (c, d) in combinations(list(zip(x, y)), 2):
        s = np.sign(a - c) * np.sign(b - d)
        con, dis, tx, ty = con + (s > 0), dis + (s < 0), tx + (a == c), ty + (b == d)
    n0 = len(x) * (len(x) - 1) / 2
    return (con - dis) / math.sqrt((n0 - tx) * (n0 - ty))


def test_correlations(spark, noisy):
    import pandas as pd

    got = {r.grp: r for r in st.correlations(pairs(spark, noisy), ["grp"]).collect()}
    for g, part in pd.DataFrame(noisy, columns=["grp", "label", "pred"]).groupby("grp"):
        assert got[g].pearson == pytest.approx(part.label.corr(part.pred))
        assert got[g].spearman == pytest.approx(part.label.rank().corr(part.pred.rank()))
        assert got[g].kendall == pytest.approx(tau_b(part.label.tolist(), part.pred.tolist()))


def test_correlation_of_a_constant_is_null(spark):
    row = st.correlations(pairs(spark, [("g", 1.0, 0.1), ("g", 1.0, 0.2)]), ["grp"]).first()
    assert (row.pearson, row.spearman, row.kendall) == (None, None, None)


def test_auc_by_pairs(spark, noisy):
    rows = [(g, float(y > 3), p) for g, y, p in noisy]
    got = {r.grp: r.auc for r in st.auc(pairs(spark, rows), ["grp"]).collect()}
    flipped = {r.grp: r.auc for r in st.auc(pairs(spark, [(g, y, -p) for g, y, p in rows]), ["grp"]).collect()}
    for g in ("g0", "g1"):
        pos = [p for h, y, p in rows if h == g and y == 1]
        neg = [p for h, y, p in rows if h == g and y == 0]
        assert got[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
        assert got[g] == pytest.approx(1 - flipped[g])
    assert st.auc(pairs(spark, [("g", 1.0, 0.5)]), ["grp"]).first().auc is None


def test_threshold_sweep(spark):
    rng = random.Random(5)
    rows = [("g", float(rng.random() < 0.5), rng.choice([i / 1000 for i in range(1001)] + [0.5, 0.3, 1.0, 0.0])) for _ in range(300)]

    def bacc(t):
        pos, neg = [p for _, y, p in rows if y == 1], [p for _, y, p in rows if y == 0]
        return round((sum(p > t for p in pos) / len(pos) + sum(p <= t for p in neg) / len(neg)) / 2, 12)

    best = max(range(1001), key=lambda i: (bacc(i / 1000), -i))
    row = st.tune_threshold(pairs(spark, rows), ["grp"]).first()
    assert (row.threshold, row.tuned_score) == (best / 1000, pytest.approx(bacc(best / 1000)))


def test_single_class_metrics(spark):
    row = st.class_metrics(pairs(spark, [("g", 1.0, 0.9), ("g", 1.0, 0.5)]), ["grp"]).first()
    assert (row.accuracy, row.balanced_accuracy, row.mcc) == (0.5, 0.5, 0.0)


def test_wilcoxon(spark):
    a = [125, 115, 130, 140, 140, 115, 140, 125, 140, 135]
    b = [110, 122, 125, 120, 140, 124, 123, 137, 135, 145]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    row = st.wilcoxon(df).first()
    assert (row.n_nonzero, row.statistic) == (9, 18.0)
    assert row.p_value == pytest.approx(0.5936, abs=2e-3) and not row.significant


def test_first_maximum_wins(spark):
    rows = [("i", 0, 0.5, False), ("i", 1, 0.9, True), ("i", 2, 0.9, False)]
    df = spark.createDataFrame(rows, "item string, pos int, score double, is_answer boolean")
    assert st.choice_accuracy(df, "item").first().accuracy == 1.0


def test_kappa_and_alpha(spark):
    units = {"u1": "aab", "u2": "aaa", "u3": "bbb", "u4": "abb", "u5": "ab"}
    rows = [(u, i, v) for u, vs in units.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "unit string, rater int, value string")
    kappa = ag.cohen_kappa(df, ["unit"], "rater", "value").first()
    assert kappa.n_units == 4 and kappa.kappa == pytest.approx(0.5)
    long = {u: v for u, v in units.items() if len(v) > 2}
    values = [v for vs in long.values() for v in vs]
    do = sum(sum(a != b for i, a in enumerate(vs) for j, b in enumerate(vs) if i != j) / (len(vs) - 1) for vs in long.values())
    de = sum(a != b for i, a in enumerate(values) for j, b in enumerate(values) if i != j) / (len(values) - 1)
    assert ag.krippendorff_alpha(df, ["unit"], "value").first().alpha == pytest.approx(1 - do / de)


@pytest.fixture()
def vectors(spark):
    rng = np.random.default_rng(0)
    # one group holds most rows
    rows = [(i, "hot" if i < 40 else f"c{i % 3}", [float(x) for x in rng.normal(size=5)]) for i in range(52)] + [(99, "lone", [1.0] * 5)]
    return rows, spark.createDataFrame(rows, "vec_id long, grp string, embedding array<float>")


@pytest.mark.parametrize("block", [3, 2048])
def test_self_redundancy_over_tiles(vectors, block):
    rows, df = vectors
    got = {r.grp: r.redundancy for r in sim.self_redundancy(df, "grp", "vec_id", block=block).collect()}
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    for g in {r[1] for r in rows}:
        vs = [np.float32(r[2]).astype(float) for r in rows if r[1] == g]
        best = [max((cos(a, b) for j, b in enumerate(vs) if i != j), default=-1.0) for i, a in enumerate(vs)]
        assert got[g] == pytest.approx(np.mean(best))


@pytest.mark.parametrize("block", [2, 2048])
def test_cross_maxima_over_tiles(vectors, block):
    rows, df = vectors
    out = sim.cross_maxima(df.where("vec_id % 2 = 0"), df.where("vec_id % 2 = 1"), ["grp"], "vec_id", block=block)
    got = {(r.side, r.vec_id): r.best for r in out.collect()}
    assert len(got) == len(rows)
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    for i, g, v in rows:
        others = [w for j, h, w in rows if h == g and j % 2 != i % 2]
        want = max((cos(np.float32(v), np.float32(w)) for w in others), default=-1.0)
        assert got[("right" if i % 2 else "left", i)] == pytest.approx(want, abs=1e-6)


def test_followup(spark):
    e, f = [1.0, 0.0], [0.0, 1.0]
    rows = [("c", 0, 1, e), ("c", 1, 2, f), ("c", 1, 3, e), ("c", 2, 4, f), ("c", 3, 5, e), ("d", 0, 6, e)]
    df = spark.createDataFrame(rows, "conv string, turn int, vec_id int, embedding array<double>")
    got = {r.conv: r.followup for r in sim.followup_score(df, df, "conv", "turn", "vec_id").collect()}
    assert got == {"c": pytest.approx(2 / 3), "d": 0.0}


def test_overlap_metrics(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat the cat"), (2, "", "x"), (3, "a b", "")], "item_id int, a string, b string")
    uni = {r.item_id: r for r in lx.rouge_n(df, 1, stem=False).collect()}
    assert uni[1].precision == 3 / 4 and uni[1].recall == 3 / 6 and uni[2].f == 0.0 and uni[3].f == 0.0
    lcs = {r.item_id: r for r in lx.rouge_l(df, stem=False).collect()}
    assert lcs[1].recall == 3 / 6 and lcs[3].f == 0.0
    assert lx.common_length("abcbdab", "bdcaba") == 4
    assert {r.item_id: r.score for r in lx.bleu(df, 1).collect()}[3] == 0.0
    plan = lx.rouge(df, ("1", "2", "L"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for kind in ("1", "2"):
        assert "Python" not in lx.rouge_n(df, int(kind), stem=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in lx.bleu(df, 4)._jdf.queryExecution().executedPlan().toString()


def test_multisets_of_grams(spark):
    from collections import Counter

    from turnloom.functions import grams as gr

    rng = random.Random(5)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for n in (1, 2, 3):
        a, b = gr.tagged(gr.ngrams(F.col("a"), n)), gr.tagged(gr.ngrams(F.col("b"), n))
        got = df.select("a", "b", gr.shared(a, b).alias("both"), F.size(gr.widest(F.array(a, b))).alias("either")).collect()
        for r in got:
            ca, cb = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (r.a, r.b))
            assert r.both == (ca & cb).total() and r.either == (ca | cb).total()


def test_overlap_of_null_texts(spark):
    df = spark.createDataFrame([(1, None, "x y"), (2, "x", None)], "item_id int, a string, b string")
    assert [(r.rouge1_f, r.rougeL_f) for r in lx.rouge(df).collect()] == [(0.0, 0.0)] * 2


def test_common_lengths_side_by_side():
    """Sentences of up to three numbers' width, against the sweep over one pair."""
    rng = random.Random(7)
    text = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    sentences = [text(n) for n in (0, 1, 5, 63, 64, 65, 128, 150)]
    side = lx.Sentences(sentences)
    for n in (0, 1, 20, 200):
        words = text(n)
        assert side.common_lengths(words).tolist() == [lx.common_length(s, words) for s in sentences]


def test_bleu_by_definition(spark):
    from collections import Counter

    def one(refs, hyp, weights):
        grams = lambda ts, k: Counter(tuple(ts[i : i + k]) for i in range(len(ts) - k + 1))
        logs = 0.0
        for k, w in enumerate(weights, 1):
            cap = Counter()
            for ref in refs:
                cap |= grams(ref, k)
            hits = (grams(hyp, k) & cap).total()
            if (w or k == 1) and not hits:
                return 0.0
            if w:
                logs += w * math.log(hits / (len(hyp) - k + 1))
        near = min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1]
        return min(1.0, math.exp(1 - near / len(hyp))) * math.exp(logs)

    rng = random.Random(6)
    text = lambda n: [rng.choice("abc") for _ in range(n)]
    rows = [(i, [text(rng.randint(1, 12)) for _ in range(rng.randint(1, 4))], [text(rng.randint(1, 12)) for _ in range(rng.randint(1, 3))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, _refs array<array<string>>, _hyps array<array<string>>")
    for weights in ((1.0,), (0.0, 1.0), (0.33, 0.33, 0.33), (0.25,) * 4):
        got = {(r.id, r.hyp): r.bleu for r in lx.bleu_of_tokens(df, "id", weights=weights).collect()}
        assert got == pytest.approx({(i, j): one(refs, h, weights) for i, refs, hyps in rows for j, h in enumerate(hyps)})


def test_key_phrases_by_definition(spark):
    import heapq
    from collections import Counter

    from turnloom.operators import keyphrases as kp

    texts = ["The red car and the blue car race, red car wins; blue bike. A red, red apple.", "", None, "the of and", "One two three four"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in kp.key_phrases(df, "id", "t", 3).collect():
        got.setdefault(r.id, []).append((r["rank"], r.phrase, r.phrase_score))
    want = {}
    for row in df.select("id", kp.candidate_phrases(F.col("t")).alias("ps")).collect():
        split = [p.split(" ") for p in row.ps or []]
        count, degree = Counter(w for ws in split for w in ws), Counter()
        for ws in split:
            for w in ws:
                degree[w] += len(ws)
        best = heapq.nlargest(3, [(round(sum(degree[w] / count[w] for w in ws), 9), " ".join(ws)) for ws in split])
        if best:
            want[row.id] = [(i, p, s) for i, (s, p) in enumerate(best, 1)]
    assert got == want and len(want) == 2
    assert "Python" not in kp.key_phrases(df, "id", "t")._jdf.queryExecution().executedPlan().toString()


def test_bleu_known_value(spark):
    df = spark.createDataFrame([(1, "the cat is on the mat", "the the the the the the the")], "item_id int, a string, b string")
    assert lx.bleu(df, 1).first().score == pytest.approx(2 / 7)


def test_alignment_client_equals_stand_in(spark):
    df = spark.createDataFrame([(1, "A b c. D e f.", "a b x. d q."), (2, "One.", "")], "item_id int, premise string, hypothesis string")

    def make():
        def client(batch):
            out = []
            for p, h in batch:
                ps, hs = set(p.lower().replace(".", "").split()), set(h.lower().replace(".", "").split())
                c = len(ps & hs) / len(hs) if hs else 0.0
                out.append((c, c, [c, 0.0, 1 - c]))
            return out

        return client

    native = {r.item_id: r.alignment for r in al.alignment_score(df).collect()}
    plugged = {r.item_id: r.alignment for r in al.alignment_score(df, make_client=make).collect()}
    assert native == pytest.approx(plugged) and native[1] == pytest.approx((2 / 3 + 1 / 2) / 2)
    heads = sg.score_pairs(df, make_client=make).where("item_id = 1").first()
    assert heads.tri[0] == heads.bin and heads.score_error is None


def containment_client(log=None, fail=None):
    def make():
        def client(batch):
            if log:
                with open(log, "a") as out:
                    out.write(f"{len(batch)} {len({p for p, _ in batch})}\n")
            out = []
            for p, h in batch:
                if fail and fail in h:
                    raise ValueError("cannot score")
                ps, hs = set(p.lower().replace(".", "").split()), set(h.lower().replace(".", "").split())
                c = len(ps & hs) / len(hs) if hs else 0.0
                out.append((c, c, [c, 0.0, 1 - c]))
            return out

        return client

    return make


GRIDS = [(i, " ".join(f"a{k} b{k % 3} c." for k in range(i % 5)), " ".join(f"a{k} b{k % 2} x." for k in range(i % 4))) for i in range(60)]


def test_batches_cross_items(spark, tmp_path):
    """A pair of texts has at most a few cells, but all batches but a task's last one are full and hold several items."""
    df = spark.createDataFrame(GRIDS, "item_id int, premise string, hypothesis string").coalesce(1)
    log = str(tmp_path / "log")
    al.smart_n(df, make_client=containment_client(log)).collect()
    sizes = [tuple(map(int, line.split())) for line in open(log)]
    cells = sum((i % 5) * (i % 4) for i, *_ in GRIDS)
    assert sum(n for n, _ in sizes) == 2 * cells and max(n for n, _ in sizes) == 32
    assert sum(n < 32 for n, _ in sizes) <= 2 * 4 and max(p for _, p in sizes) > 1


@pytest.mark.parametrize("score", ["smart_n", "smart_l", "alignment_score"])
def test_client_scores_equal_stand_in(spark, score):
    df = spark.createDataFrame([*GRIDS, (60, None, "a b."), (61, "a.", None), (61, "a.", "a.")], "item_id int, premise string, hypothesis string")
    run = getattr(al, score)
    columns = [c for c in run(df).columns if c not in ("premise", "hypothesis")]
    key = lambda row: tuple(map(str, row))
    native = sorted((tuple(r) for r in run(df).select(columns).collect()), key=key)
    plugged = run(df, make_client=containment_client())
    assert plugged.where("n_failed > 0").isEmpty()
    plugged = sorted((tuple(r) for r in plugged.select(columns).collect()), key=key)
    assert [r[0] for r in native] == [r[0] for r in plugged]
    assert [x or 0.0 for r in native for x in r[1:]] == pytest.approx([x or 0.0 for r in plugged for x in r[1:]])


def test_a_failed_cell_keeps_its_error(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "a b. bad one."), (2, "A b.", "bad."), (3, "A b.", "a b.")], "item_id int, premise string, hypothesis string")
    rows = {r.item_id: r for r in al.alignment_score(df, make_client=containment_client(fail="bad")).collect()}
    assert rows[1].alignment == 1.0 and "cannot score" in rows[1].alignment_error and rows[1].n_failed == 1
    assert rows[2].alignment is None and rows[2].n_failed == 1
    assert rows[3].alignment == 1.0 and rows[3].alignment_error is None and rows[3].n_failed == 0
    rows = {r.item_id: r for r in al.smart_l(df, make_client=containment_client(fail="bad")).collect()}
    assert rows[2].score == 0.0 and "cannot score" in rows[2].error and rows[3].score == 1.0 and rows[1].n_failed == 2
    rows = {r.item_id: r for r in al.smart_n(df, make_client=containment_client(fail="bad")).collect()}
    assert rows[1].precision == 1.0 and rows[1].n_failed == 2 and rows[3].f == 1.0


def test_soft_subsequence(spark):
    df = spark.createDataFrame([(1, "a b. c d. e f.", "a b. e x.")], "item_id int, premise string, hypothesis string")
    grid = [[1.0, 0.0], [0.0, 0.0], [0.0, 0.5]]
    table = [[0.0] * 3 for _ in range(4)]
    for i in range(1, 4):
        for j in range(1, 3):
            m = grid[i - 1][j - 1]
            table[i][j] = max(table[i - 1][j - 1] + m, table[i - 1][j] + m, table[i][j - 1])
    assert al.smart_l(df).first().score == pytest.approx(table[3][2] / 3)


def bm25_by_definition(docs, queries, k):
    avg, n = np.mean([len(t.split()) for _, t in docs]), len(docs)
    want = {}
    for q, text in queries:
        scores = {}
        for i, t in docs:
            ts = t.split()
            for term in text.split():
                df = sum(term in u.split() for _, u in docs)
                tf = ts.count(term)
                if tf:
                    scores[i] = scores.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        ranked = sorted(scores.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:k]
        want.update({(q, place): (i, round(s, 6)) for place, (i, s) in enumerate(ranked, 1)})
    return want


@pytest.mark.parametrize("block, first", [(3, 1), (4096, 20)])
def test_bm25_is_exact(spark, monkeypatch, block, first):
    """Also where blocks are small and few postings set the first bound, so that most terms and blocks are passed over."""
    monkeypatch.setattr(rt, "FIRST", first)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(words[min(39, int(rng.expovariate(0.15)))] for _ in range(n))
    docs = [(i, text(rng.randint(1, 20))) for i in range(150)] + [(200, "")]
    queries = [(i, text(rng.randint(1, 6))) for i in range(12)] + [(90, "zzz"), (91, "w1 w1 w39")]
    out = rt.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), 5, block=block)
    got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 6)) for r in out.collect()}
    assert got == bm25_by_definition(docs, queries, 5)


@pytest.mark.parametrize("sent", [0, 1 << 16])
def test_bm25_of_odd_rows(spark, monkeypatch, sent):
    """Both ways give the definition's rows: ids and queries as text, a null text, many equal documents, queries without hits."""
    monkeypatch.setattr(rt, "SENT", sent)
    docs = [(f"d{i:03}", "same Words, here" if i % 2 else f"other w{i % 7} words\n WORDS") for i in range(90)] + [("e", ""), ("é", "Été été w1")]
    queries = [("a", "words"), ("b", "été w1 w1"), ("c", "nothing such"), ("d", ""), ("e", "here same")]
    given = spark.createDataFrame([*docs, ("n", None)], "doc_id string, text string")
    out = rt.bm25(given, spark.createDataFrame(queries, "query_id string, text string"), 7)
    got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 6)) for r in out.collect()}
    plain = lambda t: " ".join(t.lower().replace(",", "").split())
    assert got == bm25_by_definition([(i, plain(t)) for i, t in [*docs, ("n", "")]], queries, 7)
    # rows of one id are one document whose shares add up
    twice = rt.bm25(spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a a")], "doc_id int, text string"), spark.createDataFrame([(1, "a")], "query_id int, text string"))
    idf, share = math.log(1 + 0.5 / 3.5), lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (5 / 3)))
    want = [(1, pytest.approx(idf * (share(1, 2) + share(1, 1)))), (2, pytest.approx(idf * share(2, 2)))]
    assert [(r.doc_id, r.score) for r in twice.orderBy("rank").collect()] == want


def test_bm25_shuffles_best_lists_only(spark, tmp_path):
    """A task returns at most ``k`` documents of a query: no pair of query and document beyond these leaves it."""
    rows = spark.range(500).select(F.col("id").alias("doc"), F.array(F.lit(0), F.lit(1)).alias("term"), F.array((F.col("id") % 9).cast("double") + 1, F.lit(0.5)).alias("gain"))
    best = rt.best_scored(rows.coalesce(1), [[(0, 1.0), (1, 2.0)], [(1, 1.0)], [(5, 1.0)]], 4)
    got = sorted((r["query"], r.doc, r.score) for r in best.collect())
    assert got == [(0, i, 10.0) for i in (8, 17, 26, 35)] + [(1, i, 0.5) for i in range(4)]


def test_bm25_moves_a_posting_to_the_queries_of_its_term_only(spark):
    docs = spark.createDataFrame([(i, "often " + ("rare" if i == 3 else f"w{i}")) for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "rare often"), (2, "often"), (3, "w5")], "query_id long, text string")
    index = rt.build_index(docs, block=10)
    blocks = index.blocks.groupBy("term").count().where("term = 'often'").first()
    assert blocks["count"] > 1 and index.blocks.select(F.max(F.size("docs"))).first()[0] < 40
    asked = rt.asked_terms(queries, index, "query_id", "text")
    assert {(r.query, r.term) for r in asked.collect()} == {(1, "rare"), (1, "often"), (2, "often"), (3, "w5")}
    met = rt.reached(asked, index).groupBy("query").count()
    assert {r["query"]: r["count"] for r in met.collect()} == {1: 40, 2: 40, 3: 1}
    # what the rare term reaches already beats all that the frequent one can add, so it brings no candidates
    split = rt.split_terms(asked, rt.first_scores(asked.where("term <> 'often'"), index, 1))
    assert {(r.query, r.term): r.leading for r in split.collect()}[1, "often"] is False
    skipped = rt.reached(split.where("query = 1 and leading"), index)
    assert [r.doc for r in skipped.collect()] == [3]


def test_quantiles_and_histogram(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(200)] + [0.5] * 20
    df = spark.createDataFrame([("s", v) for v in values], "system string, v double")
    q = rk.quantiles(df, "v", [0.25, 0.5], ["system"]).first()
    assert (q.q25, q.q50) == (pytest.approx(np.quantile(values, 0.25)), pytest.approx(np.quantile(values, 0.5)))
    counts = {r.bin: r.n_rows for r in rp.histogram(df, "system", "v").collect()}
    want = np.histogram(values, bins=np.histogram_bin_edges(values, bins="auto"))[0]
    assert [counts.get(i, 0) for i in range(len(want))] == want.tolist()


def test_exact_splits_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 97)
    split = lambda d: {(r.id, r.split) for r in sm.split_by_key(d, "k").select("id", "split").collect()}
    a, b = split(df.repartition(1)), split(df.repartition(7))
    assert a == b
    sides = {s: {i % 97 for i, t in a if t == s} for s in ("train", "test")}
    assert not sides["train"] & sides["test"] and len(sides["train"]) == 87
    assert sm.split_rows(df, "id").where("split = 'train'").count() == 900
    assert sm.sample_rows(df, 0, "id").count() == 0 and sm.sample_rows(df, 5000, "id").count() == 1000
    # one group holds nearly everything
    skew = df.withColumn("g", F.when(F.col("id") < 990, "hot").otherwise("cold"))
    assert {r.g: r["count"] for r in sm.cap_per_group(skew, "g", 100, "id").groupBy("g").count().collect()} == {"hot": 100, "cold": 10}
    assert sorted(r["index"] for r in sm.dense_index(skew, "g", "id").where("g = 'hot'").collect()) == list(range(990))


def test_history_packing(spark):
    rng = random.Random(8)
    convs = {c: [(rng.choice(["Journalist", "Researcher"]), " ".join(["w"] * rng.randint(1, 40))) for _ in range(rng.randint(1, 50))] for c in range(30)}
    rows = [(c, t, a, x) for c, turns in convs.items() for t, (a, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, author string, text string")
    got = {(r.conv_id, r.example): r for r in tn.turn_examples(df, "Journalist", 40, 60).collect()}
    n = 0
    for c, turns in convs.items():
        for i in range(min(len(turns), 40) - 1):
            if turns[i + 1][0] != "Journalist":
                continue
            used, kept = 0, []
            for j in range(i, -1, -1):
                size = len(turns[j][1].split())
                if used + size <= 60:
                    used += size
                    kept.insert(0, ("assistant" if turns[j][0] == "Journalist" else "user", turns[j][1]))
            row = got[(c, i)]
            assert [(m.role, m.content) for m in row.prompt] == kept and row.history_tokens == used <= 60
            n += 1
    assert n == len(got)


def test_long_conversations_render_whole(spark):
    df = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(3000)], "conv_id int, turn int, role string, text string")
    rows = tn.render_conversations(df, sep="|").collect()
    assert len(rows) == 1 and rows[0].text == "|".join(f"Researcher: t{t}" for t in range(3000))


def test_annotation_lists_keep_every_annotation(spark):
    ann = spark.createDataFrame([("u", i, f"v{i:02d}") for i in range(40)] + [("w", 1, None)], "unit string, rater int, value string")
    rows = {r.unit: r for r in ag.annotation_lists(ann, ["unit"], "rater", "value").collect()}
    assert rows["u"].n_annotations == 40 and rows["u"].annotations == [f"v{i:02d}" for i in range(40)]
    assert rows["w"].annotations == [None]
    assert ag.annotation_positions(ann, ["unit"], "rater", "value").where("unit = 'u' and value = 'v39'").first().position == 39


def test_cuts_with_a_far_key_and_null_groups(spark):
    rows = [("a", i) for i in range(500)] + [("a", 2**60)] + [(None, i) for i in range(20)]
    df = spark.createDataFrame(rows, "grp string, key long")
    for limit in (7, 0.5):
        got = {}
        for r in sm.first_per_group(df, "grp", limit, "key").collect():
            got.setdefault(r.grp, []).append(r.key)
        want = {g: k if isinstance(limit, int) else int(limit * n) for g, n, k in (("a", 501, 7), (None, 20, 7))}
        assert {g: sorted(v) for g, v in got.items()} == {g: list(range(n)) for g, n in want.items()}
    capped = sm.cap_per_group(df, "grp", 100, "key").groupBy("grp").count().collect()
    assert {r.grp: r["count"] for r in capped} == {"a": 100, None: 20}
    numbered = sm.dense_index(df, "grp", "key").collect()
    for g, n in (("a", 501), (None, 20)):
        own = [r for r in numbered if r.grp == g]
        assert sorted(r["index"] for r in own) == list(range(n)) and {r.group_size for r in own} == {n}


def test_follow_up_cases(spark):
    df = spark.createDataFrame([(1, []), (0, []), (1, ["x", "y"]), (0, ["x"])], "is_vague int, complex_aspects array<string>")
    ask = lambda compat: [r[0] for r in df.select(pf.follow_up_instruction(F.col("is_vague"), F.col("complex_aspects"), compat)).collect()]
    assert ask(False)[:2] == [pf.VAGUE, pf.CLEAR] and "x, y" in ask(False)[2]
    assert ask(True)[0] == pf.CLEAR


def test_preferences_skip_journalist_endings(spark):
    chat = "array<struct<role:string,content:string>>"
    head = [("system", "s"), ("user", "[PAPER-TITLE]\nt\n[PAPER]\np")]
    rows = [(1, head + [("user", "short answer")]), (2, head + [("assistant", "q")]), (3, head)]
    df = spark.createDataFrame(rows, f"row_id int, prompt {chat}")
    out = {r.row_id: r for r in pf.preference_pairs(df, keep_skipped=True).collect()}
    assert out[1].chosen and out[1].is_vague == 1 and out[2].chosen is None and out[3].rejected is None
    given = df.where("row_id = 1").withColumn("is_vague", F.lit(0)).withColumn("complex_aspects", F.array(F.lit("z")))
    assert pf.preference_pairs(given, generator=lambda p: p).first().chosen.startswith("The last answer holds these unexplained aspects: z.")


def test_retries_isolate_bad_rows(spark):
    def make():
        calls = {"n": 0}

        def client(batch):
            calls["n"] += 1
            if calls["n"] == 1 or "bad" in batch:
                raise ValueError("no")
            return [x.upper() for x in batch]

        return client

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "t string").coalesce(1)
    got = {r.t: (r.r, r.r_error) for r in sg.batch_stage(df, make, F.col("t"), "r", retries=2).collect()}
    assert got["a"] == ("A", None) and got["b"] == ("B", None) and got["bad"] == (None, "ValueError: no")


def test_cached_and_gated_judging(spark):
    df = spark.createDataFrame([(1, "s", "short"), (2, "s", "word " * 60)], "row_id int, system string, conversation string")
    first = jd.judge(df.where("row_id = 1"), rb.RUBRICS[:2], "e")
    assert jd.judge(df, rb.RUBRICS[:2], "e", cache=first).select("row_id").distinct().collect()[0].row_id == 2
    assert jd.judge(df, rb.RUBRICS[:2], "e", cache=first, force=True).count() == 4
    gated = jd.gated_judge(df, rb.RUBRICS[:2], 20)
    assert gated.where("skipped_too_long and score is null").count() == 2 and gated.count() == 4
    assert jd.gated_judge(df, rb.RUBRICS[:2], 20, cumulative=True).count() == 2


def test_reports(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 4), ("b", "x", 0), ("b", "y", 3)]
    df = spark.createDataFrame(rows, "system string, aspect string, score int")
    got = {(r.system, r.aspect): r.mean_score for r in jd.aspect_report(df).collect()}
    assert got[("a", "overall")] == 2.18 and got[("b", "overall")] == 0.0


def test_question_behaviour_joins_open_turns(spark):
    rows = [("s", 1, 0, "Hello and"), ("s", 1, 1, "what else?"), ("s", 1, 2, "Fine.")]
    df = spark.createDataFrame(rows, "author string, conv_id int, turn int, text string")
    row = tn.question_behaviour(df, "author").first()
    assert (row.turns_without_question, row.questions_per_turn, row.questions_per_conversation) == (0.67, 0.33, 1.0)


def test_questions_of_a_long_conversation(spark):
    """Counts without joining texts equal those of the joined text, also for one conversation of 3000 turns."""
    rng = random.Random(8)
    said = ["Yes.", "what is", "and then", "so? ", " ", "How are you? Fine.", "no! who", "the end", "why not? is it. what", "ok then?", "Can we"]
    rows = [("s", c, t, rng.choice(said)) for c, n in ((1, 3000), (2, 40), (3, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "author string, conv_id int, turn int, text string")
    from turnloom.functions import text as tx

    joined = {}
    for _, c, _, text in rows:
        joined.setdefault(c, []).append(text)
    whole = spark.createDataFrame([("\n\n".join(v),) for v in joined.values()], "t string")
    want = sum(r.n for r in whole.select(F.size(tx.questions(F.col("t"))).alias("n")).collect()) / 3
    assert tn.question_behaviour(df, "author", rounded=False).first().questions_per_conversation == pytest.approx(want)


def test_summary_size(spark):
    text = " ".join(f"Sentence number {i} about cats and dogs." for i in range(40))
    df = spark.createDataFrame([(text,), ("Only one.",), ("",)], "t string")
    got = [r.summary for r in su.extractive_summary(df, "t").collect()]
    assert len(got[0].split("\n")) == 2 and got[1] == "" and got[2] == ""


def test_summary_ranks_by_dense_matrix():
    """Ranks over sparse edges are those of the whole matrix; edges are only between sentences that share words."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    sents = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["alone here", "x", "x"]
    sets = [set(t.split()) for t in sents]
    scale = lambda a, b: math.log10(len(a)) + math.log10(len(b))
    n = len(sents)
    matrix = np.array([[len(sets[i] & sets[j]) / scale(sents[i], sents[j]) if i != j and scale(sents[i], sents[j]) > 0 else 0.0 for j in range(n)] for i in range(n)])
    degree, rank = matrix.sum(axis=1), np.full(n, 1 / n)
    for _ in range(su.ROUNDS):
        rank = (1 - su.DAMPING) / n + su.DAMPING * matrix @ np.divide(rank, degree, out=np.zeros(n), where=degree > 0)
    assert su.sentence_ranks(sents) == pytest.approx(rank)
    start, other, weight = su.sentence_edges(sents)
    assert len(other) == len(weight) == start[-1] == np.count_nonzero(matrix)


def test_summary_graph_in_blocks(monkeypatch):
    """Blocks of any size give the same edges, also of a sentence alone over a block; what is counted at once is bounded."""
    rng = random.Random(12)
    sents = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 12))) for _ in range(200)] + [" ", "alone", "x", "x"]
    whole, ranks = su.sentence_edges(sents), su.sentence_ranks(sents)
    assert len(whole[0]) == len(sents) + 1 and len(whole[1]) == whole[0][-1]
    counted, real = [], np.bincount
    spy = lambda x, weights=None, minlength=0: counted.append(minlength) or real(x, weights, minlength)
    for cells in (1, 500, 10_000):
        monkeypatch.setattr(su, "CELLS", cells)
        with monkeypatch.context() as seen:
            seen.setattr(np, "bincount", spy)
            again = su.sentence_edges(sents)
        assert all(np.array_equal(a, b) for a, b in zip(whole, again))
        assert max(counted) <= max(cells, len(sents))
        counted.clear()
    # ranks of the edges are those of the whole matrix
    monkeypatch.setattr(su, "WHOLE", 10**9)
    assert su.sentence_ranks(sents) == pytest.approx(ranks, abs=1e-14)


def test_retrieval_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 13, 1), (2, 10, 1)], "query_id long, doc_id long, grade int")
    row = rt.retrieval_metrics(run, qrels, [3]).first()
    dcg, ideal = 2 / math.log2(3) + 1 / 2, 2 + 1 / math.log2(3) + 1 / 2
    assert row.ndcg == pytest.approx(dcg / ideal) and row.map == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert row.recall == pytest.approx(2 / 3) and row.n_queries == 1
