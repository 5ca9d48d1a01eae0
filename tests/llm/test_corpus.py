"""Mixing, shards, personal data, toxicity, tokens and chat with odd rows, against plain forms."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import LONG, ODD, WORD, frame

from pyspark.sql import functions as F
from turnloom.llm import bpe, chat, mixing, pii, sharding, toxicity

# mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > most * sizes[s]}
        if not over:
            return {**out, **{s: rest * weight[s] / total for s in free}}
        for s in over:
            out[s] = most * sizes[s]
        rest, free = rest - sum(most * sizes[s] for s in over), free - over
    return out


def test_targets_are_reshared(spark):
    pick = random.Random(1)
    for case in range(4):
        sizes = {f"s{i}": pick.choice([0, 1, 10, 1000, 100_000]) * pick.randint(1, 9) for i in range(9)} | {None: 50}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: pytest.approx(r.target) for r in got} == plain_targets(sizes), case


def test_permutation_and_inverse():
    for n in (1, 2, 3, 17, 64, 1000):
        at = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(at) == list(range(n)) and all(mixing.inverse(int(v), n, 99) == i for i, v in enumerate(at))


@pytest.mark.parametrize("block", [1024, 7])
def test_mix_of_odd_rows(spark, odd, none, block):
    rows = mixing.taken_words(odd, block=block).collect()
    assert len(rows) == len(ODD)
    sizes = Counter()
    for r in ODD:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    goals, taken = plain_targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goals[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == round(goals[s]) for s in goals)
    again = mixing.taken_words(odd.repartition(3), block=block).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.taken_words(none).collect() == []


def test_mixed_texts_hold_the_words(odd, none):
    mixed = mixing.mixed_documents(odd, block=7)
    assert mixed.columns == odd.columns
    words, whole = Counter(), {(r[0], r[1]) for r in ODD}
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and any(i == r.doc_id for i, _ in whole)
    taken = Counter()
    for r in mixing.taken_words(odd, block=7).collect():
        taken[r.source] += r.taken
    assert words == +taken
    assert mixing.mixed_documents(none).collect() == []


def test_cut_keeps_white_space():
    text = " a  b\nc d "
    assert mixing.cut(text, [(0, 4)], 4) == text and mixing.cut(text, [(1, 3)], 4) == "b\nc"
    assert mixing.cut(text, [(0, 1), (1, 2), (3, 4)], 4) == "a  b d"


# shards


def test_shards_of_odd_rows(odd, none):
    rows = sharding.interleave(odd, shards=4).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ODD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert sharding.interleave(none).collect() == []
    # fewer rows than shards: some shards stay empty
    assert sorted(r.slot for r in sharding.interleave(odd.limit(3), shards=40).collect()) == [0, 0, 0]


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, "t", "en", "abc"[0 if i % 6 < 3 else 1 if i % 6 < 5 else 2], 1, *[None] * 5) for i in range(1200)]
    counts = Counter((r.shard, r.source) for r in sharding.interleave(frame(spark, rows), shards=10).collect())
    for shard in range(10):
        assert all(abs(counts[shard, s] - n) <= 1 for s, n in (("a", 60), ("b", 40), ("c", 20)))


def test_written_shards(spark, odd, tmp_path):
    docs = odd.where("doc_id is not null and doc_id <> 2")
    sharding.write_shards(docs, sharding.interleave(docs, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.groupBy("_shard").agg((F.max("_slot") + 1).alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0


# personal data


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card":
                total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    pick = random.Random(3)
    parts = ["a", "b.", "@", ".", "-", "_", "%", "é", "1", "25", "255", "256", "+", "(", ")", " ", "4111111111111111", "  ", "\n", "0", "+1 (555) 555-0100"]
    for _ in range(30_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_take_linear_time():
    for part in ("a.", "1", "1.", "1 ", "a@", "+1", "+1(", "A1"):
        pii.all_spans(part * 200_000, pii.Supervision(0.5, (0.8,) * 6, (1.0,) * 11))


def test_personal_data_of_odd_rows(odd, none):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == len(ODD)
    texts = {r[0]: r[1] or "" for r in ODD if r[0] is not None}
    for r in rows:
        if r.doc_id is None:
            continue
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(r.spans.split(","))
    nine = next(r for r in rows if r.doc_id == 9)
    assert (nine.n_email, nine.n_ip, nine.n_card, nine.n_phone) == (1, 1, 1, 1)
    assert pii.personal_data(none).collect() == []


def test_votes_find_secrets_and_names(spark):
    pick = random.Random(4)
    rows = []
    for i in range(300):
        key = "".join(pick.choices("0123456789abcdef", k=32))
        rows.append((i, f"some words token = {key} and contact Maria Kowalski today about the Apache License terms or part-12-of-34-more", *[None] * 8))
    docs = frame(spark, rows)
    model = pii.supervise(docs)
    text = rows[0][1]
    found = {text[s:e] for s, _, e in pii.all_spans(text, model)[1]}
    assert text.split()[4] in found and "Maria Kowalski" in found and "Apache License" not in found
    assert all(0.5 < r < 1 for r in model.right)


# toxicity


def labelled(n, bad="vile"):
    pick = random.Random(5)
    plain = ["tree", "house", "river", "stone", "cloud", "field", "light", "road"]
    rows, labels = [], []
    for i in range(n):
        words = pick.choices(plain, k=12)
        toxic = i % 5 == 0
        if toxic:
            words[3] = bad
        # mentions of one group come mostly with toxic texts: the fit must not blame the group
        if toxic and i % 2 or i % 37 == 1:
            words[5] = "muslims"
        elif i % 11 == 2:
            words[5] = "christians"
        rows.append((i, " ".join(words), "en", "s", 1, *[None] * 5))
        labels.append((i, 1 if toxic else 0))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(1200)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    got = toxicity.scored(docs, marks).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_counterfactual_penalty_clears_neutral_mentions(spark):
    rows, labels = labelled(1200)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    with_it, without = (toxicity.fit(docs, marks, penalty=p) for p in (4.0, 0.0))
    text, swapped = "tree house river muslims stone", "tree house river christians stone"
    gap = lambda m: abs(m.score(text) - m.score(swapped))
    assert gap(with_it) < 0.5 * gap(without) and with_it.score(text) < 0.3
    assert with_it.score("tree vile river muslims stone") > 0.3


def test_labels_of_held_out_rows_are_never_used(spark):
    rows, labels = labelled(400)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    docs = frame(spark, rows)
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped)]
    assert models[0] == models[1]


def test_toxicity_of_odd_rows(spark, odd, none):
    marks = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, None, "x"), (None, 1, "x"), (6, 0, "x"), (99, 1, "x"), (8, 0, "x")], "doc_id long, toxic int, text string")
    rows = toxicity.scored(odd, marks).collect()
    assert len(rows) == len(ODD) and all(r.score is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.scored(none, marks).collect() == []
    nothing = toxicity.scored(odd, marks.limit(0)).collect()
    assert all(r.score < 0.01 and r.predicted == 0 for r in nothing)


# tokens


@pytest.fixture(scope="module")
def ranks():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN


def test_tokens_of_odd_rows(spark, odd, none, ranks):
    enc = bpe.encoder(bpe.read_ranks(ranks[0]), ranks[1])
    rows = odd.select("doc_id", "text", bpe.round_trip(F.col("text"), spark, *ranks, keep_ids=True).alias("r"), bpe.encode(F.col("text"), spark, *ranks).alias("ids"))
    rows = rows.withColumn("raw", bpe.decode(F.col("ids"), spark, *ranks)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = enc.encode_ordinary(r.text or "")
        assert r.r.token_ids == want == r.ids and r.r.n_tokens == len(want)
        assert bytes(r.raw) == (r.text or "").encode()
        assert r.r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert none.select(bpe.round_trip(F.col("text"), spark, *ranks)).collect() == []
    assert spark.createDataFrame([(None,)], "ids array<int>").select(bpe.decode(F.col("ids"), spark, *ranks)).first()[0] is None


def test_cuts_never_change_the_ids(ranks):
    enc = bpe.encoder(bpe.read_ranks(ranks[0]), ranks[1])
    pick = random.Random(6)
    parts = ["a", "Bc", "'s", "'ll", " ", "  ", "\n", "\t", "12", "é", "😀", "!", "?!", "\x1c", " ", "　", "̀", "_"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 80)))
        cut = list(bpe.pieces(text, 5))
        assert "".join(cut) == text and [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert len(list(bpe.pieces(LONG))) > 5 and max(map(len, bpe.pieces(LONG))) < bpe.PIECE + 100


# chat


def test_rotation_of_odd_dialogues(spark):
    rows = [
        (1, 0, "system", "Be kind.", 0), (1, 1, "ann", "Hi 😀", 0), (1, 2, "bob", None, 0), (1, 3, "ann", "", 0), (1, 3, "bob", "same turn", 0),
        (1, 3, "bob", "same turn", 0), (1, None, "cleo", "late", 0), (1, 700, None, "who?", 0), (2, 0, "system", "alone", 0),
        (None, 5, "ann", "no dialogue id", 0), (None, -3, "bob", "first", 0), (3, 0, "ann", LONG, 0),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, stretch int")
    got = {}
    for r in chat.rotate(messages).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cleo"), (1, None), (None, "ann"), (None, "bob"), (3, "ann")}
    for (conv, me), found in got.items():
        found.sort(key=lambda r: r.position)
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        assert [r.position for r in found] == list(range(len(mine)))
        whole = ""
        for r, (_, turn, who, text, _) in zip(found, mine):
            role = "system" if who == "system" else "assistant" if who == me else "user"
            name = f" name={who}" if role == "user" and who is not None else ""
            assert r.start == len(whole) and r.turn == turn and r.role == role
            whole += f"<|im_start|>{role}{name}\n{text or ''}<|im_end|>\n"
            assert whole[r.start :] == r.segment
            if role == "assistant":
                assert whole[r.mask_start : r.mask_end] == f"{text or ''}<|im_end|>"
            else:
                assert r.mask_start is None and r.mask_end is None
    assert chat.rotate(messages.limit(0)).collect() == []


def test_long_dialogue_goes_on_over_stretches(spark):
    n = 3 * chat.STRETCH + 5
    messages = spark.createDataFrame([(1, t, "ab"[t % 2], f"t{t}") for t in range(n)], "conv_id long, turn long, role string, text string")
    rows = chat.rotate(messages.repartition(5)).where("perspective = 'a'").orderBy("position").collect()
    ends = [r.start + len(r.segment) for r in rows]
    assert len(rows) == n and [r.turn for r in rows] == list(range(n)) and [r.start for r in rows] == [0, *ends[:-1]]
