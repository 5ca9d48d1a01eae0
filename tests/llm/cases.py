"""Rows that every operator must get through, and plain forms of what the operators compute."""

import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, row string, part int, fp string, _id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))


def _row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), "h", "r", 1, "f", 2)


#: Nulls in every column, empty and white texts, copies, repeated rows, one very long text, extra columns.
ODD = [
    _row(1, "The quick brown fox jumps over the lazy dog and runs home."),
    _row(2, "The quick brown fox jumps over the lazy dog and runs home.", "b"),
    _row(2, "The quick brown fox jumps over the lazy dog and runs home.", "b"),
    _row(3, None, None, None),
    _row(4, ""),
    _row(5, " \t\n "),
    _row(6, "one"),
    _row(7, "Two words", None),
    _row(None, "no id here at all, only text", "c"),
    _row(None, None, None, None),
    _row(8, LONG, "long"),
    _row(9, "Mail a.b@c.de or +1 (555) 555-0100, card 4111 1111 1111 1111, host 10.0.0.255.\nSecond line\nThird", "c"),
    _row(10, "Äpfel und Öl 😀😀 – ñandú next", "d"),
    (11, "all null but text", None, None, None, None, None, None, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def simhash(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(values, budget):
    """By index, the least index reachable over values within ``budget`` bits."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def winnowed(text, base, gram=16, window=32):
    """(hash, position) pairs by the definition, one window after the other."""
    if not text:
        return []
    gram = min(gram, len(text))
    hashes = []
    for i in range(len(text) - gram + 1):
        h = 0
        for c in text[i : i + gram]:
            h = (h * base + ord(c) + 1) % (1 << 64)
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 % (1 << 64)
        hashes.append((h ^ h >> 29) >> 20)
    window, out = min(window, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        place = max(range(i, i + window), key=lambda x: (-hashes[x], x))
        if not out or out[-1][1] != place:
            out.append((hashes[place], place))
    return out
