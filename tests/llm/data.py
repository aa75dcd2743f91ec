"""Small inputs with every awkward case, and brute-force forms of the operators."""

import re
from collections import Counter
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that users may have and that the operators use inside.
CLASHING = "keep string, row string, rest string, print long, rank long, key string, n long, node long, component long, hits string, copy boolean, score double, lang_pred string, part int, shard int, text_crc32 long"

_rng = np.random.default_rng(5)
_vocabulary = ["".join(chr(97 + c) for c in _rng.integers(0, 26, _rng.integers(2, 9))) for _ in range(3000)]


def prose(n, seed, lines=12):
    rng = np.random.default_rng(seed)
    words = [_vocabulary[i] for i in rng.integers(0, len(_vocabulary), n)]
    return "".join(w.capitalize() + ("\n" if i % lines == lines - 1 else " ") for i, w in enumerate(words))


def texts():
    long = prose(30_000, 1)
    base = prose(120, 2)
    words = base.split(" ")
    near = " ".join(words[:40] + ["changed"] + words[41:])
    far = " ".join(w if i % 6 else "other" + w for i, w in enumerate(words))
    passage = prose(60, 3).replace("\n", " ")
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (6, long), (7, base), (8, base), (9, near), (10, far),
        (11, prose(80, 4) + passage), (12, prose(90, 5) + passage + prose(30, 6)), (13, "12 345 - !!"), (14, "Été à l'école — ünïcödé 中文 ﬁ <|endoftext|>"),
        (15, "x y"), (16, "x y"), (17, "spam " * 60), (18, "#$% " * 40 + base), (19, base + "\n\n" + base), (None, base), (None, "alone without id"),
        (20, prose(40, 7)), (20, prose(40, 7)), (21, "A B c"), (22, "a b C"), (23, "one\ntwo\none\ntwo\none\ntwo\nthree and more text here\n"),
    ]


def documents(spark, rows=None, clash=True):
    """Rows (doc_id, text) as documents, with extra columns whose names clash with internal ones."""
    rows = texts() if rows is None else rows
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, ("en", "de", None)[k % 3], "src", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        for field in CLASHING.split(", "):
            name, kind = field.split(" ")
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def words(text):
    return WORD.findall(text or "")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_links(sets, percent):
    return [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def repeats_removed(rows, length):
    """(words, removed, what is left) per row: windows of earlier documents."""
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[p : p + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def repeated_window_words(text, window):
    w = words(text)
    seen = Counter(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    gone = [False] * len(w)
    for i in range(len(w) - window + 1):
        if seen[tuple(w[i : i + window])] > 1:
            gone[i : i + window] = [True] * window
    return sum(gone)


def lines_left(rows, min_chars):
    """(lines, deleted, what is left) per (id, text): windows of 1, 2, 4 ... lines that start earlier go."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    split = [(d, t.split("\n")) for d, t in docs]
    gone = [set() for _ in split]
    length = 1
    while any(len(x) >= length for _, x in split):
        seen = set()
        for k, (_, x) in enumerate(split):
            for p in range(len(x) - length + 1):
                window = tuple(x[p : p + length])
                if window in seen and sum(map(len, window)) >= min_chars:
                    gone[k].update(range(p, p + length))
                seen.add(window)
        length *= 2
    return {d: (len(x), len(g), "\n".join(y for n, y in enumerate(x) if n not in g)) for d, (_, x), g in zip(docs, split, gone, strict=True)}
