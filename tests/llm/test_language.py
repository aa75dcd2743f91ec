"""Language identification against a plain naive Bayes, with more languages than one pass takes."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from redwatch.llm import language_id
from redwatch.llm.words import mix


def plain_grams(text):
    """Buckets of all 1- to 3-grams, letters in lower case and all else a space."""
    codes = [language_id._fold(ord(c)) for c in text]
    out = []
    for n in language_id.ORDERS:
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i : i + n]:
                h = (h * 0x110000 + c) % 2**64
            out.append(int(mix(np.array([h], np.uint64))[0]) % language_id.BUCKETS)
    return out


def plain_bayes(rows):
    """(language, posterior, n-grams, mean log-probability) per row, learned from the rows that are not held out."""
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    learned = [r for r, h in zip(rows, held, strict=True) if not h and None not in r]
    languages = sorted({r[2] for r in learned})
    counts = {x: Counter() for x in languages}
    for _, text, lang in learned:
        counts[lang].update(plain_grams(text))
    size = Counter(r[2] for r in learned)
    out = []
    for _, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            out.append((language_id.UNDETERMINED, 0.0, None, 0.0))
            continue
        found, logs = plain_grams(text), {}
        for x in languages:
            whole = counts[x].total() + 0.5 * language_id.BUCKETS
            logs[x] = sum(math.log((counts[x][b] + 0.5) / whole) for b in found)
        prior = {x: math.log(size[x] / len(learned)) for x in languages}
        best = max(languages, key=lambda x: logs[x] + prior[x])  # ties: the first name
        share = 1 / sum(math.exp(logs[x] + prior[x] - logs[best] - prior[best]) for x in languages)
        out.append((best, share, len(found), logs[best] / len(found)))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    alphabets = {f"l{i}": [rnd.choice("abcdefghijklmnopqrstuvwxyzäöüßéñçабвгд") for _ in range(7)] for i in range(11)}
    out = []
    for i in range(160):
        lang = f"l{min(int(rnd.expovariate(0.3)), 10)}"
        words = ["".join(rnd.choice(alphabets[lang]) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.choice([1, 2, 9]))]
        out.append((i, rnd.choice([str.upper, str.lower])(rnd.choice([" ", ", ", "1"]).join(words)), rnd.choice([lang, lang, None])))
    return [*out, (200, None, "l1"), (201, "", "l1"), (202, "12 !", None), (None, "abc", "l2"), (5, "def", "l3"), (5, "def", "l3")]


@pytest.mark.parametrize("block", [4, 256])
def test_scores_equal_a_plain_naive_bayes(spark, rows, block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", block)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    assert len(model.languages) > 2 * 4  # three blocks of four
    got = {r["place"]: r for r in language_id.predict(docs, model, keep=("place",), detail=True).collect()}
    assert len(got) == len(rows)
    for i, (lang, share, n, mean) in enumerate(plain_bayes(rows)):
        assert got[i]["lang_pred"] == lang, rows[i]
        assert got[i]["score"] == pytest.approx(share, abs=1e-4) and got[i]["gram_log_prob"] == pytest.approx(mean, abs=1e-5)
        assert n is None or got[i]["n_grams"] == n


def test_three_hundred_languages(spark):
    docs = spark.createDataFrame([(i, f"{chr(0x4E00 + i % 300) * 4} {chr(0x4E00 + i % 300)}", f"x{i % 300:03d}") for i in range(1800)], "doc_id long, text string, lang string")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == 1800 and got.where("lang_pred = lang").count() >= 1750
    judged = language_id.predict(docs, language_id.fit(docs), keep=("doc_id", "lang"), detail=True)
    model = language_id.fit(docs)
    usual = language_id.typical(judged, F.col("lang"))
    assert len(usual) >= 290 and judged.where(language_id.misfit(model, usual)).isEmpty()
