import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from data import documents, prose, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redwatch.llm import importance_resampling as resampling
from redwatch.llm.span_crc import DEPTH, crc32

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@given(st.binary(min_size=1, max_size=900), st.lists(st.tuples(st.integers(0, 900), st.integers(0, 900)), max_size=30))
@settings(max_examples=100, deadline=None)
def test_crc_of_spans(data, spans):
    spans = [sorted((a % (len(data) + 1), b % (len(data) + 1))) for a, b in spans]
    table = np.array(spans, np.int64).reshape(-1, 2)
    assert crc32(np.frombuffer(data, np.uint8), table[:, 0], table[:, 1]).tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


@pytest.mark.parametrize("n", [1, DEPTH - 1, DEPTH, DEPTH + 1, 5 * DEPTH, 100_003])
def test_crc_of_long_spans(n):
    data = np.random.default_rng(n).integers(0, 256, n + 10).astype(np.uint8)
    assert crc32(data, np.array([3, 0]), np.array([3 + n, 2])).tolist() == [zlib.crc32(data[3 : 3 + n].tobytes()), zlib.crc32(data[:2].tobytes())]


def grams(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB9é中 .-\n\x7f`"), max_size=60)), max_size=6), st.sampled_from([8, 64, 1 << 18]))
@settings(max_examples=100, deadline=None)
def test_features(rows, size):
    found, words = [Counter() for _ in rows], [0] * len(rows)
    for low, n, n_words, row, value in resampling.features(pa.array(rows, pa.string()), size=size):
        for r, v in zip(row.tolist(), value.tolist(), strict=True):
            found[low + r][v] += 1
        for r in range(n):
            words[low + r] += int(n_words[r])
    assert words == [len(grams(t)[0]) for t in rows]
    assert found == [Counter(zlib.crc32(g.encode()) for g in grams(t)[1]) for t in rows]


def brute_force(docs, target, percent=5, min_words=20):
    """(doc_id, n_features, weight, score, rank) per (doc_id, text)."""
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = (Counter(bucket(g) for text in side for g in grams(text)[1]) for side in ([x for _, x in docs], target))
    every, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (every + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in range(10_000)]
    rows, able = [], []
    for k, (i, text) in enumerate(docs):
        w, own = grams(text)
        weight, score = sum(gain[bucket(g)] for g in own), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(w) >= min_words:
                able.append((-score, i, k))
        rows.append([i, len(own), weight, score, None])
    for place, (_, _, k) in enumerate(sorted(able)[: percent * len(able) // 100]):
        rows[k][4] = place + 1
    return [tuple(r) for r in rows]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("percent", [5, 60])
def test_resampling_of_awkward_documents(spark, percent):
    rows = texts() + [(100 + i, prose(25 + i % 40, i % 30)) for i in range(80)]
    target = [t for _, t in texts()[5:14]] + [None]
    df = documents(spark, rows).withColumn("weight", F.lit("x")).withColumn("rank", F.lit(1)).repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent).collect()
    assert in_order((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == in_order(brute_force(rows, target, percent))


def test_resampling_of_a_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs, target = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    got = resampling.resample(docs, target).collect()
    assert in_order((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == in_order(want) and any(r.rank for r in got)


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(documents(spark, []), empty).count() == 0
    assert resampling.resample(documents(spark), empty).count() == len(texts())
