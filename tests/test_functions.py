import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redwatch.functions import arrays, ordered, scalars
from redwatch.operators.joins import asof_latest, interval_join

NAN, INF = float("nan"), float("inf")


def one(spark, schema, row, *exprs):
    df = spark.createDataFrame([row], schema)
    return tuple(df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first())


@pytest.mark.parametrize("series, slope", [
    ([1.0, 2.0, 3.0, 4.0, 5.0], 1.0),
    ([5.0] * 6, 0.0),
    ([10.0, 8.0, 6.0, 4.0], -2.0),
    ([1.0, 2.0, 3.0, 100.0, 5.0], 1.0),
    ([1.0, 2.0], 0.0),
    ([], 0.0),
])
def test_theil_sen(spark, series, slope):
    df = spark.createDataFrame([(series,)], "y array<double>").withColumn("s", arrays.pairwise_slopes("y"))
    got = df.select(arrays.theil_sen("s", "y", 3).alias("v")).first()["v"]
    assert got == pytest.approx(slope)


def test_sorted_percentile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(sorted(rng.normal(size=n).tolist()),) for n in range(1, 12)]
    df = spark.createDataFrame(rows, "a array<double>")
    got = df.select("a", *[arrays.sorted_percentile("a", q).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]).collect()
    for r in got:
        assert [r["q25"], r["q50"], r["q75"]] == pytest.approx(list(np.percentile(r["a"], [25, 50, 75])))


@pytest.mark.parametrize("value, low, high, want", [
    (400.0, 90.0, 180.0, 220 / 90), (50.0, 90.0, 180.0, -40 / 90), (100.0, 90.0, 180.0, 0.0),
    (400.0, 100.0, 100.0, 0.0), (None, 90.0, 180.0, 0.0), (400.0, None, 180.0, 0.0), (400.0, NAN, 180.0, 0.0),
    (INF, 90.0, 180.0, 0.0),
])
def test_signed_deviation(spark, value, low, high, want):
    got = one(spark, "v double, a double, b double", (value, low, high), scalars.signed_deviation("v", "a", "b"))
    assert got[0] == pytest.approx(want)


def test_one_sided_deviation(spark):
    f = lambda *row: one(spark, "v double, a double, b double", row, scalars.one_sided_deviation("v", "a", "b"))[0]
    assert f(400.0, 90.0, 180.0) == pytest.approx(220 / (90 + 1e-6))
    assert f(180.0, 90.0, 180.0) == 0.0
    assert f(400.0, None, 180.0) == 0.0


def test_direction(spark):
    f = lambda *row: one(spark, "v double, a double, b double", row, scalars.direction_of("v", "a", "b"))[0]
    assert [f(200.0, 90.0, 180.0), f(50.0, 90.0, 180.0), f(100.0, 90.0, 180.0)] == ["degradation", "improvement", "normal"]
    assert f(None, 90.0, 180.0) == f(NAN, 90.0, 180.0) == f(200.0, None, None) == "normal"


def test_day_of_week_starts_on_sunday(spark):
    df = spark.sql("SELECT timestamp'2024-01-01' AS mon, timestamp'2024-01-07' AS sun, timestamp'2024-01-06' AS sat")
    assert tuple(df.select(*[scalars.day_of_week(c) for c in df.columns]).first()) == (1, 0, 6)


def test_half_even_follows_the_binary_value(spark):
    values = [0.125, 0.575, 2.5, -0.375, 1.005, 596.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(scalars.half_even("v", 2)).collect()] == [round(v, 2) for v in values]


def test_endpoint_match(spark):
    f = lambda *row: one(spark, "t string, s string, e string", row, scalars.endpoint_match("t", "s", "e"))[0]
    assert f("GET /orders", "", " get /orders ") and f("/orders", "x", "GET /orders/{order_id}")
    assert f("GET /orders/{order_id}", "x", "GET /orders") and f("", "payments", "POST /payments")
    assert not f("", "", "GET /orders") and not f("POST /payments", "payments", "GET /orders")


@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows in one key, many equal values, all scales."""
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([5.0, rnd.random(), rnd.lognormvariate(3, 2), -rnd.random() * 9])) for _ in range(3000)]
    rows += [(f"k{i % 40}", rnd.lognormvariate(1, 1)) for i in range(1500)] + [("single", 7.0), ("nan", NAN), ("none", None)]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_exact_quantiles_match_numpy(hot):
    rows, df = hot
    got = {r["k"]: r for r in ordered.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    groups = {}
    for k, v in rows:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert [got[k]["a"], got[k]["b"], got[k]["c"]] == pytest.approx(list(np.percentile(vs, [10, 50, 99])))


def test_exact_quantiles_nearest_rank_and_no_key(hot):
    rows, df = hot
    values = sorted(v for _, v in rows if v is not None and v == v)
    got = ordered.exact_quantiles(df, [], "v", {"p": 0.9, "m": 1.0}, nearest_rank=True).first()
    assert got["p"] == values[min(int(len(values) * 0.9), len(values) - 1)] and got["m"] == values[-1]


def test_running_totals_with_ties(hot):
    rows, df = hot
    clean = df.where(F.col("v").isNotNull() & ~F.isnan("v"))
    got = ordered.running_totals(clean, ["k"], "v", {"n": F.lit(1)}, ordered.value_bin("v")).collect()
    for r in random.Random(1).sample(got, 200):
        assert r["n"] == sum(1 for k, v in rows if k == r["k"] and v is not None and v <= r["v"])


@pytest.fixture(scope="module")
def narrow(spark):
    """All values within 1e-6 of each other, neighbours in the last bits, one value very often, both ends open."""
    rnd = random.Random(4)
    values = [0.5 + rnd.random() * 1e-6 for _ in range(3000)] + [0.5 + i * 2.0**-52 for i in range(400)] + [0.5000004] * 900
    values += [INF, -INF, 1.7e308, 1.6e308] + [float(i) for i in range(50)]
    rows = [(rnd.choice("ab"), v) for v in values]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_crowded_bins_are_cut_until_they_fit(narrow):
    rows, df = narrow
    binned = ordered.refined_bins(df, ["k"], F.col("v"), ordered.value_bin("v"), crowd=40)
    bins = {}
    for r in binned.collect():
        bins.setdefault((r["k"], tuple(r["_bin"])), []).append(r["v"])
    assert sum(map(len, bins.values())) == len(rows)
    assert all(len(vs) <= 40 or len(set(vs)) == 1 for vs in bins.values())
    for k in "ab":
        edges = [(min(bins[b]), max(bins[b])) for b in sorted(b for b in bins if b[0] == k)]
        assert all(high < low for (_, high), (low, _) in zip(edges, edges[1:]))


def test_running_totals_and_quantiles_of_crowded_bins(narrow):
    rows, df = narrow
    got = ordered.running_totals(
        df, ["k"], "v", {"n": F.lit(1)}, ordered.value_bin("v"), refine=F.col("v"), crowd=40
    ).collect()
    assert len(got) == len(rows)
    for k in "ab":
        mine = np.sort([v for j, v in rows if j == k])
        assert all(r["n"] == np.searchsorted(mine, r["v"], "right") for r in got if r["k"] == k)
    probs = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.77, "e": 0.98}
    for nearest in (False, True):
        for r in ordered.exact_quantiles(df, ["k"], "v", probs, nearest, crowd=40).collect():
            mine = np.sort([v for j, v in rows if j == r["k"]])
            for name, q in list(probs.items())[0 if nearest else 1 :]:
                want = mine[min(int(len(mine) * q), len(mine) - 1)] if nearest else np.percentile(mine, 100 * q)
                assert r[name] == pytest.approx(want, rel=1e-15), (name, nearest)


def test_value_bin_is_monotone(spark):
    values = sorted([0.0, -0.0, 1e-9, 0.5, 1.0, 3.0, 1e9, -1e-9, -2.0, -1e9, 5e-324])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    bins = [r[0] for r in df.orderBy("i").select(ordered.value_bin("v")).collect()]
    assert bins == sorted(bins)


def test_interval_join_equals_brute_force(spark, minute):
    rnd = random.Random(5)
    points = [(i, "hot" if i % 2 else f"k{i % 5}", minute(rnd.randrange(3000))) for i in range(600)]
    spans = [(j, rnd.choice(["hot", "k0", "k2"]), minute(s), minute(s + rnd.choice([0, 5, 700]))) for j, s in enumerate(rnd.randrange(3000) for _ in range(60))]
    p = spark.createDataFrame(points, "i int, k string, t timestamp")
    s = spark.createDataFrame(spans, "j int, k string, a timestamp, b timestamp")
    want = {(i, j) for i, k, t in points for j, q, a, b in spans if k == q and a <= t <= b}
    got = [tuple(r) for r in interval_join(p, s, "t", "a", "b", ["k"]).select("i", "j").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    anti = {r["i"] for r in interval_join(p, s.drop("j"), "t", "a", "b", ["k"], "left_anti").collect()}
    assert anti == {i for i, _, _ in points} - {i for i, _ in want}
    free = {r["i"] for r in interval_join(p, s.drop("j", "k"), "t", "a", "b", (), "left_semi").collect()}
    assert free == {i for i, _, t in points if any(a <= t <= b for _, _, a, b in spans)}


@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_brute_force(spark, minute, strict):
    rnd = random.Random(6)
    left = [(i, f"k{i % 3}", minute(rnd.randrange(200))) for i in range(120)]
    taken = rnd.sample([(k, m) for k in range(3) for m in range(200)], 150)
    right = [(f"k{k}", minute(m), float(j)) for j, (k, m) in enumerate(taken)]
    l = spark.createDataFrame(left, "i int, k string, t timestamp")
    r = spark.createDataFrame(right, "k string, at timestamp, v double")
    got = {x["i"]: x["v"] for x in asof_latest(l, r, "t", "at", ["k"], 600, ["v"], strict).collect()}
    for i, k, t in left:
        fits = [(at, v) for q, at, v in right if q == k and 0 <= (t - at).total_seconds() <= 600 and not (strict and at == t)]
        assert got[i] == (max(fits)[1] if fits else None)


def test_finite_guards(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (INF,), (-INF,), (None,)], "v double")
    assert [r[0] for r in df.select(scalars.finite_or_null("v")).collect()] == [1.0, None, None, None, None]
    rows = df.select(scalars.safe_ratio(F.lit(1.0), "v")).collect()
    assert [r[0] for r in rows] == [1.0, 0.0, 0.0, 0.0, 0.0] and not any(math.isnan(r[0]) for r in rows)


def test_interval_without_an_end_is_still_going_on(spark, minute):
    p = spark.createDataFrame([(i, minute(i * 90)) for i in range(40)], "i int, t timestamp")
    s = spark.createDataFrame([(0, minute(1000), None), (1, minute(5000), None), (2, minute(0), minute(100))], "j int, a timestamp, b timestamp")
    got = {(r["i"], r["j"]) for r in interval_join(p, s, "t", "a", "b").collect()}
    assert got == {(i, 0) for i in range(12, 40)} | {(0, 2), (1, 2)}
    assert {r["i"] for r in interval_join(p, s, "t", "a", "b", (), "left_anti").collect()} == set(range(2, 12))


@pytest.mark.parametrize("size", [1, 60, 3600, 100_000])
def test_cells_of_an_interval_are_few_disjoint_and_cover_it(spark, size):
    from redwatch.operators.joins import interval_cells

    rnd = random.Random(size)
    spans = [(j, a * size, (a + w) * size) for j, (a, w) in enumerate((rnd.randrange(-5000, 5000), rnd.choice([0, 1, 7, 8, 9, 63, 64, 600, 4000])) for _ in range(80))]
    df = spark.createDataFrame(spans, "j int, a long, b long").select("j", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    found = {}
    for r in interval_cells(df, "a", "b", size).collect():
        found.setdefault(r["j"], []).append((r["_size"], r["_cell"]))
    for j, a, b in spans:
        covered = [k for s, c in found[j] for k in range(c << 3 * s, (c + 1) << 3 * s)]
        assert sorted(covered) == list(range(a // size, b // size + 1))


def test_long_and_open_intervals_have_few_cells(spark):
    from redwatch.operators.joins import interval_cells

    rows = [(0, "2024-01-01 00:00:01", None), (1, "2015-03-04 05:06:07", "2025-02-03 04:05:06"), (2, "1950-01-01 00:00:00", "2040-01-01 00:00:00"), (3, "2024-01-02 00:00:00", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "j int, a string, b string").select("j", F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    for size in (60, 3600):
        counts = {r["j"]: r["count"] for r in interval_cells(df, "a", "b", size).groupBy("j").count().collect()}
        assert set(counts) == {0, 1, 2} and max(counts.values()) < 100


def test_interval_marks_keep_every_point_once(spark):
    from redwatch.operators.joins import interval_marks

    rnd = random.Random(9)
    base = 1_700_000_000
    points = [(i % 90, rnd.choice(["a", "b", None]), base + rnd.randrange(10**8) if i % 17 else None) for i in range(300)]
    spans = [(rnd.choice(["a", "b"]), base + s, base + s + rnd.choice([0, 50, 3 * 10**7]) if rnd.random() < 0.9 else None) for s in (rnd.randrange(10**8) for _ in range(12))]
    p = spark.createDataFrame(points, "i int, k string, t long").withColumn("t", F.timestamp_seconds("t"))
    s = spark.createDataFrame(spans, "k string, a long, b long").select("k", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    got = sorted((r["i"], r["k"] or "", r["inside"]) for r in interval_marks(p, s, "t", "a", "b", ["k"]).collect())
    want = sorted((i, k or "", t is not None and any(q == k and a <= t and (b is None or t <= b) for q, a, b in spans)) for i, k, t in points)
    assert got == want and {x[2] for x in got} == {True, False}
    none = interval_marks(p, s.where("false"), "t", "a", "b", ["k"])
    assert none.count() == 300 and none.where("inside").count() == 0
