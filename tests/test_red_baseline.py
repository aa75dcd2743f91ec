import math
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from redwatch.config import LATENCY_BOUNDS_MS, PRODUCTION
from redwatch.operators import baseline, evaluation, features, red
from redwatch.operators.model_ops import scored_history
from redwatch.plans.fixture import SETTINGS, Telemetry

SPAN = "endpoint_id string, service string, service_tier string, span_kind string, ts timestamp, status_code int, latency_ms double"


def spans(spark, minute, rows):
    data = [("GET /a", "s", "service", "SPAN_KIND_SERVER", minute(m), code, lat) for m, code, lat in rows]
    return spark.createDataFrame(data, SPAN)


def test_histogram_quantile_rules(spark):
    rows = [("a", 2.0, 5), ("a", 4.0, 10), ("a", float("inf"), 10), ("open", 2.0, 0), ("open", 4.0, 1), ("open", float("inf"), 10), ("none", 2.0, 0), ("none", float("inf"), 0)]
    df = spark.createDataFrame(rows, "g string, le double, n bigint")
    got = {r["g"]: r["value"] for r in red.histogram_quantile(df, 0.5, ["g"]).collect()}
    assert got["a"] == pytest.approx(2.0) and got["open"] == 4.0 and math.isnan(got["none"])
    high = {r["g"]: r["value"] for r in red.histogram_quantile(df, 0.75, ["g"]).collect()}
    assert high["a"] == pytest.approx(3.0)


def test_wide_and_long_histograms_agree(spark, minute):
    rng = np.random.default_rng(2)
    s = spans(spark, minute, [(int(i % 7), 200, float(x)) for i, x in enumerate(rng.lognormal(4, 1.6, 900))])
    wide = {r["time"]: r["p95_ms"] for r in red.red_features(s).collect()}
    long = red.histogram_quantile(red.sum_by_le(red.span_histogram(s, 60)), 0.95, ["time"], "p95")
    assert wide == pytest.approx({r["time"]: r["p95"] for r in long.collect()})


def test_features_of_one_cycle(spark, minute):
    rows = [(0, 500, 3.0)] + [(0, 404, 3.0)] * 2 + [(0, 200, 20000.0)] * 7
    r = red.red_features(spans(spark, minute, rows)).first()
    assert (r["error_rate_5xx"], r["error_rate_4xx"], r["rps"]) == (10.0, 20.0, 10 / 60)
    assert r["p99_ms"] == LATENCY_BOUNDS_MS[-1]
    client = spans(spark, minute, rows).withColumn("span_kind", F.lit("SPAN_KIND_CLIENT"))
    assert red.red_features(client).count() == 0


def test_exact_features_match_numpy_on_a_hot_cycle(spark, minute):
    rng = np.random.default_rng(4)
    values = {0: rng.lognormal(4, 1, 2000).tolist(), 1: [5.0], 2: rng.uniform(0, 1, 50).tolist()}
    s = spans(spark, minute, [(m, 200, float(v)) for m, vs in values.items() for v in vs])
    for r in red.red_features_exact(s).collect():
        vs = values[r["time"].minute]
        assert [r["p50_ms"], r["p95_ms"], r["p99_ms"]] == pytest.approx(list(np.percentile(vs, [50, 95, 99])))


def test_counter_restart_counts_from_zero(spark, minute):
    values = [10, 15, 3, 4, 4, 9]
    df = spark.createDataFrame([("s", minute(i), float(v)) for i, v in enumerate(values)], "k string, ts timestamp, value double")
    for chunk in (60, 120, 3600):
        got = [r["increase"] for r in red.counter_increase(df, ["k"], chunk).orderBy("ts").collect()]
        assert got == [None, 5.0, 3.0, 1.0, 0.0, 5.0]
    assert red.counter_rate(df, ["k"], 300).orderBy("time").first()["rate"] == pytest.approx(9 / 300)


def test_sliding_windows_equal_direct_windows(spark, minute):
    rng = np.random.default_rng(5)
    s = spans(spark, minute, [(int(m), int(c), float(v)) for m, c, v in zip(rng.integers(0, 30, 400), rng.choice([200, 404, 500], 400), rng.lognormal(3, 1, 400))])
    got = {r["time"]: (r["span_count"], r["p95_ms"], r["error_rate_5xx"]) for r in red.sliding_red_features(s, 300, 60).collect()}
    direct = s.groupBy(F.window("ts", "300 seconds", "60 seconds").alias("w")).agg(*red.red_aggs(300)).select(F.col("w.start").alias("time"), *red.red_projection(), "calls")
    want = {r["time"]: (r["calls"], r["p95_ms"], r["error_rate_5xx"]) for r in direct.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_drop_incomplete_keeps_a_lonely_row(spark, minute):
    df = spark.createDataFrame([("a", minute(0)), ("a", minute(1)), ("b", minute(0))], "endpoint_id string, time timestamp")
    got = {(r["endpoint_id"], r["time"].minute) for r in red.drop_incomplete(df).collect()}
    assert got == {("a", 0), ("b", 0)}


def test_cap_keeps_every_span(spark):
    df = spark.createDataFrame([(f"e{i % 9}",) for i in range(90)] + [("e1",)] * 50, "endpoint_id string")
    got = {r["endpoint_id"]: r["n"] for r in red.cap_endpoints(df, 2).groupBy("endpoint_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"e1": 60, "e0": 10, "other": 70}


def test_expire_idle_series(spark, minute):
    df = spark.createDataFrame([("old", minute(0)), ("new", minute(0)), ("new", minute(9))], "k string, time timestamp")
    kept = red.expire_idle_series(df, ["k"], F.lit(minute(10)), 300).select("k").distinct().collect()
    assert [r["k"] for r in kept] == ["new"]


FEATURE = "time timestamp, endpoint_id string, service string, rps double, p50_ms double, p95_ms double, p99_ms double, error_rate_5xx double, error_rate_4xx double"
INJ = "scenario_id string, fault_type string, target_service string, target_endpoint string, injected_at timestamp, cleared_at timestamp, source_file string"


def test_baseline_excludes_faults_and_thin_buckets(spark):
    monday = datetime(2024, 1, 1, 5)
    rows = [(monday + timedelta(days=7 * w, minutes=m), "e", "s", 1.0, 1.0, 1.0, 100.0 + m, 0.0, 0.0) for w in (0, 1) for m in range(10)]
    rows += [(monday + timedelta(minutes=20), "e", "s", 1.0, 1.0, 1.0, 9e9, 0.0, 0.0), (monday + timedelta(hours=2), "e", "s", 1.0, 1.0, 1.0, 5.0, 0.0, 0.0)]
    rows += [(monday + timedelta(minutes=30), "e", "s", 1.0, 1.0, 1.0, float("nan"), None, 0.0)]
    f = spark.createDataFrame(rows, FEATURE)
    inj = spark.createDataFrame([("x", "y", "s", "e", monday + timedelta(minutes=16), monday + timedelta(minutes=17), "f")], INJ)
    b = baseline.seasonal_baseline(f, inj, F.lit(datetime(2024, 1, 14)), PRODUCTION)
    got = {r["metric"]: r for r in b.collect()}
    assert {(r["dow"], r["hour_bucket"]) for r in got.values()} == {(1, 5)}
    # minute 20 is inside the five minute margin of the fault
    assert got["p99_ms"]["sample_count"] == 20 and got["p99_ms"]["p50"] == pytest.approx(104.5)
    assert got["rps"]["sample_count"] == 21


def test_lookup_levels(spark):
    t = datetime(2024, 1, 1, 5)
    base = spark.createDataFrame([("e", "p99_ms", 1, 5, None, 2.0, 3.0, 9), ("e", "p99_ms", 2, 5, 0.5, 4.0, 8.0, 9)], "endpoint_id string, metric string, dow int, hour_bucket int, p10 double, p50 double, p90 double, sample_count bigint")
    rows = spark.createDataFrame([("e", t), ("e", t + timedelta(hours=1)), ("new", t)], "endpoint_id string, time timestamp")
    glob = spark.createDataFrame([("p99_ms", 1.0, 5.0, 9.0)], "metric string, p10 double, p50 double, p90 double")
    out = baseline.with_baseline(rows, base, ("p99_ms",), global_baseline=glob)
    got = {(r["endpoint_id"], r["time"].hour): tuple(r["b_p99_ms"]) for r in out.collect()}
    # the exact bucket wins although its p10 is null
    assert got == {("e", 5): (None, 2.0, 3.0), ("e", 6): (0.5, 3.0, 8.0), ("new", 5): (1.0, 5.0, 9.0)}
    plain = baseline.with_baseline(rows, base, ("p99_ms",)).where("endpoint_id = 'new'").first()
    assert plain["b_p99_ms"] is None


def test_derived_features_of_a_window(spark, minute):
    rows = [(minute(i), "e", 10.0 + i, 100.0, 150.0, 200.0 + 10 * i, 1.0) for i in range(12)]
    f = spark.createDataFrame(rows, "time timestamp, endpoint_id string, rps double, p50_ms double, p95_ms double, p99_ms double, error_rate_5xx double")
    band = lambda a, b, c: F.struct(F.lit(a).alias("p10"), F.lit(b).alias("p50"), F.lit(c).alias("p90"))
    f = f.withColumns({"b_p99_ms": band(90.0, 130.0, 180.0), "b_p50_ms": band(90.0, 95.0, 99.0), "b_p95_ms": F.lit(None).cast("struct<p10:double,p50:double,p90:double>"), "b_rps": band(1.0, 5.0, 9.0)})
    r = features.derived_features(f).orderBy(F.desc("time")).first()
    assert r["window_rows"] == 10 and r["baseline_dev_p95"] == 0.0
    assert r["baseline_dev_p99"] == pytest.approx((310 - 180) / 90) and r["baseline_dev_p50"] == pytest.approx(1 / 9)
    assert r["latency_slope"] == pytest.approx(10 / 130) and r["p99_over_p50"] == pytest.approx(3.1) and r["rps_delta"] == pytest.approx(0.2)


@pytest.fixture(scope="module")
def exact(spark):
    t = Telemetry(spark, "/root/testdata/sf0.01")
    f = red.red_features_exact(t.spans, SETTINGS)
    f.cache()
    return t, f


def test_anchors_of_the_exact_features(exact):
    _, f = exact
    a = f.agg(F.count("*"), F.avg("p99_ms"), F.avg((F.col("p99_ms") > 300).cast("int")), F.avg("error_rate_5xx"), F.avg((F.col("error_rate_5xx") > 5).cast("int"))).first()
    assert a[0] == 720
    assert list(a)[1:] == pytest.approx([304.1352841666, 0.46388, 5.89625, 0.51527], abs=1e-5)


def test_anchors_of_the_static_replay(exact):
    t, f = exact
    none = t.injections.limit(0)
    b = baseline.seasonal_baseline(f, none, t.as_of, SETTINGS)
    s = scored_history(f, b, t.slos, None, SETTINGS, complete_only=False)
    counts = {r["direction"]: r["n"] for r in s.groupBy("direction").agg(F.count("*").alias("n")).collect()}
    assert counts == {"normal": 384, "improvement": 168, "degradation": 168}
    onsets = evaluation.replay_onsets(s, replace(SETTINGS, offline_fire_after=2)).where("detector = 'static'")
    assert onsets.count() == 95
    found = evaluation.detections(onsets, t.injections, SETTINGS)
    stats = {r["fault_type"]: (r["tp_static"], r["n"], r["delay_static_s"]) for r in evaluation.detection_stats(found).where("level = 'type'").collect()}
    assert stats == {"latency_step": (3, 3, 43200.0), "error_burst": (2, 2, 140400.0), "downstream_slow": (1, 1, 43200.0), "pool_shrink": (0, 1, None)}
    assert evaluation.onsets_outside(onsets, t.injections, SETTINGS).count() == 59
