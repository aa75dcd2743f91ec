import json
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from redwatch.config import PRODUCTION
from redwatch.operators import evaluation, explain, scoring, selfobs

T0 = datetime(2024, 1, 1)
INJ = "scenario_id string, fault_type string, target_service string, target_endpoint string, injected_at timestamp, cleared_at timestamp, source_file string"
ALERT = "alert_id string, endpoint_id string, opened_at timestamp, suspected_fault string, imputation_score double"


@pytest.fixture(scope="module")
def faults(spark, minute):
    return spark.createDataFrame([
        ("s1", "latency", "o", "A", minute(10), minute(20), "x_core.json"),
        ("s2", "latency", "o", "A", minute(15), minute(30), "x_stress.json"),
        ("s3", "errors", "p", "B", minute(60), minute(70), "y.json"),
        ("bad_deploy", "latency", "o", "C", minute(100), minute(110), "bad.json"),
    ], INJ)


def onset_frame(spark, rows):
    return spark.createDataFrame(rows, "endpoint_id string, detector string, onset timestamp")


def test_detections_grace_and_reuse(spark, minute, faults):
    on = onset_frame(spark, [("A", "static", minute(18)), ("A", "layered", minute(12)), ("B", "layered", minute(71)), ("B", "static", minute(73)), ("C", "static", minute(99))])
    got = {r["source_file"]: (r["delay_static"], r["delay_layered"]) for r in evaluation.detections(on, faults).collect()}
    assert got == {"x_core.json": (480.0, 120.0), "x_stress.json": (180.0, None), "y.json": (None, 660.0), "bad.json": (None, None)}
    out = evaluation.onsets_outside(on, faults)
    assert {(r["endpoint_id"], r["onset"]) for r in out.collect()} == {("B", minute(73)), ("C", minute(99))}
    stats = {(r["level"], r["fault_type"], r["magnitude"]): (r["n"], r["tp_static"], r["dr_layered"]) for r in evaluation.detection_stats(evaluation.detections(on, faults)).collect()}
    assert stats[("overall", "OVERALL", "all")] == (4, 2, 0.5) and stats[("type", "latency", "all")] == (3, 2, pytest.approx(1 / 3))
    assert stats[("magnitude", "latency", "core")] == (1, 1, 1.0) and stats[("magnitude", "errors", "all")][0] == 1
    lead = evaluation.lead_time(evaluation.detections(on, faults)).first()
    assert (lead["lead_time_s"], lead["n"]) == (360.0, 1)


def alerts(spark, minute):
    return spark.createDataFrame([
        ("a1", "A", minute(16), None, 0.0), ("a2", "A", minute(17), None, 0.0), ("a3", "A", minute(25), None, 0.0),
        ("b1", "B", minute(200), "s3:errors:B", 0.95), ("b2", "B", minute(201), "s3:errors:B", 0.5), ("b3", "B", minute(202), "zz", 1.0),
        ("c1", "C", minute(103), "bad_deploy:latency:C", 1.0),
    ], ALERT)


def greedy(windows, rows, grace=timedelta(seconds=120)):
    left, out = list(rows), {}
    for w in sorted(windows, key=lambda w: w["injected_at"]):
        mine = [a for a in left if a["endpoint_id"] == w["target_endpoint"] and w["injected_at"] <= a["opened_at"] <= w["cleared_at"] + grace]
        left = [a for a in left if a not in mine]
        out[w["scenario_id"]] = min((a["opened_at"] for a in mine), default=None)
    return out, {a["alert_id"] for a in left}


def test_matching_equals_a_greedy_pass(spark, minute, faults):
    a = alerts(spark, minute)
    first, rest = greedy(faults.collect(), a.collect())
    res = {r["scenario_id"]: r for r in evaluation.window_results(a, faults).collect()}
    for s, opened in first.items():
        start = next(w["injected_at"] for w in faults.collect() if w["scenario_id"] == s)
        assert res[s]["detected"] == (opened is not None)
        assert res[s]["delay_seconds"] == (opened and (opened - start).total_seconds())
    assert {r["alert_id"] for r in evaluation.unmatched_alerts(a, faults).collect()} == rest == {"b1", "b2", "b3"}
    assert res["bad_deploy"]["attribution_correct"] is True and res["s1"]["attribution_correct"] is None
    strict = evaluation.window_results(a, faults, by_scenario=False).where("scenario_id = 'bad_deploy'").first()
    assert strict["attribution_correct"] is None


def test_siblings(spark, minute, faults):
    rest = evaluation.unmatched_alerts(alerts(spark, minute), faults)
    keep = lambda t: {r["alert_id"] for r in evaluation.drop_siblings(rest, faults, replace(PRODUCTION, sibling_score=t)).collect()}
    assert keep(0.9) == {"b2", "b3"} and keep(0.0) == {"b3"}


def test_reports(spark, minute, faults):
    a = alerts(spark, minute)
    rep = {r["source_file"]: r for r in evaluation.scenario_report(a, faults).collect()}
    # the stress file is judged alone, so its window takes the alerts of 16, 17 and 25 itself
    assert (rep["x_core.json"]["tp"], rep["x_core.json"]["fp"]) == (1, 1)
    assert (rep["x_stress.json"]["tp"], rep["x_stress.json"]["fp"], rep["x_stress.json"]["median_delay_seconds"]) == (1, 0, 60.0)
    assert (rep["y.json"]["tp"], rep["y.json"]["fn"]) == (0, 1) and rep["bad.json"]["attribution_correct"] == 1
    total = evaluation.overall_report(a, faults).first()
    assert (total["tp"], total["fp"], total["fn"], total["attribution_accuracy"]) == (3, 1, 1, 1.0)
    assert total["f1"] == pytest.approx(0.75)


def test_ratio_rules(spark):
    df = spark.createDataFrame([(0, 0, 3), (0, 2, 0), (2, 2, 2)], "tp bigint, fp bigint, fn bigint")
    null = [(r["precision"], r["recall"], r["f1"]) for r in evaluation.with_ratios(df).collect()]
    assert null == [(None, 0.0, None), (0.0, None, None), (0.5, 0.5, 0.5)]
    zero = [r["f1"] for r in evaluation.with_ratios(df, zero_f1=True).collect()]
    assert zero == [0.0, 0.0, 0.5]


def test_best_threshold_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(0.7, 0.5), (0.4, 0.8), (0.6, 0.8)], "threshold double, f1 double")
    assert evaluation.best_threshold(df).first()["threshold"] == 0.4


def context_row(spark, fault=None, score=None, value=400.0, limit=300.0):
    doc = F.struct(
        F.lit("GET /x").alias("endpoint_id"), F.lit("p99_ms").alias("signal_type"), F.lit(value).cast("double").alias("observed_value"),
        F.lit(limit).cast("double").alias("slo_threshold"), F.lit(0.8).alias("score"), F.lit("warning").alias("severity"),
        F.struct(F.lit(fault).cast("string").alias("suspected_fault"), F.lit(score).cast("double").alias("imputation_score")).alias("correlation"),
    )
    return spark.range(1).select(doc.alias("context"))


CAND = "endpoint_id string, service string, call_type string, anomaly_score double, confidence_score double, confidence string"


def explain_with(spark, cand=None, **kw):
    value = F.lit(None).cast(f"struct<{CAND.replace(' string', ':string').replace(' double', ':double').replace(', ', ',')}>")
    rows = context_row(spark, **kw)
    if cand:
        value = F.struct(*[F.lit(v).alias(n.split()[0]) for v, n in zip(cand, CAND.split(", "))])
    return explain.template_explanation(rows, value).first()["explanation"]


@pytest.mark.parametrize("level, word", [("high", "start the investigation there"), ("medium", "before other leads"), ("low", "a weak hint"), (None, "not rated")])
def test_candidate_wording(spark, level, word):
    e = explain_with(spark, ("GET /b", "b", "direct", 0.9, 0.9, level), fault="s:f:e", score=1.0)
    assert word in e["suspected_cause"] and "GET /b" in e["suspected_cause"] and "s:f:e" not in e["suspected_cause"]
    assert e["fallback"] and len(e["checks"]) == 3


def test_cause_priority(spark):
    assert "s:f:e" in explain_with(spark, fault="s:f:e", score=0.5)["suspected_cause"]
    assert "No lead" in explain_with(spark, fault="s:f:e", score=0.49)["suspected_cause"]
    assert "No lead" in explain_with(spark)["suspected_cause"]
    assert "400.00" in explain_with(spark)["summary"] and "300.00" in explain_with(spark)["summary"]
    assert "Alert on p99_ms of GET /x" in explain_with(spark, value=None)["summary"]


GOOD = {"summary": " s ", "suspected_cause": "c", "checks": ["x ", "y"]}


@pytest.mark.parametrize("text, ok", [
    (json.dumps(GOOD), True), ("```json\n" + json.dumps(GOOD) + "\n```", True), ("```\n" + json.dumps(GOOD, indent=1), True),
    (json.dumps({**GOOD, "summary": "  "}), False), (json.dumps({**GOOD, "checks": []}), False), (json.dumps({**GOOD, "checks": "x"}), False),
    (json.dumps({**GOOD, "checks": ["a", " "]}), False), ("plain words", False), ("", False), (None, False), (json.dumps({"summary": "s"}), False),
    (json.dumps([GOOD]), False),
])
def test_response_contract(spark, text, ok):
    r = explain.response_validate(spark.createDataFrame([(text,)], "response string")).first()
    assert r["valid"] is ok
    if ok:
        assert (r["parsed"]["summary"], list(r["parsed"]["checks"]), r["parsed"]["fallback"]) == ("s", ["x", "y"], False)


def test_rubric(spark):
    long = "verifier les logs du service des commandes maintenant"
    rows = [("vu 412,5 ms", "cause probable", [long, long], 400.0), ("vu 500 ms", "certain", [long, "logs"], 400.0), ("rien", "", None, 400.0)]
    df = spark.createDataFrame(rows, "s string, c string, k array<string>, raw_value double")
    df = df.withColumn("explanation", F.struct(F.col("s").alias("summary"), F.col("c").alias("suspected_cause"), F.col("k").alias("checks")))
    got = [tuple(r)[-5:] for r in explain.explanation_rubric(df).collect()]
    assert got == [(1, 2, 2, 1, 6), (1, 1, 1, 0, 3), (0, 0, 0, 1, 1)]


def test_message_lines_are_optional(spark):
    base = spark.createDataFrame([("GET /x", "p99_ms", "critical", 0.85, 412.4, None, None, None)], "endpoint_id string, signal_type string, severity string, score double, raw_value double, deploy_service string, deploy_version string, deploy_score double")
    short = explain.notification_text(base).first()["message"]
    assert short.split("\n") == ["FIRING [CRITICAL]", "Endpoint: GET /x", "Signal: p99_ms", "Detail: p99 412 ms", "Score: 0.85"]
    ttd = F.struct(F.lit(12.0).alias("ttd_minutes"), F.lit(8.0).alias("ttd_low"), F.lit(30.0).alias("ttd_high"), F.lit(1.5).alias("slope_ms_per_min"), F.lit(False).alias("already_breaching"))
    full = explain.notification_text(base.withColumn("deploy_version", F.lit("v1")).withColumn("deploy_service", F.lit("o")).withColumn("deploy_score", F.lit(0.9)).withColumn("ttd", ttd)).first()["message"]
    assert "Suspected deployment: o v1 (score 0.90)" in full and "about 12 min [8-30], +1.5 ms/min" in full


@pytest.mark.parametrize("series, slo, want", [
    ([100.0 + 11 * i for i in range(10)], 300.0, "point"), ([150.0] * 6, 300.0, None), ([200.0, 150.0, 100.0], 300.0, None),
    ([100.0, 110.0], 300.0, None), ([100.0, 101.0, 102.0], 100000.0, None), ([310.0, 320.0, 330.0], 300.0, "breach"), ([100.0, 110.0, 120.0], None, None),
])
def test_time_to_degradation(spark, series, slo, want):
    from redwatch.functions.arrays import pairwise_slopes

    df = spark.createDataFrame([(series, slo)], "p99_ms_series array<double>, slo_p99_ms double").withColumn("p99_slopes", pairwise_slopes("p99_ms_series"))
    r = df.select(scoring.time_to_degradation().alias("t")).first()["t"]
    if want is None:
        assert r is None
    elif want == "breach":
        assert r["already_breaching"] and r["ttd_minutes"] == 0.0
    else:
        assert r["ttd_minutes"] == pytest.approx(round((300 - 199) / 11, 1)) and r["ttd_low"] <= r["ttd_minutes"] <= r["ttd_high"]


def test_scoring_rules(spark):
    rows = [(250.0, 300.0, 90.0, 180.0, 0.0), (450.0, 300.0, 90.0, 180.0, 0.0), (700.0, 300.0, None, None, 1.0), (200.0, 300.0, 90.0, 180.0, 0.9), (50.0, 300.0, 90.0, 180.0, 1.0)]
    df = spark.createDataFrame(rows, "p99_ms double, slo_p99_ms double, a double, c double, ml double")
    df = df.withColumn("b_p99_ms", F.struct(F.col("a").alias("p10"), F.lit(100.0).alias("p50"), F.col("c").alias("p90")))
    got = scoring.combine(scoring.layer_scores(df), PRODUCTION, "ml").collect()
    assert [r["direction"] for r in got] == ["degradation", "degradation", "normal", "degradation", "improvement"]
    assert [r["anomaly"] for r in got] == [False, True, True, True, False]
    assert [r["layer"] for r in got] == [None, "combined", "static", "iforest", None]
    assert [r["severity"] for r in got] == ["warning", "critical", "critical", "critical", "warning"]
    assert got[3]["combined"] == pytest.approx(20 / 90 / 2 + (1 - 20 / 90 / 2) * 0.9, abs=1e-6)


def test_selfobs(spark, minute):
    now = F.lit(minute(10))
    df = spark.createDataFrame([(minute(m),) for m in (0, 1, 3, 8)], "time timestamp")
    assert selfobs.component_up(df, now).first()["up"] == 1 and selfobs.component_up(df.limit(0), now).first()["up"] == 0
    gaps = [r["gap_seconds"] for r in selfobs.cadence(df).orderBy("cycle").collect()]
    assert gaps == [None, 60.0, 120.0, 300.0]
    states = {r["state"]: r["n"] for r in selfobs.state_counts(spark.createDataFrame([("ok",), ("ok",)], "state string"), spark).collect()}
    assert states == {"ok": 2, "pending": 0, "firing": 0, "resolving": 0}
    health = spark.createDataFrame([(minute(0), 0.1), (minute(5), 0.3)], "checked_at timestamp, ks_drift double")
    assert selfobs.drift_state(health).first()["drift"] == 1 and selfobs.drift_state(health.limit(0)).count() == 0
