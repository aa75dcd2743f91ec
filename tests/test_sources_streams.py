import json
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from redwatch.config import PRODUCTION
from redwatch.operators import red
from redwatch.sources import ground_truth, tables, telemetry
from redwatch.streaming import red_stream

T0 = datetime(2024, 1, 1)
SPAN = "span_id bigint, endpoint_id string, service string, service_tier string, span_kind string, ts timestamp, status_code int, latency_ms double"


def test_ground_truth_files(spark, tmp_path):
    fault = {"scenario_id": "s", "fault_type": "f", "target_service": "o", "target_endpoint": "E", "injected_at": "2024-01-01T00:00:00+02:00", "cleared_at": "2024-01-01T00:10:00Z", "magnitude": {"ms": 5}}
    naive = {"fault_type": "g", "injected_at": "2024-01-01T05:00:00", "cleared_at": "2024-01-01T05:10:00.250"}
    (tmp_path / "deep").mkdir()
    (tmp_path / "list.json").write_text(json.dumps([fault, {"fault_type": "open", "injected_at": "2024-01-01T00:00:00Z"}]))
    (tmp_path / "deep" / "object.json").write_text(json.dumps({"scenario_id": "whole", "faults": [naive]}, indent=2))
    (tmp_path / "broken.json").write_text('[{"fault_type": "x", ')
    (tmp_path / "empty.json").write_text('{"faults": []}')
    (tmp_path / "skip.txt").write_text("[]")
    got = {r["source_file"]: r for r in ground_truth.read_injections(spark, str(tmp_path)).collect()}
    assert set(got) == {"list.json", "object.json"}
    assert got["list.json"]["injected_at"] == datetime(2023, 12, 31, 22) and got["list.json"]["magnitude"] == {"ms": "5"}
    assert (got["object.json"]["scenario_id"], got["object.json"]["injected_at"]) == ("whole", datetime(2024, 1, 1, 5))
    files = ground_truth.read_files(spark, str(tmp_path))
    valid = {r["source_file"]: (r["valid"], r["faults"]) for r in ground_truth.validate(files).collect()}
    assert valid == {"list.json": (False, 2), "object.json": (True, 1), "broken.json": (False, 0), "empty.json": (False, 0)}
    assert [r[0] for r in ground_truth.unreadable_files(files).collect()] == ["broken.json"]


def test_redaction(spark):
    df = spark.createDataFrame([({"http.url": "u", "user.id": "1", "k": "v"},)], "attrs map<string,string>")
    assert telemetry.redact_attrs(df).first()["attrs"] == {"k": "v"}
    assert telemetry.keep_attrs(df, ["user.id"]).first()["attrs"] == {"user.id": "1"}


def test_feature_sink_and_retention(spark, tmp_path):
    rows = [(T0 + timedelta(days=d), "e", p, None) for d, p in ((0, 1.0), (50, float("nan")), (60, 2.0), (100, 3.0))]
    df = spark.createDataFrame(rows, "time timestamp, endpoint_id string, p99_ms double, error_rate_5xx double").withColumn("error_rate_4xx", F.lit(None).cast("double"))
    path = str(tmp_path / "features")
    tables.write_features(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 3 and back.where("error_rate_5xx = 0.0 AND error_rate_4xx = 0.0").count() == 3
    now = T0 + timedelta(days=100)
    assert tables.expired_partitions(path, spark, now) == ["date=2024-01-01"]
    assert tables.drop_expired(path, spark, now) == ["date=2024-01-01"] and tables.expired_partitions(path, spark, now) == []
    assert spark.read.parquet(path).count() == 2
    recent = tables.read_range(spark, path, "time timestamp, p99_ms double", "time", T0 + timedelta(days=99))
    assert [r["p99_ms"] for r in recent.collect()] == [3.0]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in plan


def test_baseline_upsert_and_versions(spark, tmp_path):
    schema = "endpoint_id string, metric string, dow int, hour_bucket int, p50 double"
    old = spark.createDataFrame([("e", "m", 1, 1, 1.0), ("e", "m", 1, 2, 2.0)], schema)
    new = spark.createDataFrame([("e", "m", 1, 2, 9.0), ("e", "m", 1, 3, 3.0)], schema)
    path = tables.replace_table(tables.upsert_baseline(old, new), str(tmp_path), "1")
    assert {r["hour_bucket"]: r["p50"] for r in spark.read.parquet(path).collect()} == {1: 1.0, 2: 9.0, 3: 3.0}
    with pytest.raises(Exception):
        tables.replace_table(old, str(tmp_path), "1")


def test_deploys(spark, minute):
    df = spark.createDataFrame([(None, "o", "v1", None), ("d", "p", "v2", minute(5))], "deploy_id string, service string, version string, deployed_at timestamp")
    rows = tables.deploy_rows(df, F.lit(minute(9)))
    first = rows.where("service = 'o'").first()
    assert first["deployed_at"] == minute(9) and len(first["deploy_id"]) == 64
    assert [r["version"] for r in tables.recent_deploys(rows, F.lit(minute(10))).collect()] == ["v1", "v2"]
    assert tables.recent_deploys(rows, F.lit(minute(10)), "p", since_minutes=3).count() == 0
    with pytest.raises(ValueError):
        tables.recent_deploys(rows, F.lit(minute(10)), limit=501)


def test_checkpoint_folder_of_the_session_is_used(spark):
    want = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert tables.checkpoint_dir(spark) == want and tables.fresh_path(spark, "x").startswith(want)


def span_rows(minute, n=300):
    return [(i, f"e{i % 3}", "s", "t", "SPAN_KIND_SERVER", minute(i / 10), 500 if i % 7 == 0 else 200, float(i % 90)) for i in range(n)]


def write_parts(spark, tmp_path, parts):
    path = str(tmp_path / "spans")
    for rows in parts:
        spark.createDataFrame(rows, SPAN).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream):
    return red_stream.run_to_table(stream, tables.fresh_path(spark, "out"), tables.fresh_path(spark, "cp"))


def test_stream_windows_equal_batch_windows(spark, minute, tmp_path):
    rows = span_rows(minute)
    stream = write_parts(spark, tmp_path, [rows[i:i + 100] for i in (0, 100, 200)])
    got = run(spark, red_stream.tumbling_red(stream, PRODUCTION, "1 minute")).collect()
    want = {(r["endpoint_id"], r["time"]): r for r in red.red_features(spark.createDataFrame(rows, SPAN)).collect()}
    closed = {k for k in want if k[1] + timedelta(minutes=1) <= minute(29.9) - timedelta(minutes=1)}
    assert {(r["endpoint_id"], r["time"]) for r in got} == closed and len(got) == len(closed)
    for r in got:
        w = want[r["endpoint_id"], r["time"]]
        assert (r["rps"], r["p50_ms"], r["p99_ms"], r["error_rate_5xx"]) == (w["rps"], w["p50_ms"], w["p99_ms"], w["error_rate_5xx"])


def test_late_spans_are_dropped_and_duplicates_removed(spark, minute, tmp_path):
    rows = span_rows(minute)
    late = [(9000 + i, "e0", "s", "t", "SPAN_KIND_SERVER", minute(0), 500, 1.0) for i in range(20)]
    stream = write_parts(spark, tmp_path, [rows[:150], rows[150:], late])
    got = run(spark, red_stream.tumbling_red(stream, PRODUCTION, "1 minute"))
    first = got.where((F.col("time") == F.lit(minute(0))) & (F.col("endpoint_id") == "e0")).collect()
    assert len(first) == 1 and first[0]["span_count"] == 4
    twice = write_parts(spark, tmp_path / "dup", [rows[:50], rows[:50], rows[25:80]])
    assert run(spark, red_stream.deduplicated(twice)).count() == 80


def test_quarantine(spark):
    df = spark.createDataFrame([("GET /a", "/a"), ("GET /b", None), ("GET /c", " ")], "endpoint_id string, route string")
    assert [r["endpoint_id"] for r in red.quarantine_missing_route(df).collect()] == ["GET /a", "quarantine", "quarantine"]


def test_compaction_orders_old_rows(spark):
    rows = [(T0 + timedelta(days=d, hours=h), f"e{h % 2}") for d in (0, 1, 9) for h in range(6)]
    df = spark.createDataFrame(rows, "time timestamp, endpoint_id string")
    out = tables.compact_old(df, F.lit(T0 + timedelta(days=10)), replace(PRODUCTION, compact_after_days=7))
    parts = out.rdd.glom().collect()
    assert sum(map(len, parts)) == 12
    for p in parts:
        keys = [(r["date"], r["endpoint_id"], -r["time"].timestamp()) for r in p]
        assert keys == sorted(keys)
