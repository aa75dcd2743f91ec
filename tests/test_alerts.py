import random
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from redwatch.config import PRODUCTION
from redwatch.operators import alerts
from redwatch.sources.tables import fresh_path
from redwatch.streaming import alert_stream, red_stream

SIG = "endpoint_id string, signal_type string, service string, time timestamp, anomaly boolean, severity string, score double, raw_value double, layer string, level double"


def replay(flags, fire=2, resolve=2, compat=False):
    """Plain reading of the transition rules: (state, pending, resolving) after each cycle."""
    state, pc, rc, out = "ok", 0, 0, []
    for bad in flags:
        if bad:
            if state == "ok":
                state, pc, rc = "pending", 0, 0
            elif state == "pending":
                if pc + 1 >= fire:
                    state, pc, rc = "firing", 0, 0
                else:
                    pc += 1
            elif state == "resolving":
                state = "ok" if compat and rc >= resolve else "firing"
                pc = rc = 0
        else:
            if state == "firing":
                state, pc, rc = "resolving", 0, 1
            elif state == "resolving":
                if rc >= resolve:
                    state, pc, rc = "ok", 0, 0
                else:
                    rc += 1
            elif state == "pending":
                state, pc, rc = "ok", 0, 0
        out.append((state, pc, rc))
    return out


def signal_rows(minute, flags, endpoint="e"):
    return [
        (endpoint, "p99_ms", "s", minute(i), bool(b), "critical" if b and i % 5 == 0 else ("warning" if b else None), float(i % 7) if b else 0.0, 1.0, "static" if b else None, float(i % 7) if b else 0.0)
        for i, b in enumerate(flags)
    ]


@pytest.fixture(scope="module")
def series():
    rnd = random.Random(11)
    out = {}
    for k in range(6):
        flags, p = [], 0.5
        for _ in range(700 if k else 5000):
            p = 0.85 if rnd.random() < 0.05 else (0.15 if rnd.random() < 0.05 else p)
            flags.append(rnd.random() < p)
        out[f"e{k}"] = flags
    out["one"] = [True]
    return out


@pytest.mark.parametrize("fire, resolve, compat", [(2, 2, False), (2, 2, True), (1, 1, False), (3, 4, True)])
def test_fold_equals_the_rules(spark, minute, series, fire, resolve, compat):
    s = replace(PRODUCTION, fire_after=fire + 1, resolve_after=resolve + 1, compat_resolving=compat)
    rows = [r for k, flags in series.items() for r in signal_rows(minute, flags, k)]
    df = spark.createDataFrame(rows, SIG).repartition(7)
    log = alerts.alert_log(df, s).orderBy("time").collect()
    for k, flags in series.items():
        got = [(r["state"], r["pending_count"], r["resolving_count"]) for r in log if r["endpoint_id"] == k]
        assert got == replay(flags, fire, resolve, compat)


def test_times_of_one_incident(spark, minute):
    flags = [0, 1, 1, 1, 0, 1, 0, 0, 0, 0, 1]
    log = alerts.alert_log(spark.createDataFrame(signal_rows(minute, flags), SIG)).orderBy("time").collect()
    assert [r["state"] for r in log] == ["ok", "pending", "pending", "firing", "resolving", "firing", "resolving", "resolving", "ok", "ok", "pending"]
    assert [r["opened_at"] and r["opened_at"].minute for r in log] == [None, None, None, 3, 3, 3, 3, 3, 3, 3, None]
    assert [r["resolved_at"] and r["resolved_at"].minute for r in log] == [None] * 8 + [8, 8, None]
    assert [r["pending_since"] and r["pending_since"].minute for r in log] == [None] + [1] * 7 + [None, None, 10]


def test_history_episodes_and_current(spark, minute):
    flags = [1, 1, 1, 0, 1, 0, 0, 0, 1, 1, 1, 1]
    log = alerts.alert_log(spark.createDataFrame(signal_rows(minute, flags), SIG))
    assert [r["time"].minute for r in alerts.alert_history(log).orderBy("time").collect()] == [2, 4, 10]
    assert [r["time"].minute for r in alerts.newly_fired(log).orderBy("time").collect()] == [2, 10]
    ep = alerts.episodes(log).orderBy("opened_at").collect()
    assert [(e["pending_since"].minute, e["opened_at"].minute, e["resolved_at"] and e["resolved_at"].minute) for e in ep] == [(0, 2, 7), (8, 10, None)]
    now = alerts.current_alerts(log).collect()
    assert len(now) == 1 and now[0]["state"] == "firing"
    quiet = alerts.alert_log(spark.createDataFrame(signal_rows(minute, [0, 0], "q"), SIG))
    assert alerts.current_alerts(quiet).count() == 0
    changed = alerts.upsert_current(alerts.current_alerts(log).withColumn("state", F.lit("ok")), alerts.current_alerts(log))
    assert [r["state"] for r in changed.collect()] == ["firing"]


def test_current_alert_keeps_its_evidence(spark, minute):
    rows = signal_rows(minute, [1, 1, 1, 0, 0, 0, 0])
    log = alerts.alert_log(spark.createDataFrame(rows, SIG))
    whole = alerts.current_alerts(log).first()
    last_bad = log.where("anomaly").orderBy(F.desc("time")).first()
    assert whole["state"] == "ok" and last_bad["severity"] is not None
    assert [whole[c] for c in ("score", "raw_value", "severity", "layer")] == [last_bad[c] for c in ("score", "raw_value", "severity", "layer")]
    # a later batch without an anomaly keeps it too
    cut = last_bad["time"]
    old, new = alerts.current_alerts(log.where(F.col("time") <= cut)), alerts.current_alerts(log.where(F.col("time") > cut))
    merged = alerts.upsert_current(old, new).first()
    assert (merged["state"], merged["severity"], merged["score"]) == ("ok", last_bad["severity"], last_bad["score"])


@pytest.mark.parametrize("flags, m, onsets", [
    ([0, 1, 1, 1, 0, 1, 1], 2, [3, 7]), ([1, 0, 1, 0], 2, []), ([1, 1, 1, 1], 3, [3]), ([1, 1], 1, [1]),
])
def test_consecutive_onsets(spark, minute, flags, m, onsets):
    df = spark.createDataFrame([("e", minute(i + 1), bool(b)) for i, b in enumerate(flags)], "endpoint_id string, time timestamp, f boolean")
    got = df.withColumn("on", alerts.consecutive_onsets(df, "f", m)).where("on").orderBy("time").collect()
    assert [r["time"].minute for r in got] == onsets


def test_audit_and_rest(spark):
    schema = "endpoint_id string, signal_type string, state string, pending_count int"
    decided = spark.createDataFrame([("a", "p", "ok", 0), ("b", "p", "firing", 0), ("c", "p", "firing", 0)], schema)
    stored = spark.createDataFrame([("b", "p", "firing", 0), ("c", "p", "ok", 0)], schema)
    assert [r["endpoint_id"] for r in alerts.state_audit(stored, decided).collect()] == ["c"]
    busy = spark.createDataFrame([("a", "error_rate_5xx", "ok", 1), ("b", "error_rate_5xx", "ok", 0), ("c", "p99_ms", "firing", 0), ("d", "error_rate_5xx", "pending", 0)], schema)
    assert {r["endpoint_id"] for r in alerts.not_at_rest(busy).collect()} == {"a", "d"}


def test_silence_and_escalation(spark, minute):
    flags = [1, 1, 1, 1, 1, 1, 1]
    log = alerts.alert_log(spark.createDataFrame(signal_rows(minute, flags), SIG))
    assert [r["time"].minute for r in alerts.escalations(log).collect()] == [5]
    ep = alerts.episodes(log)
    quiet = spark.createDataFrame([("e", minute(0), minute(3))], "endpoint_id string, silent_from timestamp, silent_to timestamp")
    assert alerts.silence(ep, quiet).count() == 0
    assert alerts.silence(ep, quiet.withColumn("endpoint_id", F.lit("x"))).count() == 1


def test_stream_equals_batch_over_many_batches(spark, minute, series):
    rows = [r for k in ("e1", "e2", "one") for r in signal_rows(minute, series[k][:200], k)]
    path = fresh_path(spark, "signals")
    df = spark.createDataFrame(rows, SIG)
    for part in range(4):
        low, high = minute(part * 50), minute(part * 50 + 50)
        df.where((F.col("time") >= F.lit(low)) & (F.col("time") < F.lit(high))).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = red_stream.run_to_table(alert_stream.alert_stream(stream), fresh_path(spark, "log"), fresh_path(spark, "cp"))
    columns = ["endpoint_id", "signal_type", "time", "prev_state", "state", "pending_count", "resolving_count", "pending_since", "opened_at", "resolved_at"]
    want = alerts.alert_log(df).select(*columns)
    got = out.select(*columns)
    assert got.count() == want.count() == len(rows)
    assert got.exceptAll(want).count() == 0


def test_stale_signal_is_closed_by_a_timer(spark, minute):
    path = fresh_path(spark, "stale")
    spark.createDataFrame(signal_rows(minute, [1, 1, 1], "gone"), SIG).coalesce(1).write.mode("append").parquet(path)
    later = [("alive", "p99_ms", "s", minute(60 + i), False, None, 0.0, 1.0, None, 0.0) for i in range(2)]
    spark.createDataFrame(later, SIG).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SIG).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("time", "1 minute")
    out = red_stream.run_to_table(alert_stream.alert_stream(stream, stale_after=300), fresh_path(spark, "log"), fresh_path(spark, "cp"))
    last = out.where("endpoint_id = 'gone'").orderBy(F.desc("time")).first()
    assert last["state"] == "ok" and last["time"] == minute(2) + timedelta(seconds=300)


def test_clear_threshold_holds_an_open_alert(spark, minute):
    # levels: fire at 0.6, hold at 0.3
    levels = [0.4, 0.7, 0.7, 0.7, 0.4, 0.1, 0.4, 0.1, 0.1, 0.1, 0.4]
    rows = [("e", "p99_ms", "s", minute(i), v >= 0.6, None, v, 1.0, None, v) for i, v in enumerate(levels)]
    df = spark.createDataFrame(rows, SIG)
    s = replace(PRODUCTION, clear_threshold=0.3)
    want = ["ok", "pending", "pending", "firing", "firing", "resolving", "firing", "resolving", "resolving", "ok", "ok"]
    assert [r["state"] for r in alerts.alert_log(df, s).orderBy("time").collect()] == want
    path = fresh_path(spark, "hold")
    df.write.parquet(path)
    stream = alert_stream.alert_stream(spark.readStream.schema(SIG).parquet(path), s)
    out = red_stream.run_to_table(stream, fresh_path(spark, "log"), fresh_path(spark, "cp"))
    assert [r["state"] for r in out.orderBy("time").collect()] == want


def test_published_current_table_is_repeatable(spark, minute):
    log = alerts.alert_log(spark.createDataFrame(signal_rows(minute, [1, 1, 1, 0, 0, 0]), SIG))
    root = fresh_path(spark, "current")
    first, second = log.where(F.col("time") < F.lit(minute(3))), log.where(F.col("time") >= F.lit(minute(3)))
    alert_stream.publish_current(first, root, 0)
    for _ in range(2):
        path = alert_stream.publish_current(second, root, 1)
    assert [r["state"] for r in spark.read.parquet(path).collect()] == ["ok"]


@pytest.mark.parametrize("compat", [False, True])
def test_scan_over_blocks_equals_a_walk(spark, minute, monkeypatch, compat):
    """Histories of many runs and blocks, with gaps, cycles at one time and cycles without a time."""
    import dataclasses
    import random

    from redwatch.config import PRODUCTION

    monkeypatch.setattr(alerts, "RUN", 4)
    monkeypatch.setattr(alerts, "FAN", 3)
    settings = dataclasses.replace(PRODUCTION, compat_resolving=compat)
    rnd = random.Random(3)
    rows = []
    for s, n in enumerate((1, 5, 150, 151)):
        at, bad = 0, False
        for i in range(n):
            at += rnd.choice([1, 1, 1, 1, 9, 400])
            bad = bad if rnd.random() < 0.75 else not bad
            rows.append((f"e{s}", "p99_ms", minute(at), bad, i))
    df = spark.createDataFrame(rows, "endpoint_id string, signal_type string, time timestamp, anomaly boolean, i int").withColumn("level", F.lit(0.0)).repartition(5)
    got = {(r["endpoint_id"], r["i"]): r for r in alerts.alert_log(df, settings).collect()}
    assert len(got) == len(rows)
    states, code, began, fired, closed = alerts.machine(settings), 0, None, None, None
    for e, _, t, bad, i in rows:
        if i == 0:
            code, began, fired, closed = 0, None, None, None
        new = states[code][3 if bad else 2]
        before, after = states[code][0], states[new][0]
        began = t if before == "ok" and after != "ok" else began
        fired = t if after == "firing" and before in ("ok", "pending") else fired
        closed = t if after == "ok" and before != "ok" else closed
        code, r = new, got[(e, i)]
        assert (r["prev_state"], r["state"], r["episode_start"]) == (before, after, began)
        assert r["pending_since"] == (began if after != "ok" else None) and r["resolved_at"] == (closed if after == "ok" else None)
        assert r["opened_at"] == (fired if fired and began and fired >= began else None)


def test_a_million_cycles_of_one_signal_spread(spark):
    """No run holds more than 64 cycles and no block more than 1024 runs, so no task needs a hundredth of a long signal."""
    n = 1_000_000
    df = spark.range(n, numPartitions=16).select(
        F.lit("e").alias("endpoint_id"), F.lit("p99_ms").alias("signal_type"), F.timestamp_seconds(F.col("id") * 60).alias("time"),
        (F.col("id") % 1000 < 10).alias("anomaly"), F.lit(0.0).alias("level"),
    )
    out = alerts.fold_states(df).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("code") == 3).cast("int")).alias("firing"), F.max("_closed").alias("closed")).first()
    # of ten bad cycles in a row the third fires; three clean ones close
    assert (out["n"], out["firing"]) == (n, 8 * n // 1000) and out["closed"].timestamp() % 60000 == 12 * 60
