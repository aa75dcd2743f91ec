import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from redwatch.config import PRODUCTION
from redwatch.operators.alerts import alert_log, episodes
from redwatch.sources.tables import stored
from redwatch.streaming import outbox

T0 = datetime(2024, 1, 1)
SIGNAL = "endpoint_id string, signal_type string, service string, time timestamp, anomaly boolean, severity string, score double, raw_value double, layer string, level double"


@pytest.fixture(scope="module")
def tables(spark):
    """Two endpoints: bad for five cycles, clean for five, over and over; a fault and a deployment at the start."""
    rows = [
        (e, "p99_ms", "svc", T0 + timedelta(minutes=m), (m // 5 + shift) % 2 == 0, "critical", 0.9, 900.0 + m, "static", 0.9)
        for e, shift in (("GET /a", 0), ("GET /b", 1)) for m in range(40)
    ]
    log = stored(alert_log(spark.createDataFrame(rows, SIGNAL).drop("level"), PRODUCTION), "log")
    faults = spark.createDataFrame(
        [("s1", "latency_step", "svc", "GET /a", T0 - timedelta(minutes=1), T0 + timedelta(minutes=8), "f.json")],
        "scenario_id string, fault_type string, target_service string, target_endpoint string, injected_at timestamp, cleared_at timestamp, source_file string",
    )
    deploys = spark.createDataFrame(
        [("d1", "svc", "v7", T0 + timedelta(minutes=1), "deploy")], "deploy_id string, service string, version string, deployed_at timestamp, kind string"
    )
    slos = spark.createDataFrame([("GET /a", 300.0, 5.0), ("GET /b", 400.0, 5.0)], "endpoint_id string, slo_p99_ms double, slo_error_rate_5xx double")
    return log, lambda fired, past: outbox.write_up(fired, past, faults, deploys, slos)


def part(log, low, high):
    return log.where((F.col("time") >= F.lit(T0 + timedelta(minutes=low))) & (F.col("time") < F.lit(T0 + timedelta(minutes=high))))


def ids(df):
    return sorted(r["alert_id"] for r in df.select("alert_id").collect())


def test_firings_have_the_ids_of_the_episodes(tables):
    log, _ = tables
    assert ids(outbox.firings(log)) == ids(outbox.firings(log.unionAll(log))) == ids(episodes(log))
    row = outbox.firings(log).orderBy("opened_at").first()
    micros = int((row["opened_at"] - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert row["alert_id"] == hashlib.sha256(f"GET /a|p99_ms|{micros}".encode()).hexdigest()


def test_each_incident_has_one_message(spark, tables, tmp_path):
    log, text = tables
    calls = []

    def counted(fired, past):
        calls.append(fired.count())
        return text(fired, past)

    box = outbox.Outbox(spark, str(tmp_path / "outbox"))
    assert box.written() == [] and box.messages().isEmpty()
    want = ids(episodes(log))
    box.deliver(part(log, 0, 15), 0, counted)
    first = box.messages().orderBy("alert_id").collect()
    box.deliver(part(log, 0, 15), 0, counted)  # the batch again
    assert box.messages().orderBy("alert_id").collect() == first and len(first) == 3
    # late and repeated rows of an explained incident do not count, also from another stream
    box.deliver(part(log, 0, 15), 1, counted)
    outbox.Outbox(spark, box.root, "other").deliver(part(log, 0, 15), 0, counted)
    assert len(box.written()) == 1
    with pytest.raises(RuntimeError):
        box.deliver(part(log, 10, 40), 2, lambda fired, past: (_ for _ in ()).throw(RuntimeError("lost")))
    box.deliver(part(log, 10, 40), 2, counted)
    assert ids(box.messages()) == want and len(set(want)) == len(want) > 4
    assert calls == [3, 3, len(want) - 3]
    # a directory that was not finished does not count
    (tmp_path / "outbox" / "stream=alerts-batch=000000000009").mkdir()
    assert ids(box.messages()) == want


def test_content_of_a_message(spark, tables, tmp_path):
    log, text = tables
    box = outbox.Outbox(spark, str(tmp_path / "outbox"))
    box.deliver(log, 0, text)
    rows = box.messages().orderBy("opened_at").collect()
    a = next(r for r in rows if r["endpoint_id"] == "GET /a")
    assert a["suspected_fault"] == "s1:latency_step:GET /a" and a["imputation_score"] == 1.0 and a["deploy_version"] == "v7"
    assert a["explanation"]["fallback"] and "against a limit of 300.00" in a["explanation"]["summary"]
    assert a["message"].startswith("FIRING [CRITICAL]\nEndpoint: GET /a\nSignal: p99_ms") and "Suspected deployment: svc v7" in a["message"]
    assert rows[-1]["message"].count("Probable cause (template)") == 1


def test_stream_resumes_where_it_stopped(spark, tables, tmp_path):
    log, text = tables
    source, root, checkpoint = (str(tmp_path / n) for n in ("log", "outbox", "checkpoint"))
    for low, high in ((0, 12), (12, 40)):
        part(log, low, high).coalesce(1).write.mode("append").parquet(source)
        sent = outbox.run_outbox(spark.readStream.schema(log.schema).parquet(source), root, checkpoint, text)
    assert ids(sent) == ids(episodes(log))
