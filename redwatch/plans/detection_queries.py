"""Queries on scoring, alerting, streaming, attribution and the call graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import alerts, attribution, evaluation, features, graph, red, scoring, selfobs
from ..functions.scalars import half_even, status_of_direction
from ..sources import tables
from ..streaming import alert_stream, heavy_hitters, red_stream
from .fixture import BUCKET, HOUR, at, spans_from
from .registry import query
from .sql import BLOCKS, num, stamp

FEATURES = (
    "baseline_dev_p50", "baseline_dev_p95", "baseline_dev_p99", "feature_error_rate_5xx",
    "latency_slope", "p99_over_p50", "rps_delta",
)


# --------------------------------------------------------------------------- detection


@query("derived_features", ("derived",), f"SELECT endpoint_id, {stamp('time')}, " + ", ".join(num(c) for c in FEATURES) + " FROM derived")
def derived_features(t):
    return t.scored.select("endpoint_id", "time", *FEATURES)


@query("layer_static", ("scored",), f"SELECT endpoint_id, {stamp('time')}, static_breach, {num('static_norm')} FROM scored")
def layer_static(t):
    return t.scored.select("endpoint_id", "time", "static_breach", "static_norm")


@query("layer_baseline", ("scored",), f"SELECT endpoint_id, {stamp('time')}, {num('baseline_norm')}, direction FROM scored")
def layer_baseline(t):
    return t.scored.select("endpoint_id", "time", "baseline_norm", "direction")


@query("combined_score", ("scored",), f"SELECT endpoint_id, {stamp('time')}, {num('ml_gated')}, {num('combined')} FROM scored")
def combined_score(t):
    return t.scored.select("endpoint_id", "time", "ml_gated", "combined")


@query("fire_decision", ("scored",), f"SELECT endpoint_id, {stamp('time')}, anomaly FROM scored")
def fire_decision(t):
    return t.scored.select("endpoint_id", "time", "anomaly")


@query("layer_provenance", ("scored",), f"SELECT endpoint_id, {stamp('time')}, layer FROM scored")
def layer_provenance(t):
    return t.scored.select("endpoint_id", "time", "layer")


@query("severity", ("scored",), f"SELECT endpoint_id, {stamp('time')}, severity FROM scored")
def severity(t):
    return t.scored.select("endpoint_id", "time", "severity")


@query("error_signal", ("signals",), f"""
    SELECT endpoint_id, {stamp('time')}, signal_type, anomaly, severity, {num('score')}, {num('raw_value')}, layer FROM signals""")
def error_signal(t):
    return scoring.signals(t.scored).select(
        "endpoint_id", "time", "signal_type", "anomaly", "severity", "score", "raw_value", "layer"
    )


@query("score_replay", ("replayed",), f"""
    SELECT endpoint_id, {stamp('time')}, {num('p99_ms')}, direction, {num('static_norm')}, {num('baseline_norm')}, {num('ml_norm')}, {num('combined')},
           layer, severity, static_fire, layered_fire FROM replayed""")
def score_replay(t):
    return t.replayed.select(
        "endpoint_id", "time", "p99_ms", "direction", "static_norm", "baseline_norm", "ml_norm", "combined",
        "layer", "severity", "static_fire", "layered_fire",
    )


def _minutes(q: float) -> str:
    s = f"list_aggregate(slopes, 'quantile_cont', {q})"
    return f"CASE WHEN {s} >= 0.5 AND slo_p99_ms >= p99_ms THEN (slo_p99_ms - p99_ms) / {s} END"


BLOCKS["ttd"] = (("scored",), f"""
    SELECT *, CASE WHEN p99_ms >= slo_p99_ms THEN 0.0 ELSE round_even(point, 1) END AS ttd_minutes,
           CASE WHEN p99_ms >= slo_p99_ms THEN 0.0 ELSE round_even(fast, 1) END AS ttd_low,
           CASE WHEN p99_ms >= slo_p99_ms THEN 0.0 ELSE round_even(slow, 1) END AS ttd_high
    FROM (SELECT endpoint_id, time, p99_ms, slo_p99_ms, {_minutes(0.5)} AS point, {_minutes(0.75)} AS fast, {_minutes(0.25)} AS slow,
                 round_even(list_aggregate(slopes, 'quantile_cont', 0.5), 2) AS slope
          FROM scored WHERE len(y) >= 3)
    WHERE p99_ms >= slo_p99_ms OR point <= 120""")


@query("ttd", ("ttd",), f"""
    SELECT endpoint_id, {stamp('time')}, {num('ttd_minutes')}, {num('ttd_low')}, {num('ttd_high')}, {num('slope', 'slope_ms_per_min')},
           p99_ms >= slo_p99_ms AS already_breaching FROM ttd""")
def ttd(t):
    d = scoring.time_to_degradation(settings=t.settings, cycle_seconds=60)
    return t.scored.select("endpoint_id", "time", d.alias("d")).where(F.col("d").isNotNull()).select("endpoint_id", "time", "d.*")


@query("contributing_doc", ("scored",), f"""
    SELECT endpoint_id, {stamp('time')}, {num('round_even(combined, 4)', 'combined')}, {num('round_even(static_norm, 4)', 'static')},
           {num('round_even(baseline_norm, 4)', 'baseline')}, {num('round_even(ml_gated, 4)', 'iforest')}, {num('round_even(ml_norm, 4)', 'ml_norm')},
           direction, {num('round_even(p99_ms, 2)', 'observed')},
           true AS band_close FROM scored""")
def contributing_doc(t):
    c = F.col("contributing")
    # the band is rounded to two digits for display, so it is checked within half a digit
    bands = t.scored.select("endpoint_id", "time", "p10", "expected", "p90")
    near = lambda a, b: F.abs(a - F.col(b)) < 0.00501
    close = near(c["baseline"]["band"][0], "p10") & near(c["baseline"]["expected"], "expected") & near(c["baseline"]["band"][1], "p90")
    return t.anomalies.withColumnRenamed("detected_at", "time").join(bands, ["endpoint_id", "time"]).select(
        "endpoint_id", "time", c["combined"].alias("combined"), c["layers"]["static"].alias("static"),
        c["layers"]["baseline"].alias("baseline"), c["layers"]["iforest"].alias("iforest"), c["ml_norm"].alias("ml_norm"), c["direction"].alias("direction"),
        c["baseline"]["observed"].alias("observed"), close.alias("band_close"),
    )


# --------------------------------------------------------------------------- streams


def _event_stream(t):
    """The events file as a stream."""
    schema = t.table("events").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return spans_from(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def _run(t, stream, name):
    return red_stream.run_to_table(
        stream, tables.fresh_path(t.spark, name), tables.fresh_path(t.spark, f"{name}-checkpoint")
    )


CLOSED = "time + INTERVAL 6 HOUR <= (SELECT max(ts) FROM spans) - INTERVAL 1 HOUR"


@query("tumbling_red", ("features", "spans"), f"""
    SELECT endpoint_id, {stamp('time')}, {num('rps')}, {num('p99_ms')}, {num('error_rate_5xx')} FROM features WHERE {CLOSED}""")
def tumbling_red(t):
    out = _run(t, red_stream.tumbling_red(_event_stream(t), t.settings, "1 hour"), "tumbling")
    return out.select("endpoint_id", "time", "rps", "p99_ms", "error_rate_5xx")


BLOCKS["slid"] = (("spans",), """
    SELECT endpoint_id, w AS time, count(*) AS n, count(*) FILTER (status_code = 500) AS n5, count(*) FILTER (latency_ms <= 200) AS fast
    FROM (SELECT *, unnest([time, time - INTERVAL 6 HOUR]) AS w FROM spans) GROUP BY ALL""")


@query("sliding_red", ("slid", "spans"), f"""
    SELECT endpoint_id, {stamp('time')}, n AS span_count, {num('n / 43200.0', 'rps')}, {num('100.0 * n5 / n', 'error_rate_5xx')}
    FROM slid WHERE time + INTERVAL 12 HOUR <= (SELECT max(ts) FROM spans) - INTERVAL 1 HOUR""")
def sliding_red(t):
    s = replace(t.settings, rate_seconds=12 * HOUR)
    out = _run(t, red_stream.sliding_red(_event_stream(t), s, "1 hour"), "sliding")
    return out.select("endpoint_id", "time", "span_count", "rps", "error_rate_5xx")


@query("sliding_red_batch", ("slid",), f"""
    SELECT endpoint_id, {stamp('time')}, n AS span_count, {num('n / 43200.0', 'rps')}, {num('100.0 * n5 / n', 'error_rate_5xx')} FROM slid""")
def sliding_red_batch(t):
    out = red.sliding_red_features(t.spans, 12 * HOUR, 6 * HOUR)
    return out.select("endpoint_id", "time", "span_count", "rps", "error_rate_5xx")


@query("watermark_rule", ("features", "spans"), f"""
    SELECT endpoint_id, {stamp('max(time)', 'newest_scored')} FROM features WHERE {CLOSED} GROUP BY endpoint_id""")
def watermark_rule(t):
    out = _run(t, red_stream.tumbling_red(_event_stream(t), t.settings, "1 hour"), "watermark")
    return out.groupBy("endpoint_id").agg(F.max("time").alias("newest_scored"))


SIGNAL_COLUMNS = ("endpoint_id", "service", "time", "signal_type", "anomaly", "severity", "score", "raw_value", "layer")


@query("alert_state_machine", ("log",), f"""
    SELECT endpoint_id, signal_type, {stamp('time')}, prev_state, state, CAST(pc AS BIGINT) AS pending_count, CAST(rc AS BIGINT) AS resolving_count,
           {stamp('pending_since')}, {stamp('opened_at')}, {stamp('resolved_at')} FROM log""")
def alert_state_machine(t):
    return t.log.select(
        "endpoint_id", "signal_type", "time", "prev_state", "state", "pending_count", "resolving_count",
        "pending_since", "opened_at", "resolved_at",
    )


@query("alert_state_machine_compat", ("log_compat",), f"""
    SELECT endpoint_id, signal_type, {stamp('time')}, prev_state, state, CAST(rc AS BIGINT) AS resolving_count FROM log_compat""")
def alert_state_machine_compat(t):
    s = replace(t.settings, compat_resolving=True)
    log = alerts.alert_log(scoring.signals(t.scored), s)
    return log.select("endpoint_id", "signal_type", "time", "prev_state", "state", "resolving_count")


@query("alert_state_machine_stream", ("log",), f"""
    SELECT endpoint_id, signal_type, {stamp('time')}, prev_state, state, CAST(pc AS BIGINT) AS pending_count, CAST(rc AS BIGINT) AS resolving_count,
           {stamp('pending_since')}, {stamp('opened_at')}, {stamp('resolved_at')} FROM log""")
def alert_state_machine_stream(t):
    path = tables.fresh_path(t.spark, "signals")
    rows = scoring.signals(t.scored)
    rows.write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    log = _run(t, alert_stream.alert_stream(stream, t.settings), "log")
    return log.select(
        "endpoint_id", "signal_type", "time", "prev_state", "state", "pending_count", "resolving_count",
        "pending_since", "opened_at", "resolved_at",
    )


@query("rolling_window_stream", ("derived",), f"""
    SELECT endpoint_id, {stamp('time')}, CAST(window_rows AS BIGINT) AS window_rows, {num('latency_slope')}, {num('rps_delta')}, {num('baseline_dev_p99')} FROM derived""")
def rolling_window_stream(t):
    from ..operators.baseline import with_baseline

    path = tables.fresh_path(t.spark, "feature-stream")
    t.features.write.parquet(path)
    stream = t.spark.readStream.schema(t.features.schema).parquet(path)
    windows = _run(t, alert_stream.rolling_window_stream(stream, t.settings), "rolling")
    out = features.from_window(with_baseline(windows, t.baseline), t.settings)
    return out.select("endpoint_id", "time", "window_rows", "latency_slope", "rps_delta", "baseline_dev_p99")


BLOCKS["hold_input"] = (("scored",), """
    SELECT *, row_number() OVER (PARTITION BY endpoint_id, signal_type ORDER BY time) AS seq FROM (
      SELECT endpoint_id, 'p99_ms' AS signal_type, time, CASE WHEN anomaly THEN 1 WHEN combined >= 0.2 THEN 2 ELSE 0 END AS a FROM scored
      UNION ALL SELECT endpoint_id, 'error_rate_5xx', time, CASE WHEN error_rate_5xx > slo_error_rate_5xx THEN 1 ELSE 0 END FROM scored)""")
BLOCKS["gated_hold"] = (("hold_input",), """
    SELECT endpoint_id, signal_type, seq, time, 'ok' AS prev_state, CASE WHEN a = 1 THEN 'pending' ELSE 'ok' END AS state, 0 AS n FROM hold_input WHERE seq = 1
    UNION ALL
    SELECT endpoint_id, signal_type, seq, time, prev_state, state, CASE WHEN state = prev_state AND state IN ('pending', 'resolving') THEN n + 1
           WHEN state = 'resolving' THEN 1 ELSE 0 END
    FROM (SELECT i.endpoint_id, i.signal_type, i.seq, i.time, g.state AS prev_state, g.n,
                 CASE g.state WHEN 'ok' THEN CASE WHEN a = 1 THEN 'pending' ELSE 'ok' END
                   WHEN 'pending' THEN CASE WHEN a <> 1 THEN 'ok' WHEN g.n >= 1 THEN 'firing' ELSE 'pending' END
                   WHEN 'firing' THEN CASE WHEN a = 0 THEN 'resolving' ELSE 'firing' END
                   ELSE CASE WHEN a > 0 THEN 'firing' WHEN g.n >= 2 THEN 'ok' ELSE 'resolving' END END AS state
          FROM gated_hold g JOIN hold_input i ON i.endpoint_id = g.endpoint_id AND i.signal_type = g.signal_type AND i.seq = g.seq + 1)""")


@query("score_stream", ("scored",), f"""
    SELECT endpoint_id, {stamp('time')}, direction, {num('combined')}, anomaly, layer, severity FROM scored""")
def score_stream(t):
    path = tables.fresh_path(t.spark, "feature-stream")
    t.features.write.parquet(path)
    stream = t.spark.readStream.schema(t.features.schema).parquet(path)
    scored = alert_stream.score_stream(stream, t.baseline, t.slos, t.model, t.settings)
    columns = ["endpoint_id", "time", "direction", "combined", "anomaly", "layer", "severity"]
    return _run(t, scored.select(*columns), "scores")


@query("alert_clear_threshold", ("gated_hold",), f"SELECT endpoint_id, signal_type, {stamp('time')}, state, prev_state FROM gated_hold")
def alert_clear_threshold(t):
    # an open latency alert holds while the score is at least 0.2
    log = alerts.alert_log(scoring.signals(t.scored), replace(t.settings, clear_threshold=0.2))
    return log.select("endpoint_id", "signal_type", "time", "state", "prev_state")


@query("state_audit", ("log",), """
    SELECT endpoint_id, signal_type, state AS decided_state, 'firing' AS stored_state FROM
      (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY endpoint_id, signal_type ORDER BY time DESC) = 1)
    WHERE endpoint_id LIKE 'POST%' AND state <> 'firing'
    UNION ALL
    SELECT endpoint_id, signal_type, state, 'absent' FROM
      (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY endpoint_id, signal_type ORDER BY time DESC) = 1)
    WHERE endpoint_id LIKE '%{order_id}' AND state <> 'ok'""")
def state_audit(t):
    decided = alerts.current_alerts(t.log)
    broken = decided.where(~F.col("endpoint_id").like("%{order_id}")).withColumn(
        "state", F.when(F.col("endpoint_id").like("POST%"), "firing").otherwise(F.col("state"))
    )
    return alerts.state_audit(broken, decided).select("endpoint_id", "signal_type", "decided_state", "stored_state")


@query("alert_episodes", ("episodes",), f"""
    SELECT endpoint_id, signal_type, service, {stamp('pending_since')}, {stamp('opened_at')}, {stamp('resolved_at')}, state,
           {num('peak_score')}, severity, {num('score')}, {num('raw_value')}, layer FROM episodes""")
def alert_episodes(t):
    return t.episodes.drop("alert_id")


@query("stream_deploy_join", ("episodes", "deploys"), f"""
    SELECT e.endpoint_id, e.signal_type, {stamp('e.opened_at')}, d.deploy_id FROM episodes e
    JOIN deploys d ON d.deployed_at BETWEEN e.opened_at - INTERVAL 12 HOUR AND e.opened_at""")
def stream_deploy_join(t):
    fired_path, deploy_path = tables.fresh_path(t.spark, "fired"), tables.fresh_path(t.spark, "deploys")
    fired = t.episodes.select("alert_id", "endpoint_id", "signal_type", "service", "opened_at")
    fired.write.parquet(fired_path)
    t.deploys.write.parquet(deploy_path)
    joined = alert_stream.deploy_join_stream(
        t.spark.readStream.schema(fired.schema).parquet(fired_path),
        t.spark.readStream.schema(t.deploys.schema).parquet(deploy_path), t.settings,
    )
    return _run(t, joined, "deploy-join").select("endpoint_id", "signal_type", "opened_at", "deploy_id")


@query("stream_dedup", ("spans",), "SELECT endpoint_id, count(*) AS spans FROM spans GROUP BY ALL")
def stream_dedup(t):
    once = _event_stream(t).select("span_id", "ts", "endpoint_id")
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = _run(t, red_stream.deduplicated(twice), "dedup")
    return out.groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("spans"))


@query("silence", ("episodes", "injections"), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')} FROM episodes e WHERE NOT EXISTS
      (SELECT 1 FROM injections i WHERE i.target_endpoint = e.endpoint_id AND e.opened_at BETWEEN i.injected_at AND i.cleared_at)""")
def silence(t):
    windows = t.injections.select(
        F.col("target_endpoint").alias("endpoint_id"), F.col("injected_at").alias("silent_from"), F.col("cleared_at").alias("silent_to")
    )
    return alerts.silence(t.episodes, windows, bucket_seconds=BUCKET).select("endpoint_id", "signal_type", "opened_at")


@query("escalation", ("log",), f"""
    SELECT endpoint_id, signal_type, {stamp('time')}, severity FROM
     (SELECT *, max(r) OVER (PARTITION BY endpoint_id, signal_type, opened_at ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM (SELECT *, CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS r FROM log WHERE state = 'firing'))
    WHERE r > before""")
def escalation(t):
    return alerts.escalations(t.log).select("endpoint_id", "signal_type", "time", "severity")


@query("cardinality_guard", (), """
    WITH RECURSIVE s AS (SELECT CASE WHEN user_id % 13 = 0 THEN 'quarantine' ELSE 'GET /u/' || CAST(user_id AS VARCHAR) END AS endpoint_id FROM events),
    k AS (SELECT endpoint_id FROM s GROUP BY 1 ORDER BY count(*) DESC, endpoint_id LIMIT 20)
    SELECT CASE WHEN endpoint_id IN (SELECT endpoint_id FROM k) THEN endpoint_id ELSE 'other' END AS endpoint_id, count(*) AS spans FROM s GROUP BY 1""")
def cardinality_guard(t):
    s = t.events.select(
        F.when(F.col("user_id") % 13 > 0, F.concat(F.lit("/u/"), "user_id")).alias("route"),
        F.concat(F.lit("GET /u/"), "user_id").alias("endpoint_id"),
    )
    return red.cap_endpoints(red.quarantine_missing_route(s), 20).groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("spans"))


@query("cardinality_guard_stream")
def cardinality_guard_stream(t):
    """The busiest endpoints of the stream, from summaries of 500 names a shard."""
    spans = t.spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    spans = spans.select(
        "event_id", F.when(F.col("user_id") % 13 > 0, F.concat(F.lit("GET /u/"), "user_id")).alias("endpoint_id")
    )
    summaries = heavy_hitters.endpoint_summaries(spans, "event_id", capacity=500, shards=8)
    return heavy_hitters.busiest(_run(t, summaries, "summaries"), 20)


# --------------------------------------------------------------------------- attribution and graph


@query("imputation_score", ("spans", "injections"), f"""
    SELECT span_id, source_file, {num('''CASE WHEN ts BETWEEN injected_at AND cleared_at THEN 1.0
        WHEN ts < injected_at THEN 1.0 - (epoch_us(injected_at) - epoch_us(ts)) / 43200e6
        ELSE 1.0 - (epoch_us(ts) - epoch_us(cleared_at)) / 43200e6 END''', 'score')}
    FROM spans JOIN injections ON ts BETWEEN injected_at - INTERVAL 12 HOUR AND cleared_at + INTERVAL 12 HOUR""")
def imputation_score(t):
    from ..functions.scalars import plus_seconds
    from ..operators.joins import interval_join

    wide = t.injections.select(
        "source_file", "injected_at", "cleared_at", plus_seconds("injected_at", -12 * HOUR).alias("a"), plus_seconds("cleared_at", 12 * HOUR).alias("b")
    )
    pairs = interval_join(t.spans.select("span_id", "ts"), wide, "ts", "a", "b", (), "inner", BUCKET)
    return pairs.select("span_id", "source_file", attribution.imputation_score("ts", "injected_at", "cleared_at", 12 * HOUR).alias("score"))


@query("fault_attribution", ("attributed",), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')}, suspected_fault, {num('imputation_score')} FROM attributed""")
def fault_attribution(t):
    return t.attributed.select("endpoint_id", "signal_type", "opened_at", "suspected_fault", "imputation_score")


@query("deploy_attribution", ("attributed",), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')}, suspected_deploy_id, deploy_version, {num('deploy_score')} FROM attributed""")
def deploy_attribution(t):
    return t.attributed.select("endpoint_id", "signal_type", "opened_at", "suspected_deploy_id", "deploy_version", "deploy_score")


BLOCKS["reachable"] = (("edges",), """
    SELECT parent_endpoint_id AS root, child_endpoint_id AS endpoint_id, child_service AS service, call_type, 1 AS depth,
           parent_endpoint_id || '>' || child_endpoint_id AS path FROM edges
    UNION
    SELECT r.root, e.child_endpoint_id, e.child_service, e.call_type, r.depth + 1, r.path || '>' || e.child_endpoint_id
    FROM reachable r JOIN edges e ON e.parent_endpoint_id = r.endpoint_id
    WHERE r.depth < 3 AND NOT contains('>' || r.path || '>', '>' || e.child_endpoint_id || '>')""")
_PAST = "b.detected_at >= a.detected_at - INTERVAL 60 HOUR AND b.detected_at < a.detected_at"
BLOCKS["seen"] = (("anomalies", "reachable"), f"""
    SELECT a.endpoint_id AS root, a.detected_at, r.endpoint_id, r.service, r.call_type, r.depth, r.path,
           arg_max(round_even(b.score, 4), b.detected_at) AS anomaly_score, arg_max(b.direction, b.detected_at) AS direction
    FROM anomalies a JOIN reachable r ON r.root = a.endpoint_id
    LEFT JOIN anomalies b ON b.endpoint_id = r.endpoint_id AND {_PAST} GROUP BY ALL""")
BLOCKS["rca"] = (("seen",), """
    SELECT *, CASE WHEN confidence_score >= 0.7 THEN 'high' WHEN confidence_score >= 0.35 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT *, round_even(least(0.95, anomaly_score * CASE call_type WHEN 'direct' THEN 1.0 WHEN 'cascade' THEN 0.7 ELSE 0.75 END * (1.0 / depth)), 2) AS confidence_score
          FROM seen WHERE direction = 'degradation' AND anomaly_score IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY root, detected_at, endpoint_id ORDER BY confidence_score DESC, depth, path DESC) = 1""")


@query("graph_descendants", ("anomalies", "reachable"), """
    SELECT r.root, r.endpoint_id, r.service, r.call_type, CAST(r.depth AS BIGINT) AS depth, r.path, count(*) AS cycles
    FROM reachable r JOIN anomalies a ON a.endpoint_id = r.root GROUP BY ALL""")
def graph_descendants(t):
    d = graph.descendants(t.edges).withColumn("path", F.array_join("path", ">"))
    cycles = t.scored.groupBy(F.col("endpoint_id").alias("root")).agg(F.count(F.lit(1)).alias("cycles"))
    return d.join(cycles, "root").select("root", "endpoint_id", "service", "call_type", "depth", "path", "cycles")


@query("graph_parents", ("anomalies", "edges"), """
    SELECT e.child_endpoint_id AS root, e.parent_endpoint_id AS endpoint_id, e.call_type, count(*) AS cycles
    FROM edges e JOIN anomalies a ON a.endpoint_id = e.child_endpoint_id GROUP BY ALL""")
def graph_parents(t):
    cycles = t.scored.groupBy(F.col("endpoint_id").alias("root")).agg(F.count(F.lit(1)).alias("cycles"))
    return graph.parents(t.edges).join(cycles, "root").select("root", "endpoint_id", "call_type", "cycles")


def _seen(t):
    a = t.anomalies.select("endpoint_id", "detected_at", "score", "direction")
    return graph.neighbour_scores(a, graph.descendants(t.edges), a, t.settings)


@query("rca_confidence", ("seen",), f"""
    SELECT root, {stamp('detected_at')}, endpoint_id, CAST(depth AS BIGINT) AS depth,
           {num("round_even(least(0.95, anomaly_score * CASE call_type WHEN 'direct' THEN 1.0 WHEN 'cascade' THEN 0.7 ELSE 0.75 END * (1.0 / depth)), 2)", 'confidence_score')} FROM seen""")
def rca_confidence(t):
    return _seen(t).select(
        "root", "detected_at", "endpoint_id", "depth",
        graph.rca_confidence_score("anomaly_score", "call_type", "depth", t.settings).alias("confidence_score"),
    )


@query("root_cause_candidates", ("rca",), f"""
    SELECT root, {stamp('detected_at')}, endpoint_id, call_type, CAST(depth AS BIGINT) AS depth, {num('anomaly_score')}, {num('confidence_score')}, confidence FROM rca""")
def root_cause_candidates(t):
    return graph.root_cause_candidates(_seen(t), t.settings).select(
        "root", "detected_at", "endpoint_id", "call_type", "depth", "anomaly_score", "confidence_score", "confidence"
    )


@query("rca_reason", ("rca",), f"""
    SELECT root, {stamp('detected_at')}, endpoint_id, confidence || ' evidence, ' || call_type || ' call at distance ' || CAST(depth AS VARCHAR) || ', unproven' AS reason FROM rca""")
def rca_reason(t):
    return graph.root_cause_candidates(_seen(t), t.settings).select("root", "detected_at", "endpoint_id", "reason")


@query("sort_by_confidence", ("rca",), f"""
    SELECT root, {stamp('detected_at')}, string_agg(endpoint_id, '|' ORDER BY confidence_score DESC, endpoint_id) AS ordered FROM rca GROUP BY root, detected_at""")
def sort_by_confidence(t):
    a = t.anomalies.select("endpoint_id", "detected_at", "score", "direction")
    g = graph.service_graph(a, t.edges, a, t.settings).where(F.size("root_cause_candidates") > 0)
    ordered = F.array_join(F.transform("root_cause_candidates", lambda c: c["endpoint_id"]), "|")
    return g.select(F.col("endpoint_id").alias("root"), "detected_at", ordered.alias("ordered"))


@query("service_graph", ("anomalies", "edges", "rca"), f"""
    SELECT a.endpoint_id, {stamp('a.detected_at')},
           coalesce((SELECT min(child_service) FROM edges WHERE child_endpoint_id = a.endpoint_id), (SELECT min(parent_service) FROM edges WHERE parent_endpoint_id = a.endpoint_id)) AS service,
           (SELECT count(*) FROM edges WHERE parent_endpoint_id = a.endpoint_id) AS children,
           (SELECT count(*) FROM edges WHERE child_endpoint_id = a.endpoint_id) AS parents,
           (SELECT count(*) FROM rca r WHERE r.root = a.endpoint_id AND r.detected_at = a.detected_at) AS candidates
    FROM anomalies a""")
def service_graph(t):
    a = t.anomalies.select("endpoint_id", "detected_at", "score", "direction")
    g = graph.service_graph(a, t.edges, a, t.settings)
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return g.select(
        "endpoint_id", "detected_at", "service", n("children").alias("children"), n("parents").alias("parents"),
        n("root_cause_candidates").alias("candidates"),
    )


@query("status_label", ("seen",), f"""
    SELECT root, {stamp('detected_at')}, endpoint_id, CASE direction WHEN 'degradation' THEN 'degraded' WHEN 'improvement' THEN 'improved' WHEN 'normal' THEN 'normal' ELSE 'unknown' END AS status FROM seen""")
def status_label(t):
    return _seen(t).select("root", "detected_at", "endpoint_id", status_of_direction("direction").alias("status"))
