"""Queries on sources, sinks, projections, joins, aggregations and windows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import PII_ATTRIBUTES, PRODUCTION
from ..functions.ordered import running_totals, time_bin
from ..functions.scalars import (
    clean_round, cycle_start, day_of_week, direction_of, endpoint_id, magnitude_label,
    one_sided_deviation, plus_seconds, signed_deviation, half_even,
)
from ..operators import alerts, attribution, baseline, evaluation, features, graph, red, scoring, selfobs
from ..operators.baseline_state import BaselineState
from ..operators.joins import asof_latest, interval_join
from ..schemas import FEATURES as FEATURES_DDL
from ..sources import ground_truth, tables, telemetry
from .fixture import AS_OF, BUCKET, HOUR, INJECTION_ROWS, at
from .registry import query
from .sql import BLOCKS, LOOKUP, METRICS, num, stamp

DIMS = ("endpoint_id", "service", "status_code", "span_kind")


# --------------------------------------------------------------------------- sources and sinks


@query("spans_source", ("spans",), f"""
    SELECT span_id, {stamp('ts')}, service, method, route, status_code, {num('latency_ms')} FROM spans""")
def spans_source(t):
    return t.spans.select("span_id", "ts", "service", "method", "route", "status_code", "latency_ms")


@query("redact_attrs", (), """
    SELECT event_id AS span_id, json_extract_string(props, '$.k') AS k, CAST(1 AS BIGINT) AS attrs_left, false AS has_user FROM events""")
def redact_attrs(t):
    r = telemetry.redact_attrs(t.spans, PII_ATTRIBUTES)
    return r.select(
        "span_id", F.element_at("attrs", "k").alias("k"), F.size("attrs").alias("attrs_left"),
        F.map_contains_key("attrs", "user.id").alias("has_user"),
    )


def _samples(t):
    """Metric samples from events: two routes of two services, a few without a route label."""
    return t.events.select(
        cycle_start("ts", 6 * HOUR).alias("ts"),
        F.lit("calls").alias("metric"),
        F.map_filter(
            F.create_map(
                F.lit("service_name"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")),
                F.lit("http_route"), F.when(F.col("user_id") % 5 > 0, F.col("event_type")),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("labels"),
        "value",
    )


@query("samples_source", (), f"""
    SELECT strftime(make_timestamp(epoch_us(ts) // 21600000000 * 21600000000), '%Y-%m-%d %H:%M:%S') AS ts,
           's' || CAST(user_id % 3 AS VARCHAR) AS service,
           CASE WHEN user_id % 5 > 0 THEN event_type ELSE '' END AS route, {num('sum(value)', 'value')}
    FROM events GROUP BY 1, 2, 3""")
def samples_source(t):
    return telemetry.samples_by_route(_samples(t))


def _truth_files(t):
    """Ground-truth bodies from events: a list, an object or a cut-off text, one file per 50 events."""
    e = t.events.withColumn("f", F.floor(F.col("event_id") / 50))
    entry = F.to_json(F.struct(
        F.concat(F.lit("s"), F.col("user_id") % 7).alias("scenario_id"),
        F.col("event_type").alias("fault_type"),
        F.lit("GET /orders").alias("target_endpoint"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("injected_at"),
        F.when(
            F.col("user_id") % 11 > 0,
            F.date_format(F.col("ts") + F.expr("INTERVAL 10 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"),
        ).alias("cleared_at"),
    ))
    g = e.groupBy("f").agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("list"))
    kind = F.col("f") % 3
    body = (
        F.when(kind == 0, F.concat(F.lit("["), "list", F.lit("]")))
        .when(kind == 1, F.concat(F.lit('{"scenario_id":"file","faults":['), "list", F.lit("]}")))
        .otherwise(F.concat(F.lit("["), F.expr("substring(list, 1, length(list) - 20)")))
    )
    return g.select(F.concat(F.lit("run_"), "f", F.lit(".json")).alias("source_file"), body.alias("body"))


@query("ground_truth_source", (), f"""
    SELECT 's' || CAST(user_id % 7 AS VARCHAR) AS scenario_id, event_type AS fault_type,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS injected_at, strftime(ts + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS cleared_at,
           'run_' || CAST(event_id // 50 AS VARCHAR) || '.json' AS source_file
    FROM events WHERE (event_id // 50) % 3 < 2 AND user_id % 11 > 0""")
def ground_truth_source(t):
    return ground_truth.injections_from(_truth_files(t)).select(
        "scenario_id", "fault_type", "injected_at", "cleared_at", "source_file"
    )


@query("ground_truth_validate", (), """
    SELECT 'run_' || CAST(f AS VARCHAR) || '.json' AS source_file,
           CASE WHEN f % 3 < 2 THEN count(*) ELSE 0 END AS faults,
           CASE WHEN f % 3 < 2 THEN count(*) FILTER (user_id % 11 = 0) ELSE 0 END AS missing_cleared,
           CASE WHEN f % 3 < 2 THEN strftime(max(ts + INTERVAL 10 MINUTE) FILTER (user_id % 11 > 0), '%Y-%m-%d %H:%M:%S') END AS last_cleared_at,
           f % 3 < 2 AND count(*) FILTER (user_id % 11 = 0) = 0 AS valid
    FROM (SELECT *, event_id // 50 AS f FROM events) GROUP BY f""")
def ground_truth_validate(t):
    return ground_truth.validate(_truth_files(t))


FEATURE_COLUMNS = (
    "time", "endpoint_id", "service", "service_tier", "rps", "p50_ms", "p95_ms", "p99_ms",
    "error_rate_5xx", "error_rate_4xx",
)
FEATURE_SQL = ", ".join([
    stamp("time"), "endpoint_id", "service", "service_tier",
    *[num(c) for c in ("rps", "p50_ms", "p95_ms", "p99_ms", "error_rate_5xx", "error_rate_4xx")],
])


@query("features_sink", ("features",), f"SELECT {FEATURE_SQL}, strftime(time, '%Y-%m-%d') AS date FROM features")
def features_sink(t):
    path = tables.fresh_path(t.spark, "features")
    tables.write_features(t.features, path, t.endpoints)
    return t.spark.read.parquet(path).select(*FEATURE_COLUMNS, "date")


@query("endpoint_dim", ("spans",), """
    SELECT endpoint_id, service, service_tier, count(*) AS spans FROM spans GROUP BY ALL""")
def endpoint_dim(t):
    raw = t.spans.select("method", "route").select(endpoint_id("method", "route").alias("endpoint_id"))
    return raw.join(t.endpoints, "endpoint_id").groupBy("endpoint_id", "service", "service_tier").agg(
        F.count(F.lit(1)).alias("spans")
    )


@query("topology_load", (), """
    SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS parent_endpoint_id,
           'c' || CAST(o_orderkey % 1009 + o_custkey AS VARCHAR) AS child_endpoint_id
    FROM orders WHERE o_orderpriority <> '1-URGENT'
    EXCEPT SELECT 'c' || CAST(o_custkey AS VARCHAR), 'c' || CAST(o_orderkey % 1009 + o_custkey AS VARCHAR)
    FROM orders WHERE o_orderpriority = '1-URGENT'""")
def topology_load(t):
    o = t.table("orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("parent_endpoint_id"),
        F.concat(F.lit("c"), F.col("o_orderkey") % 1009 + F.col("o_custkey")).alias("child_endpoint_id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("stored"),
    )
    return graph.topology_load(o.where("stored").drop("stored"), o.where("not stored").drop("stored"))


# Customers as endpoints, in blocks of ten: calls go down inside a block, the last one calls leaves, some new ones go back.
@query("topology_check", (), """
    WITH RECURSIVE e AS (
      SELECT DISTINCT o_custkey AS p,
             CASE WHEN o_orderkey % 40 = 0 THEN o_custkey - o_custkey % 10 + o_orderkey % 7
                  WHEN o_custkey % 10 = 9 THEN -o_custkey - o_orderkey % 3
                  ELSE o_custkey + least(1 + o_orderkey % 3, 9 - o_custkey % 10) END AS c, o_orderkey % 40 = 0 AS fresh
      FROM orders),
    reach(origin, node) AS (
      SELECT DISTINCT c, c FROM e WHERE fresh
      UNION SELECT r.origin, e.c FROM reach r JOIN e ON e.p = r.node)
    SELECT DISTINCT 'c' || CAST(p AS VARCHAR) AS parent_endpoint_id, 'c' || CAST(c AS VARCHAR) AS child_endpoint_id,
           CASE WHEN p = c THEN 'self-loop' ELSE 'cycle' END AS reason
    FROM e WHERE fresh AND (p = c OR EXISTS (SELECT 1 FROM reach r WHERE r.origin = e.c AND r.node = e.p))""")
def topology_check(t):
    o = t.table("orders")
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    back = order % 40 == 0
    down = F.when(cust % 10 == 9, -cust - order % 3).otherwise(cust + F.least(1 + order % 3, 9 - cust % 10))
    child = F.when(back, cust - cust % 10 + order % 7).otherwise(down)
    e = o.select(
        F.concat(F.lit("c"), cust).alias("parent_endpoint_id"),
        F.concat(F.lit("c"), child).alias("child_endpoint_id"),
        back.alias("fresh"),
    ).distinct()
    return graph.topology_check(e.where("not fresh").drop("fresh"), e.where("fresh").drop("fresh"))


def _releases(t):
    """Deploy events from orders: one release per order of a nation-sized group of customers."""
    return t.table("orders").select(
        F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("r"), "o_orderkey")).alias("deploy_id"),
        F.concat(F.lit("svc"), F.col("o_custkey") % 5).alias("service"),
        F.concat(F.lit("v"), F.col("o_orderkey")).alias("version"),
        F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate").cast("timestamp")).alias("deployed_at"),
    )


@query("deploy_append", (), """
    SELECT service, version, strftime(coalesce(deployed_at, TIMESTAMP '2024-01-31'), '%Y-%m-%d %H:%M:%S') AS deployed_at,
           CASE WHEN o_orderkey % 7 > 0 THEN 'r' || CAST(o_orderkey AS VARCHAR)
                ELSE sha256(service || '|' || version || '|' || CAST(epoch_us(coalesce(deployed_at, TIMESTAMP '2024-01-31')) AS VARCHAR)) END AS deploy_id
    FROM (SELECT o_orderkey, 'svc' || CAST(o_custkey % 5 AS VARCHAR) AS service, 'v' || CAST(o_orderkey AS VARCHAR) AS version,
                 CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS deployed_at FROM orders)""")
def deploy_append(t):
    return tables.deploy_rows(_releases(t), t.as_of).select("service", "version", "deployed_at", "deploy_id")


@query("deploy_list", (), """
    SELECT 'v' || CAST(o_orderkey AS VARCHAR) AS version, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS deployed_at
    FROM orders WHERE o_custkey % 5 = 2 AND o_orderkey % 9 > 0 AND o_orderkey % 7 > 0
      AND o_orderdate BETWEEN TIMESTAMP '1998-01-01' - INTERVAL 400 DAY AND TIMESTAMP '1998-01-01'
    ORDER BY o_orderdate DESC, 'r' || CAST(o_orderkey AS VARCHAR) LIMIT 50""")
def deploy_list(t):
    r = _releases(t).where(F.col("deploy_id").isNotNull())
    return tables.recent_deploys(r, at(datetime(1998, 1, 1)), "svc2", 400 * 1440, 50).select("version", "deployed_at")


@query("anomaly_sink", ("scored",), f"""
    SELECT endpoint_id, {stamp('time', 'detected_at')}, {num('round_even(combined, 4)', 'score')},
           coalesce(layer, 'combined') AS layer, direction, {num('round_even(static_norm, 4)', 'static_score')},
           {num('round_even(baseline_norm, 4)', 'baseline_score')} FROM scored""")
def anomaly_sink(t):
    path = tables.fresh_path(t.spark, "anomalies")
    tables.write_anomalies(t.anomalies, path)
    return t.spark.read.parquet(path).select(
        "endpoint_id", "detected_at", "score", "layer", "direction",
        F.col("contributing.layers.static").alias("static_score"),
        F.col("contributing.layers.baseline").alias("baseline_score"),
    )


@query("json_safe", (), f"""
    SELECT event_id, {num("CASE WHEN user_id % 10 < 2 THEN NULL ELSE value END", 'value')},
           CASE WHEN user_id % 10 < 2 THEN 1 ELSE 0 END AS nulls FROM events""")
def json_safe(t):
    v = (
        F.when(F.col("user_id") % 10 == 0, F.lit(float("nan")))
        .when(F.col("user_id") % 10 == 1, F.lit(float("inf")))
        .otherwise(F.col("value"))
    )
    df = t.events.select("event_id", v.alias("value"), F.array(v, F.lit(1.0)).alias("pair"))
    safe = tables.json_safe(df, "value", "pair")
    return safe.select(
        "event_id", "value", F.size(F.filter("pair", lambda x: x.isNull())).alias("nulls")
    )


LOG_COLUMNS = (
    "endpoint_id", "signal_type", "state", "pending_count", "resolving_count", "pending_since",
    "opened_at", "resolved_at", "score", "raw_value",
)
LOG_SQL = ", ".join([
    "endpoint_id", "signal_type", "state", "CAST(pc AS BIGINT) AS pending_count",
    "CAST(rc AS BIGINT) AS resolving_count", stamp("pending_since"), stamp("opened_at"), stamp("resolved_at"),
    num("score"), num("raw_value"),
])


@query("alert_upsert", ("log",), f"""
    SELECT {LOG_SQL}, severity, layer, {stamp('time', 'updated_at')} FROM (SELECT *, evidence.s AS score, evidence.r AS raw_value, evidence.v AS severity, evidence.l AS layer FROM (
      SELECT * EXCLUDE (score, raw_value, severity, layer), coalesce(last_value(CASE WHEN anomaly THEN {{'s': score, 'r': raw_value, 'v': severity, 'l': layer}} END IGNORE NULLS) OVER w,
             {{'s': score, 'r': raw_value, 'v': severity, 'l': layer}}) AS evidence FROM log
      WINDOW w AS (PARTITION BY endpoint_id, signal_type ORDER BY time)))
    WHERE (endpoint_id, signal_type) IN (SELECT (endpoint_id, signal_type) FROM log WHERE state <> 'ok')
    QUALIFY row_number() OVER (PARTITION BY endpoint_id, signal_type ORDER BY time DESC) = 1""")
def alert_upsert(t):
    cut = at(datetime(2024, 1, 20))
    old = alerts.current_alerts(t.log.where(F.col("time") < cut))
    new = alerts.current_alerts(t.log)
    return alerts.upsert_current(old, new).select(*LOG_COLUMNS, "severity", "layer", "updated_at")


@query("alert_history", ("log",), f"""
    SELECT endpoint_id, signal_type, {stamp('time', 'fired_at')}, prev_state, severity, {num('score')}
    FROM log WHERE state = 'firing' AND prev_state IS DISTINCT FROM 'firing'""")
def alert_history(t):
    return alerts.alert_history(t.log).select(
        "endpoint_id", "signal_type", F.col("time").alias("fired_at"), "prev_state", "severity", "score"
    )


@query("baseline_upsert", ("baseline",), f"""
    SELECT endpoint_id, metric, dow, hour_bucket, {num('p50')}, CAST(sample_count AS BIGINT) AS sample_count FROM baseline""")
def baseline_upsert(t):
    # the old table has other values for the same buckets; all of them are replaced
    old = t.baseline.withColumn("p50", F.col("p50") + 1).withColumn("sample_count", F.lit(1).cast("bigint"))
    return tables.upsert_baseline(old, t.baseline).select(
        "endpoint_id", "metric", "dow", "hour_bucket", "p50", "sample_count"
    )


@query("retention", ("spans",), """
    SELECT endpoint_id, CAST(count(*) AS BIGINT) AS spans, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest
    FROM spans WHERE CAST(ts AS DATE) >= DATE '2024-01-21' AND CAST(ts AS DATE) < DATE '2024-01-24' GROUP BY ALL""")
def retention(t):
    from dataclasses import replace

    s = replace(t.settings, retention_days=10, compact_after_days=7)
    kept = tables.within_retention(t.spans, t.as_of, s, "ts")
    return tables.compact_old(kept, t.as_of, s, "ts").groupBy("endpoint_id").agg(
        F.count(F.lit(1)).alias("spans"), F.min("ts").alias("oldest")
    )


# --------------------------------------------------------------------------- projections, filters


@query("endpoint_id", (), """
    SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END || ' /' || event_type AS endpoint_id FROM events""")
def endpoint_id_query(t):
    e = t.events.withColumn("method", F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST"))
    return e.select("event_id", endpoint_id("method", F.concat(F.lit("/"), "event_type")).alias("endpoint_id"))


def _holes(t):
    """Features with gaps: NaN p99 in thin cycles, null p99 in every fifth one."""
    hole = F.when(F.col("span_count") < 12, F.lit(float("nan"))).when(
        F.floor(F.unix_seconds("time") / (6 * HOUR)) % 5 == 0, F.lit(None)
    ).otherwise(F.col("p99_ms"))
    return t.features.withColumn("p99_ms", hole)


BLOCKS["holes"] = (("features",), """
    SELECT * EXCLUDE (p99_ms), CASE WHEN span_count < 12 OR (epoch_us(time) // 21600000000) % 5 = 0 THEN NULL ELSE p99_ms END AS p99_ms
    FROM features""")


@query("finite_filter", ("holes",), f"SELECT endpoint_id, {stamp('time')}, {num('p99_ms')} FROM holes WHERE p99_ms IS NOT NULL")
def finite_filter(t):
    return red.valid_features(_holes(t)).select("endpoint_id", "time", "p99_ms")


@query("lookback_filter", ("features",), f"""
    SELECT endpoint_id, {stamp('time')}, {num('p99_ms')} FROM features WHERE time >= TIMESTAMP '2024-01-17'""")
def lookback_filter(t):
    # from the date-partitioned table, so that older partitions are not read at all
    path = tables.fresh_path(t.spark, "features")
    tables.write_features(t.features, path)
    recent = tables.read_range(t.spark, path, FEATURES_DDL, "time", datetime(2024, 1, 17))
    return baseline.lookback(recent, t.as_of, 14).select("endpoint_id", "time", "p99_ms")


@query("span_filter", ("features", "injections"), f"""
    SELECT endpoint_id, {stamp('time')} FROM features
    WHERE time BETWEEN (SELECT min(injected_at) FROM injections) - INTERVAL 10 MINUTE AND (SELECT max(cleared_at) FROM injections) + INTERVAL 10 MINUTE""")
def span_filter(t):
    return evaluation.in_span(t.features, t.injections, t.settings.pad_seconds).select("endpoint_id", "time")


@query("status_class", ("spans",), """
    SELECT status_code // 100 AS class, count(*) AS n FROM spans WHERE regexp_matches(CAST(status_code AS VARCHAR), '^[45]..$') GROUP BY 1""")
def status_class(t):
    return red.server_spans(t.spans).where(F.col("status_code").cast("string").rlike("^[45]..$")).groupBy(
        F.floor(F.col("status_code") / 100).cast("bigint").alias("class")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("drop_incomplete", ("usable",), f"SELECT endpoint_id, {stamp('time')} FROM usable")
def drop_incomplete(t):
    return red.drop_incomplete(t.features).select("endpoint_id", "time")


@query("in_list", ("anomalies", "edges"), f"""
    SELECT endpoint_id, {stamp('detected_at')} FROM anomalies WHERE endpoint_id IN (SELECT child_endpoint_id FROM edges)""")
def in_list(t):
    wanted = t.edges.select(F.col("child_endpoint_id").alias("endpoint_id"))
    return t.scored.join(wanted, "endpoint_id", "left_semi").select("endpoint_id", F.col("time").alias("detected_at"))


@query("null_safe_ne", ("log",), """
    SELECT prev_state, state, count(*) AS n FROM log WHERE prev_state IS DISTINCT FROM state GROUP BY ALL""")
def null_safe_ne(t):
    return alerts.transitions(t.log).groupBy("prev_state", "state").agg(F.count(F.lit(1)).alias("n"))


@query("active_alerts", ("log",), """
    SELECT endpoint_id, state, CAST(pc AS BIGINT) AS pending_count FROM (
      SELECT * FROM log WHERE time <= TIMESTAMP '2024-01-13' QUALIFY row_number() OVER (PARTITION BY endpoint_id, signal_type ORDER BY time DESC) = 1)
    WHERE signal_type = 'error_rate_5xx' AND (state <> 'ok' OR pc > 0)""")
def active_alerts(t):
    then = at(datetime(2024, 1, 13))
    current = alerts.current_alerts(t.log.where(F.col("time") <= then))
    return alerts.not_at_rest(current).select("endpoint_id", "state", "pending_count")


@query("json_extract", (), f"""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props LIKE '%"k"%' AS has_k FROM events""")
def json_extract(t):
    doc = F.from_json("props", "k bigint")
    return t.events.select("event_id", doc["k"].alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"))


@query("magnitude_label", (), """
    SELECT CASE WHEN contains(f, 'stress') THEN 'stress' WHEN contains(f, 'core') THEN 'core' ELSE 'all' END AS magnitude, count(*) AS n
    FROM (SELECT lower(CASE user_id % 4 WHEN 0 THEN 'a_Stress_core' WHEN 1 THEN 'b_CORE' ELSE event_type END) AS f FROM events) GROUP BY 1""")
def magnitude(t):
    name = F.when(F.col("user_id") % 4 == 0, "a_Stress_core").when(F.col("user_id") % 4 == 1, "b_CORE").otherwise(F.col("event_type"))
    return t.events.select(magnitude_label(name).alias("magnitude")).groupBy("magnitude").agg(F.count(F.lit(1)).alias("n"))


@query("slo_lookup", ("features", "slos"), f"""
    SELECT f.endpoint_id, {stamp('time')}, {num('coalesce(l.slo_p99_ms, 500.0)', 'slo_p99_ms')}, {num('coalesce(l.slo_error_rate_5xx, 10.0)', 'slo_error_rate_5xx')}
    FROM features f LEFT JOIN (SELECT * FROM slos WHERE endpoint_id NOT LIKE '%payments') l USING (endpoint_id)""")
def slo_lookup(t):
    some = t.slos.where(~F.col("endpoint_id").like("%payments"))
    return scoring.with_slos(t.features, some).select("endpoint_id", "time", "slo_p99_ms", "slo_error_rate_5xx")


@query("clean_round", (), f"""
    SELECT event_id, {num("CASE WHEN user_id % 10 = 0 THEN NULL ELSE round_even(value / 8, 2) END", 'cleaned')} FROM events""")
def clean_round_query(t):
    v = F.when(F.col("user_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 8)
    return t.events.select("event_id", clean_round(v, 2).alias("cleaned"))


# --------------------------------------------------------------------------- joins


@query("baseline_lookup", ("bands",), "SELECT endpoint_id, " + stamp("time") + ", "
       + ", ".join(num(f"{m}_{p}") for m in LOOKUP for p in ("p10", "p50", "p90")) + " FROM bands")
def baseline_lookup(t):
    rows = baseline.with_baseline(t.features, t.baseline)
    return rows.select(
        "endpoint_id", "time",
        *[F.col(f"b_{m}.{p}").alias(f"{m}_{p}") for m in LOOKUP for p in ("p10", "p50", "p90")],
    )


@query("exclude_injections", ("clean",), f"SELECT endpoint_id, {stamp('time')} FROM clean")
def exclude_injections(t):
    return baseline.exclude_injections(t.features, t.injections, 0, "time", BUCKET).select("endpoint_id", "time")


@query("label_windows", ("spans", "injections"), """
    SELECT span_id, CAST(EXISTS (SELECT 1 FROM injections i WHERE i.target_endpoint = s.endpoint_id
           AND s.ts BETWEEN i.injected_at - INTERVAL 2 MINUTE AND i.cleared_at + INTERVAL 2 MINUTE) AS BIGINT) AS label FROM spans s""")
def label_windows(t):
    from ..operators.supervised import label_windows as label

    return label(t.spans.select("span_id", "endpoint_id", "ts"), t.injections, 120, "ts", BUCKET).select("span_id", "label")


@query("fault_candidates", ("candidates",), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')}, scenario_id, source_file, service_match, {num('round_even(adjusted, 4)', 'imputation_score')}
    FROM candidates""")
def fault_candidates(t):
    e = t.episodes.select("alert_id", "endpoint_id", "signal_type", "opened_at")
    return attribution.fault_candidates(e, t.injections, t.settings, bucket_seconds=BUCKET).select(
        "endpoint_id", "signal_type", "opened_at", "scenario_id", "source_file", "service_match", "imputation_score"
    )


@query("endpoint_match", ("spans", "injections"), """
    SELECT s.endpoint_id, i.source_file, count(*) AS spans,
           bool_or(lower(i.target_endpoint) = lower(s.endpoint_id) OR contains(lower(s.endpoint_id), lower(i.target_endpoint))
             OR contains(lower(i.target_endpoint), lower(s.endpoint_id)) OR contains(lower(s.endpoint_id), lower(i.target_service))) AS matches
    FROM spans s JOIN injections i ON s.ts BETWEEN i.injected_at AND i.cleared_at GROUP BY ALL""")
def endpoint_match_query(t):
    from ..functions.scalars import endpoint_match

    pairs = interval_join(
        t.spans.select("endpoint_id", "ts"), t.injections, "ts", "injected_at", "cleared_at", (), "inner", BUCKET
    )
    m = endpoint_match("target_endpoint", "target_service", "endpoint_id")
    return pairs.groupBy("endpoint_id", "source_file").agg(
        F.count(F.lit(1)).alias("spans"), F.max(m).alias("matches")
    )


@query("deploy_asof", ("deploy_of",), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')}, deploy_id, version, service_match, {num('round_even(adjusted, 4)', 'deploy_score')} FROM deploy_of""")
def deploy_asof(t):
    out = attribution.deploy_attribution(t.episodes, t.deploys, t.settings)
    return out.where(F.col("suspected_deploy_id").isNotNull()).select(
        "endpoint_id", "signal_type", "opened_at", F.col("suspected_deploy_id").alias("deploy_id"),
        F.col("deploy_version").alias("version"), F.col("deploy_service_match").alias("service_match"), "deploy_score",
    )


@query("service_asof", ("spans",), """
    SELECT endpoint_id, arg_max(service || '-' || CAST(user_id % 4 AS VARCHAR), ts) AS service FROM spans GROUP BY 1""")
def service_asof(t):
    s = t.spans.select(
        "endpoint_id", F.col("ts").alias("time"), F.concat_ws("-", "service", (F.col("user_id") % 4).cast("string")).alias("service")
    )
    return attribution.service_of_endpoint(s)


BLOCKS["neighbour_scores"] = (("anomalies", "edges"), """
    SELECT a.endpoint_id AS root, a.detected_at, n.endpoint_id,
           (SELECT arg_max(round_even(b.score, 4), b.detected_at) FROM anomalies b WHERE b.endpoint_id = n.endpoint_id
             AND b.detected_at >= a.detected_at - INTERVAL 60 HOUR AND b.detected_at < a.detected_at) AS anomaly_score,
           (SELECT arg_max(b.direction, b.detected_at) FROM anomalies b WHERE b.endpoint_id = n.endpoint_id
             AND b.detected_at >= a.detected_at - INTERVAL 60 HOUR AND b.detected_at < a.detected_at) AS direction
    FROM anomalies a JOIN (SELECT parent_endpoint_id AS root, child_endpoint_id AS endpoint_id FROM edges
                           UNION SELECT child_endpoint_id, parent_endpoint_id FROM edges
                           UNION SELECT x.parent_endpoint_id, y.child_endpoint_id FROM edges x JOIN edges y ON y.parent_endpoint_id = x.child_endpoint_id) n
      ON n.root = a.endpoint_id""")


@query("neighbour_score_asof", ("neighbour_scores",), f"""
    SELECT root, {stamp('detected_at')}, endpoint_id, {num('anomaly_score')}, direction FROM neighbour_scores""")
def neighbour_score_asof(t):
    a = t.anomalies.select("endpoint_id", "detected_at", "score", "direction")
    return graph.neighbour_scores(a, graph.neighbours(t.edges), a, t.settings).select(
        "root", "detected_at", "endpoint_id", "anomaly_score", "direction"
    )


@query("alert_deploy_join", ("attributed", "deploys"), f"""
    SELECT a.endpoint_id, a.signal_type, {stamp('opened_at')}, coalesce(d.service || ' ' || d.version, '-') AS suspected_deploy,
           {num('round_even(a.score, 2)', 'score')}
    FROM attributed a LEFT JOIN deploys d ON d.deploy_id = a.suspected_deploy_id""")
def alert_deploy_join(t):
    return attribution.alert_deploy_join(t.attributed, t.deploys).select(
        "endpoint_id", "signal_type", "opened_at", "suspected_deploy", half_even("score", 2).alias("score")
    )


# --------------------------------------------------------------------------- aggregations


HIST_SQL = " UNION ALL ".join(
    f"SELECT endpoint_id, service, status_code, time, CAST('{b}' AS DOUBLE) AS le, count(*) FILTER (latency_ms <= CAST('{b}' AS DOUBLE)) AS n FROM spans GROUP BY ALL"
    for b in (2, 4, 6, 8, 10, 50, 100, 200, 400, 800, 1000, 1400, 2000, 5000, 10000, 15000, "inf")
)
BLOCKS["hist"] = (("spans",), HIST_SQL)


@query("span_histogram", ("hist",), f"""
    SELECT endpoint_id, service, status_code, {stamp('time')}, CASE WHEN isinf(le) THEN -1.0 ELSE le END AS le, n FROM hist""")
def span_histogram(t):
    h = red.span_histogram(t.spans, t.settings.cycle_seconds)
    inf = F.col("le") == F.lit(float("inf"))
    return h.select("endpoint_id", "service", "status_code", "time", F.when(inf, -1.0).otherwise(F.col("le")).alias("le"), "n")


@query("sum_by_le", ("hist",), f"""
    SELECT endpoint_id, {stamp('time')}, CASE WHEN isinf(le) THEN -1.0 ELSE le END AS le, CAST(sum(n) AS BIGINT) AS n FROM hist GROUP BY ALL""")
def sum_by_le(t):
    h = red.sum_by_le(red.span_histogram(t.spans, t.settings.cycle_seconds))
    inf = F.col("le") == F.lit(float("inf"))
    return h.select("endpoint_id", "time", F.when(inf, -1.0).otherwise(F.col("le")).alias("le"), "n")


@query("histogram_quantile", ("features",), f"SELECT endpoint_id, {stamp('time')}, {num('p95_ms')} FROM features")
def histogram_quantile(t):
    h = red.sum_by_le(red.span_histogram(t.spans, t.settings.cycle_seconds))
    return red.histogram_quantile(h, 0.95, ("endpoint_id", "time"), "p95_ms")


def _counter(t):
    """A counter that restarts at every 97th span of an endpoint."""
    ranked = running_totals(
        t.spans.select("endpoint_id", "ts", "span_id"), ["endpoint_id"], "ts", {"n": F.lit(1)}, time_bin("ts", 86400)
    )
    return ranked.select("endpoint_id", "ts", (F.col("n") % 97).alias("value"))


BLOCKS["counter"] = (("spans",), """
    SELECT endpoint_id, ts, time, row_number() OVER (PARTITION BY endpoint_id ORDER BY ts) % 97 AS value FROM spans""")
BLOCKS["increases"] = (("counter",), """
    SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS increase
    FROM counter WINDOW w AS (PARTITION BY endpoint_id ORDER BY ts)""")


@query("counter_rate", ("increases",), f"""
    SELECT endpoint_id, {stamp('time')}, {num('coalesce(sum(increase), 0) / 21600.0', 'rate')} FROM increases GROUP BY endpoint_id, time""")
def counter_rate(t):
    return red.counter_rate(_counter(t), ["endpoint_id"], 6 * HOUR)


@query("red_features", ("features",), f"SELECT {FEATURE_SQL} FROM features")
def red_features(t):
    return t.features.select(*FEATURE_COLUMNS)


@query("red_features_exact", ("spans",), f"""
    SELECT endpoint_id, {stamp('time')}, {num('count(*) / 21600.0', 'rps')}, {num('quantile_cont(latency_ms, 0.5)', 'p50_ms')},
           {num('quantile_cont(latency_ms, 0.95)', 'p95_ms')}, {num('quantile_cont(latency_ms, 0.99)', 'p99_ms')},
           {num('100.0 * count(*) FILTER (status_code = 500) / count(*)', 'error_rate_5xx')}
    FROM spans GROUP BY endpoint_id, time""")
def red_features_exact(t):
    return red.red_features_exact(t.spans, t.settings).select(
        "endpoint_id", "time", "rps", "p50_ms", "p95_ms", "p99_ms", "error_rate_5xx"
    )


@query("error_ratio", ("features",), f"SELECT endpoint_id, {stamp('time')}, {num('error_rate_5xx')}, {num('error_rate_4xx')} FROM features")
def error_ratio(t):
    return t.features.select("endpoint_id", "time", "error_rate_5xx", "error_rate_4xx")


BASE_SQL = f"{num('p10')}, {num('p50')}, {num('p90')}"


@query("seasonal_baseline", ("baseline",), f"""
    SELECT endpoint_id, metric, dow, hour_bucket, {BASE_SQL}, CAST(sample_count AS BIGINT) AS sample_count FROM baseline""")
def seasonal_baseline(t):
    return t.baseline.drop("updated_at")


@query("baseline_incremental", ("baseline",), f"""
    SELECT endpoint_id, metric, dow, hour_bucket, {BASE_SQL}, CAST(sample_count AS BIGINT) AS sample_count FROM baseline""")
def baseline_incremental(t):
    """Built without faults nine days early, then brought up to date as days pass and faults become known."""
    state = BaselineState(t.spark, tables.fresh_path(t.spark, "baseline-state"), t.settings)
    for days, faults in ((9, t.injections.limit(0)), (2, t.injections), (0, t.injections)):
        state.advance(t.features, faults, AS_OF - timedelta(days=days))
    return state.baseline().drop("updated_at")


@query("baseline_fallback", ("fallback",), f"SELECT endpoint_id, metric, {BASE_SQL} FROM fallback")
def baseline_fallback(t):
    return baseline.baseline_fallback(t.baseline)


@query("baseline_global", ("metric_long",), f"""
    SELECT metric, {num('quantile_cont(value, 0.1)', 'p10')}, {num('quantile_cont(value, 0.5)', 'p50')}, {num('quantile_cont(value, 0.9)', 'p90')}
    FROM metric_long GROUP BY metric""")
def baseline_global(t):
    return baseline.baseline_global(t.features, t.injections, t.as_of, t.settings)


# --------------------------------------------------------------------------- windows


@query("rolling_window", ("rolled",), f"""
    SELECT endpoint_id, {stamp('time')}, CAST(window_rows AS BIGINT) AS window_rows, {num('list_sum(y)', 'p99_sum')} FROM rolled""")
def rolling_window(t):
    r = features.rolling_window(t.features, t.settings)
    total = F.aggregate("p99_ms_series", F.lit(0.0), lambda a, x: a + x)
    return r.select("endpoint_id", "time", "window_rows", total.alias("p99_sum"))


@query("last_valid", ("holes",), f"""
    SELECT endpoint_id, {stamp('time')}, {num('''coalesce(last_value(p99_ms IGNORE NULLS) OVER
      (PARTITION BY endpoint_id ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0.0)''', 'last_p99_ms')} FROM holes""")
def last_valid(t):
    return features.rolling_window(_holes(t), t.settings).select("endpoint_id", "time", "last_p99_ms")


@query("theil_sen", ("derived",), f"""
    SELECT endpoint_id, {stamp('time')}, {num("CASE WHEN len(y) >= 3 THEN list_aggregate(slopes, 'quantile_cont', 0.5) ELSE 0.0 END", 'slope')} FROM derived""")
def theil_sen(t):
    from ..functions.arrays import pairwise_slopes, theil_sen as slope

    r = features.rolling_window(t.features, t.settings).withColumn("s", pairwise_slopes("p99_ms_series"))
    return r.select("endpoint_id", "time", slope("s", "p99_ms_series", 3).alias("slope"))


@query("rps_delta", ("derived",), f"SELECT endpoint_id, {stamp('time')}, {num('rps_delta')} FROM derived")
def rps_delta(t):
    return t.scored.select("endpoint_id", "time", "rps_delta")


@query("latest_per_key", ("features",), f"""
    SELECT endpoint_id, {stamp('time')}, {num('p99_ms')}, {num('error_rate_5xx')} FROM features
    QUALIFY row_number() OVER (PARTITION BY endpoint_id ORDER BY time DESC) = 1""")
def latest_per_key(t):
    newest = F.max_by(F.struct("time", "p99_ms", "error_rate_5xx"), "time")
    return t.features.groupBy("endpoint_id").agg(newest.alias("n")).select("endpoint_id", "n.*")


@query("consecutive_runs", ("onsets",), f"SELECT endpoint_id, detector, {stamp('onset')} FROM onsets")
def consecutive_runs(t):
    return evaluation.replay_onsets(t.replayed, t.settings)


@query("cycle_gap", ("spans",), f"""
    SELECT {stamp('cycle')}, {num('epoch(cycle) - epoch(lag(cycle) OVER (ORDER BY cycle))', 'gap_seconds')}
    FROM (SELECT DISTINCT make_timestamp(epoch_us(ts) // 60000000 * 60000000) AS cycle FROM spans)""")
def cycle_gap(t):
    minutes = t.spans.select(cycle_start("ts", 60).alias("time"))
    return selfobs.cadence(minutes)


@query("rank_candidates", ("fault_of",), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')}, suspected_fault, {num('imputation_score')}, service_match FROM fault_of""")
def rank_candidates(t):
    out = attribution.fault_attribution(t.episodes, t.injections, t.settings, bucket_seconds=BUCKET)
    return out.where(F.col("suspected_fault").isNotNull()).select(
        "endpoint_id", "signal_type", "opened_at", "suspected_fault", "imputation_score",
        F.col("fault_service_match").alias("service_match"),
    )


BLOCKS["ks_counts"] = (("spans",), """
    SELECT latency_ms AS v, count(*) FILTER (service = 'gateway') AS a, count(*) FILTER (service <> 'gateway') AS b
    FROM spans GROUP BY 1""")


@query("ks_cdf", ("ks_counts",), f"""
    SELECT {num('max(abs(ca / ta - cb / tb))', 'ks')}, CAST(max(ta) AS BIGINT) AS n_a, CAST(max(tb) AS BIGINT) AS n_b
    FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM ks_counts)""")
def ks_cdf(t):
    from ..operators.model_ops import ks_statistic

    a = t.spans.where("service = 'gateway'")
    b = t.spans.where("service <> 'gateway'")
    return ks_statistic(a, b, "latency_ms", "latency_ms")


@query("temporal_split", ("spans",), """
    SELECT span_id, CASE WHEN row_number() OVER (ORDER BY ts, endpoint_id, span_id) <= (SELECT count(*) // 2 FROM spans) THEN 'train' ELSE 'test' END AS split FROM spans""")
def temporal_split(t):
    from ..operators.supervised import temporal_split as split

    return split(t.spans.select("span_id", "ts", "endpoint_id"), "ts", ("endpoint_id", "span_id")).select("span_id", "split")


# --------------------------------------------------------------------------- top-k and sets


@query("top_features", ("derived",), f"""
    SELECT endpoint_id, {stamp('time')}, list_transform(list_sort([
        {{'a': -abs(baseline_dev_p50), 'i': 0, 'n': 'baseline_dev_p50'}}, {{'a': -abs(baseline_dev_p95), 'i': 1, 'n': 'baseline_dev_p95'}},
        {{'a': -abs(baseline_dev_p99), 'i': 2, 'n': 'baseline_dev_p99'}}, {{'a': -abs(feature_error_rate_5xx), 'i': 3, 'n': 'error_rate_5xx'}},
        {{'a': -abs(latency_slope), 'i': 4, 'n': 'latency_slope'}}, {{'a': -abs(p99_over_p50), 'i': 5, 'n': 'p99_over_p50'}},
        {{'a': -abs(rps_delta), 'i': 6, 'n': 'rps_delta'}}]), lambda s: s.n)[1] AS first_feature FROM derived""")
def top_features(t):
    top = features.top_features(t.settings)
    return t.scored.select("endpoint_id", "time", F.get(top, F.lit(0))["name"].alias("first_feature"))


@query("recent_firings", ("log",), f"""
    SELECT {stamp('time', 'fired_at')}, endpoint_id, signal_type, severity FROM log
    WHERE state = 'firing' AND prev_state <> 'firing' ORDER BY time DESC, endpoint_id, signal_type LIMIT 50""")
def recent_firings(t):
    return selfobs.recent_firings(alerts.alert_history(t.log)).select(
        F.col("time").alias("fired_at"), "endpoint_id", "signal_type", "severity"
    )


@query("neighbour_ids", ("anomalies", "edges"), """
    SELECT a.endpoint_id AS root, n.endpoint_id, count(*) AS cycles FROM anomalies a JOIN
      (SELECT parent_endpoint_id AS root, child_endpoint_id AS endpoint_id FROM edges
       UNION SELECT child_endpoint_id, parent_endpoint_id FROM edges
       UNION SELECT x.parent_endpoint_id, y.child_endpoint_id FROM edges x JOIN edges y ON y.parent_endpoint_id = x.child_endpoint_id) n
      ON n.root = a.endpoint_id GROUP BY ALL""")
def neighbour_ids(t):
    n = graph.neighbours(t.edges)
    return t.scored.select(F.col("endpoint_id").alias("root")).join(n, "root").groupBy("root", "endpoint_id").agg(
        F.count(F.lit(1)).alias("cycles")
    )


@query("union_recursive", (), """
    WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS p, o_custkey + 1 + o_orderkey % 3 AS c FROM orders),
    r(root, node, depth) AS (
      SELECT p, c, 1 FROM e
      UNION SELECT r.root, e.c, r.depth + 1 FROM r JOIN e ON e.p = r.node WHERE r.depth < 3)
    SELECT 'c' || CAST(root AS VARCHAR) AS root, 'c' || CAST(node AS VARCHAR) AS endpoint_id, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY root, node""")
def union_recursive(t):
    e = t.table("orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("parent_endpoint_id"),
        F.concat(F.lit("c"), F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("child_endpoint_id"),
        F.lit("s").alias("child_service"), F.lit("direct").alias("call_type"), F.lit("s").alias("parent_service"),
    ).distinct()
    return graph.descendants(e, None, 3).groupBy("root", "endpoint_id").agg(F.min("depth").alias("depth"))


@query("union_windows", ("injections", "spans"), f"""
    SELECT source_file, {stamp('injected_at')}, count(s.span_id) AS spans FROM injections i
    LEFT JOIN spans s ON s.ts BETWEEN i.injected_at AND i.cleared_at GROUP BY ALL""")
def union_windows(t):
    files = [t.injections.where(F.col("source_file") == r[6]) for r in INJECTION_ROWS]
    windows = files[0]
    for f in files[1:]:
        windows = windows.unionByName(f)
    hits = interval_join(t.spans.select("span_id", "ts"), windows, "ts", "injected_at", "cleared_at", (), "inner", BUCKET)
    counts = hits.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    return windows.join(counts, "source_file", "left").select(
        "source_file", "injected_at", F.coalesce("n", F.lit(0)).alias("spans")
    )


# --------------------------------------------------------------------------- scalar functions


@query("signed_deviation", (), f"""
    SELECT event_id, {num('''CASE WHEN value > 40 THEN (value - 40) / 30.0 WHEN value < 10 THEN (value - 10) / 30.0 ELSE 0.0 END''', 'deviation')} FROM events""")
def signed_deviation_query(t):
    return t.events.select("event_id", signed_deviation("value", F.lit(10.0), F.lit(40.0)).alias("deviation"))


@query("one_sided_deviation", (), f"""
    SELECT event_id, {num('CASE WHEN value > 40 THEN (value - 40) / (30.0 + 1e-6) ELSE 0.0 END', 'deviation')} FROM events""")
def one_sided_deviation_query(t):
    return t.events.select("event_id", one_sided_deviation("value", F.lit(10.0), F.lit(40.0)).alias("deviation"))


@query("direction", ("scored",), f"SELECT endpoint_id, {stamp('time')}, direction FROM scored")
def direction(t):
    rows = baseline.with_baseline(t.features, t.baseline)
    d = direction_of("p99_ms", F.col("b_p99_ms.p10"), F.col("b_p99_ms.p90"))
    return rows.select("endpoint_id", "time", d.alias("direction"))


@query("date_parts", ("spans",), """
    SELECT CAST(dayofweek(ts) AS BIGINT) AS dow, CAST(hour(ts) AS BIGINT) AS hour_bucket, count(*) AS n FROM spans GROUP BY ALL""")
def date_parts(t):
    return t.spans.groupBy(day_of_week("ts").alias("dow"), F.hour("ts").alias("hour_bucket")).agg(F.count(F.lit(1)).alias("n"))
