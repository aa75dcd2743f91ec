"""Building blocks of the SQL counterparts, written for DuckDB on the same parquet tables."""

from __future__ import annotations

import re

from ..config import CALL_EDGES, ENDPOINT_SLOS, ENDPOINTS, LATENCY_BOUNDS_MS
from .fixture import DEPLOY_ROWS, INJECTION_ROWS


def _values(rows, stamps=()) -> str:
    def lit(i, v):
        if i in stamps:
            return f"TIMESTAMP '{v}'"
        return repr(v) if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(i, v) for i, v in enumerate(r)) + ")" for r in rows)


N = len(LATENCY_BOUNDS_MS)


def _quantile(q: float) -> str:
    parts = ["CASE WHEN calls = 0 THEN CAST('nan' AS DOUBLE)"]
    for i, b in enumerate(LATENCY_BOUNDS_MS):
        lo = LATENCY_BOUNDS_MS[i - 1] if i else 0.0
        below = f"le_{i - 1}" if i else "0"
        parts.append(
            f"WHEN le_{i} >= calls * {q}e0 THEN {lo} + {b - lo} * ((calls * {q}e0 - {below}) / CAST(le_{i} - {below} AS DOUBLE))"
        )
    return " ".join(parts) + f" ELSE {LATENCY_BOUNDS_MS[-1]} END"


def _pick(i: int) -> str:
    return "[" + ", ".join(repr(e[i]) for e in ENDPOINTS) + "][CAST(1 + user_id % 6 AS INTEGER)]"


METRICS = ("p50_ms", "p95_ms", "p99_ms", "rps", "error_rate_5xx", "error_rate_4xx")
LOOKUP = ("p50_ms", "p95_ms", "p99_ms", "rps")


def _bands() -> str:
    cols = []
    for m in LOOKUP:
        for p in ("p10", "p50", "p90"):
            cols.append(
                f"CASE WHEN max(CASE WHEN b.metric = '{m}' THEN 1 END) = 1 "
                f"THEN max(CASE WHEN b.metric = '{m}' THEN b.{p} END) "
                f"ELSE max(CASE WHEN f.metric = '{m}' THEN f.{p} END) END AS {m}_{p}"
            )
    return ", ".join(cols)


def _dev(metric: str) -> str:
    v, lo, hi = f"last_{metric}", f"{metric}_p10", f"{metric}_p90"
    return (
        f"CASE WHEN {lo} IS NULL OR {hi} IS NULL OR {hi} - {lo} < 1e-6 THEN 0.0 "
        f"WHEN {v} > {hi} THEN ({v} - {hi}) / ({hi} - {lo}) "
        f"WHEN {v} < {lo} THEN ({v} - {lo}) / ({hi} - {lo}) ELSE 0.0 END"
    )


SLOPES = (
    "list_sort(flatten(list_transform(range(1, len(y)), lambda i: "
    "list_transform(range(i + 1, len(y) + 1), lambda j: (y[j] - y[i]) / (j - i)))))"
)

W10 = "OVER (PARTITION BY endpoint_id ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"

# name: (dependencies, body)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "injections": ((), (
        "SELECT * FROM (VALUES " + _values(INJECTION_ROWS, (4, 5)) + ") t(scenario_id, fault_type, "
        "target_service, target_endpoint, injected_at, cleared_at, source_file)")),
    "deploys": ((), (
        "SELECT * FROM (VALUES " + _values(DEPLOY_ROWS, (3,)) + ") t(deploy_id, service, version, deployed_at)")),
    "slos": ((), (
        "SELECT * FROM (VALUES " + _values(ENDPOINT_SLOS) + ") t(endpoint_id, slo_p99_ms, slo_error_rate_5xx)")),
    "edges": ((), (
        "SELECT * FROM (VALUES " + _values(CALL_EDGES) + ") t(parent_endpoint_id, child_endpoint_id, "
        "parent_service, child_service, call_type)")),
    "spans": ((), f"""
        SELECT event_id AS span_id, ts, {_pick(2)} AS service, {_pick(3)} AS service_tier,
               {_pick(0)} AS method, {_pick(1)} AS route, {_pick(0)} || ' ' || {_pick(1)} AS endpoint_id,
               CASE WHEN event_type = 'error' AND value > 60 THEN 500
                    WHEN event_type = 'signup' AND value > 60 THEN 404 ELSE 200 END AS status_code,
               value * 2 AS latency_ms, props, user_id,
               make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) AS time
        FROM events"""),
    "cells": (("spans",), "SELECT time, endpoint_id, service, service_tier, count(*) AS calls, "
        "count(*) FILTER (status_code BETWEEN 500 AND 599) AS n5, "
        "count(*) FILTER (status_code BETWEEN 400 AND 499) AS n4, "
        + ", ".join(f"count(*) FILTER (latency_ms <= {b}) AS le_{i}" for i, b in enumerate(LATENCY_BOUNDS_MS))
        + f", count(*) AS le_{N} FROM spans GROUP BY ALL"),
    "features": (("cells",), f"""
        SELECT time, endpoint_id, service, service_tier, calls / 21600.0 AS rps,
               {_quantile(0.5)} AS p50_ms, {_quantile(0.95)} AS p95_ms, {_quantile(0.99)} AS p99_ms,
               100.0 * n5 / calls AS error_rate_5xx, 100.0 * n4 / calls AS error_rate_4xx,
               calls AS span_count
        FROM cells"""),
    "clean": (("features", "injections"), """
        SELECT * FROM features f WHERE time >= TIMESTAMP '2023-12-31'
        AND NOT EXISTS (SELECT 1 FROM injections i WHERE f.time BETWEEN i.injected_at AND i.cleared_at)"""),
    "metric_long": (("clean",), """
        SELECT time, endpoint_id, metric, value FROM
        (SELECT time, endpoint_id, p50_ms, p95_ms, p99_ms, rps, error_rate_5xx, error_rate_4xx FROM clean)
        UNPIVOT (value FOR metric IN (p50_ms, p95_ms, p99_ms, rps, error_rate_5xx, error_rate_4xx))"""),
    "baseline": (("metric_long",), """
        SELECT endpoint_id, metric, CAST(dayofweek(time) AS INTEGER) AS dow, CAST(hour(time) AS INTEGER) AS hour_bucket,
               quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90,
               count(*) AS sample_count
        FROM metric_long GROUP BY ALL HAVING count(*) >= 3"""),
    "fallback": (("baseline",), """
        SELECT endpoint_id, metric, min(p10) AS p10, avg(p50) AS p50, max(p90) AS p90
        FROM baseline GROUP BY ALL"""),
    "bands": (("features", "baseline", "fallback"), f"""
        SELECT s.endpoint_id, s.time, {_bands()}
        FROM features s
        LEFT JOIN fallback f ON f.endpoint_id = s.endpoint_id
        LEFT JOIN baseline b ON b.endpoint_id = s.endpoint_id AND b.metric = f.metric
             AND b.dow = dayofweek(s.time) AND b.hour_bucket = hour(s.time)
        GROUP BY ALL"""),
    "usable": (("features",), """
        SELECT * EXCLUDE (newest, rows_) FROM
        (SELECT *, max(time) OVER (PARTITION BY endpoint_id) AS newest, count(*) OVER (PARTITION BY endpoint_id) AS rows_
         FROM features) WHERE rows_ = 1 OR time < newest"""),
}


def _rolled(source: str) -> str:
    lasts = ", ".join(
        f"coalesce(last_value({m} IGNORE NULLS) {W10}, 0.0) AS last_{m}"
        for m in ("p50_ms", "p95_ms", "p99_ms", "rps", "error_rate_5xx")
    )
    return f"""
        SELECT *, count(*) {W10} AS window_rows, list(p99_ms) {W10} AS y, list(rps) {W10} AS r, {lasts}
        FROM {source} JOIN bands USING (endpoint_id, time)"""


def _derived(source: str) -> str:
    return f"""
        SELECT *, {_dev('p50_ms')} AS baseline_dev_p50, {_dev('p95_ms')} AS baseline_dev_p95,
               {_dev('p99_ms')} AS baseline_dev_p99, last_error_rate_5xx AS feature_error_rate_5xx,
               CASE WHEN len(y) >= 3 THEN list_aggregate(slopes, 'quantile_cont', 0.5) ELSE 0.0 END
                 / (CASE WHEN p99_ms_p50 > 1e-6 THEN p99_ms_p50 WHEN last_p50_ms > 1e-6 THEN last_p50_ms ELSE 1.0 END) AS latency_slope,
               CASE WHEN abs(last_p50_ms) < 1e-6 THEN 0.0 ELSE last_p99_ms / last_p50_ms END AS p99_over_p50,
               coalesce(CASE WHEN len(r) >= 2 THEN r[len(r)] - r[len(r) - 1] ELSE 0.0 END
                 / (CASE WHEN rps_p50 > 1e-6 THEN rps_p50 WHEN last_rps > 1e-6 THEN last_rps END), 0.0) AS rps_delta
        FROM (SELECT *, {SLOPES} AS slopes FROM {source})"""


def _scored(source: str) -> str:
    return f"""
        SELECT *, static_breach OR combined >= 0.6 AS anomaly,
               CASE WHEN CAST(static_norm >= 0.3 AS INTEGER) + CAST(baseline_norm >= 0.3 AS INTEGER) + CAST(ml_gated >= 0.3 AS INTEGER) >= 2 THEN 'combined'
                    WHEN static_breach OR combined >= 0.6 THEN
                      CASE WHEN static_norm >= greatest(baseline_norm, ml_gated) THEN 'static'
                           WHEN baseline_norm >= ml_gated THEN 'baseline' ELSE 'iforest' END END AS layer,
               CASE WHEN p99_ms > slo_p99_ms * 2 OR combined >= 0.8 THEN 'critical' ELSE 'warning' END AS severity,
               static_breach OR error_rate_5xx > slo_error_rate_5xx AS static_fire,
               static_breach OR combined >= 0.6 OR error_rate_5xx > slo_error_rate_5xx AS layered_fire
        FROM (SELECT *, CASE WHEN static_breach THEN greatest(base, static_norm) ELSE base END AS combined
        FROM (SELECT *, baseline_norm + (1 - baseline_norm) * ml_gated AS base
        FROM (SELECT *, CASE WHEN direction = 'degradation' THEN ml_norm ELSE 0.0 END AS ml_gated
        FROM (SELECT *, p99_ms > slo_p99_ms AS static_breach,
               CASE WHEN p99_ms > slo_p99_ms THEN least(1.0, (p99_ms - slo_p99_ms) / (slo_p99_ms + 1e-6)) ELSE 0.0 END AS static_norm,
               least(1.0, CASE WHEN p99_ms > p99_ms_p90 THEN (p99_ms - p99_ms_p90) / (p99_ms_p90 - p99_ms_p10 + 1e-6) ELSE 0.0 END / 2.0) AS baseline_norm,
               CASE WHEN p99_ms > p99_ms_p90 THEN 'degradation' WHEN p99_ms < p99_ms_p10 THEN 'improvement' ELSE 'normal' END AS direction
        FROM (SELECT d.*, coalesce(l.slo_p99_ms, 500.0) AS slo_p99_ms, coalesce(l.slo_error_rate_5xx, 10.0) AS slo_error_rate_5xx,
                     coalesce(m.ml_norm, 0.0) AS ml_norm
              FROM {source} d LEFT JOIN slos l USING (endpoint_id)
              LEFT JOIN ml m ON m.endpoint_id = d.endpoint_id AND m.time = d.time)))))"""


BLOCKS.update({
    "rolled": (("features", "bands"), _rolled("features")),
    "derived": (("rolled",), _derived("rolled")),
    "scored": (("derived", "slos", "ml"), _scored("derived")),
    "rolled_usable": (("usable", "bands"), _rolled("usable")),
    "derived_usable": (("rolled_usable",), _derived("rolled_usable")),
    "replayed": (("derived_usable", "slos", "ml"), _scored("derived_usable")),
    "anomalies": (("scored",), """
        SELECT endpoint_id, time AS detected_at, combined AS score, coalesce(layer, 'combined') AS layer, direction
        FROM scored"""),
    "signals": (("scored",), """
        SELECT endpoint_id, service, time, 'p99_ms' AS signal_type, anomaly,
               CASE WHEN anomaly THEN severity END AS severity, CASE WHEN anomaly THEN combined ELSE 0.0 END AS score,
               p99_ms AS raw_value, layer FROM scored
        UNION ALL
        SELECT endpoint_id, service, time, 'error_rate_5xx', error_rate_5xx > slo_error_rate_5xx,
               CASE WHEN error_rate_5xx > slo_error_rate_5xx THEN 'critical' END,
               CASE WHEN error_rate_5xx > slo_error_rate_5xx THEN (error_rate_5xx - slo_error_rate_5xx) / (slo_error_rate_5xx + 1e-6) ELSE 0.0 END,
               error_rate_5xx, CASE WHEN error_rate_5xx > slo_error_rate_5xx THEN 'static' END FROM scored"""),
    "sig": (("signals",), """
        SELECT *, row_number() OVER (PARTITION BY endpoint_id, signal_type ORDER BY time) AS seq FROM signals"""),
    "log": (("sig",), """
        SELECT * FROM sig WHERE seq = 0 AND false"""),  # replaced below
})


def _machine(name: str, compat: bool) -> str:
    """Recursive replay of the alert rules, one cycle after the other."""
    resolving_bad = (
        "CASE WHEN m.rc >= 2 THEN 'ok' ELSE 'firing' END" if compat else "'firing'"
    )
    return f"""
        SELECT endpoint_id, signal_type, seq, time, service, anomaly, severity, score, raw_value, layer,
               'ok' AS prev_state, CASE WHEN anomaly THEN 'pending' ELSE 'ok' END AS state,
               0 AS pc, 0 AS rc, CASE WHEN anomaly THEN time END AS pending_since,
               CAST(NULL AS TIMESTAMP) AS opened_at, CAST(NULL AS TIMESTAMP) AS resolved_at
        FROM sig WHERE seq = 1
        UNION ALL
        SELECT endpoint_id, signal_type, seq, time, service, anomaly, severity, score, raw_value, layer, prev_state, state,
               CASE WHEN state = 'pending' AND prev_state = 'pending' THEN pc0 + 1 ELSE 0 END,
               CASE WHEN state = 'resolving' AND prev_state = 'firing' THEN 1 WHEN state = 'resolving' THEN rc0 + 1 ELSE 0 END,
               CASE WHEN state = 'ok' THEN NULL WHEN prev_state = 'ok' THEN time ELSE since0 END,
               CASE WHEN state = 'firing' AND prev_state = 'pending' THEN time
                    WHEN state = 'pending' THEN NULL ELSE opened0 END,
               CASE WHEN state <> 'ok' THEN NULL WHEN prev_state <> 'ok' THEN time ELSE resolved0 END
        FROM (SELECT n.*, m.state AS prev_state, m.pc AS pc0, m.rc AS rc0, m.pending_since AS since0,
                     m.opened_at AS opened0, m.resolved_at AS resolved0,
                     CASE WHEN n.anomaly THEN
                            CASE m.state WHEN 'ok' THEN 'pending'
                                 WHEN 'pending' THEN CASE WHEN m.pc + 1 >= 2 THEN 'firing' ELSE 'pending' END
                                 WHEN 'firing' THEN 'firing' ELSE {resolving_bad} END
                          ELSE CASE m.state WHEN 'firing' THEN 'resolving'
                                 WHEN 'resolving' THEN CASE WHEN m.rc >= 2 THEN 'ok' ELSE 'resolving' END
                                 ELSE 'ok' END END AS state
              FROM {name} m JOIN sig n ON n.endpoint_id = m.endpoint_id AND n.signal_type = m.signal_type AND n.seq = m.seq + 1)"""


BLOCKS["log"] = (("sig",), _machine("log", False))
BLOCKS["log_compat"] = (("sig",), _machine("log_compat", True))
BLOCKS.update({
    "episodes": (("log",), """
        SELECT endpoint_id, signal_type, opened_at, max(service) AS service,
               max(first_since) AS pending_since, min(resolved_at) AS resolved_at,
               max(score) AS peak_score, arg_max(state, time) AS state,
               max(CASE WHEN time = opened_at THEN severity END) AS severity,
               max(CASE WHEN time = opened_at THEN score END) AS score,
               max(CASE WHEN time = opened_at THEN raw_value END) AS raw_value,
               max(CASE WHEN time = opened_at THEN layer END) AS layer
        FROM (SELECT *, CASE WHEN time = opened_at THEN pending_since END AS first_since FROM log)
        WHERE opened_at IS NOT NULL GROUP BY endpoint_id, signal_type, opened_at"""),
    "candidates": (("episodes", "injections"), """
        SELECT *, CASE WHEN service_match THEN least(1.0, base * 1.2) ELSE base END AS adjusted FROM (
          SELECT e.endpoint_id, e.signal_type, e.opened_at, i.* ,
               CASE WHEN e.opened_at BETWEEN i.injected_at AND i.cleared_at THEN 1.0
                    WHEN e.opened_at < i.injected_at THEN 1.0 - (epoch(i.injected_at) - epoch(e.opened_at)) / 43200.0
                    ELSE 1.0 - (epoch(e.opened_at) - epoch(i.cleared_at)) / 43200.0 END AS base,
               (lower(i.target_endpoint) = lower(e.endpoint_id) OR contains(lower(e.endpoint_id), lower(i.target_endpoint))
                OR contains(lower(i.target_endpoint), lower(e.endpoint_id)) OR contains(lower(e.endpoint_id), lower(i.target_service))) AS service_match
          FROM episodes e JOIN injections i
            ON e.opened_at BETWEEN i.injected_at - INTERVAL 12 HOUR AND i.cleared_at + INTERVAL 12 HOUR)
        WHERE base > 0"""),
    "fault_of": (("candidates",), """
        SELECT endpoint_id, signal_type, opened_at, scenario_id || ':' || fault_type || ':' || target_endpoint AS suspected_fault,
               round_even(adjusted, 4) AS imputation_score, service_match
        FROM candidates QUALIFY row_number() OVER (PARTITION BY endpoint_id, signal_type, opened_at
          ORDER BY round_even(adjusted, 4) DESC, service_match DESC, injected_at, scenario_id DESC) = 1"""),
    "deploy_candidates": (("episodes", "deploys"), """
        SELECT *, CASE WHEN service_match THEN least(1.0, base * 1.2) ELSE base END AS adjusted FROM (
          SELECT e.endpoint_id, e.signal_type, e.opened_at, d.deploy_id, d.service AS deploy_service, d.version, d.deployed_at,
                 greatest(0.0, 1.0 - (epoch(e.opened_at) - epoch(d.deployed_at)) / 43200.0) AS base, d.service = e.service AS service_match
          FROM episodes e JOIN deploys d ON d.deployed_at BETWEEN e.opened_at - INTERVAL 12 HOUR AND e.opened_at)
        WHERE base > 0"""),
    "deploy_of": (("deploy_candidates",), """
        SELECT * FROM deploy_candidates QUALIFY row_number() OVER (PARTITION BY endpoint_id, signal_type, opened_at
          ORDER BY round_even(adjusted, 4) DESC, service_match DESC, deployed_at DESC, deploy_id DESC) = 1"""),
    "attributed": (("episodes", "fault_of", "deploy_of"), """
        SELECT e.*, f.suspected_fault, coalesce(f.imputation_score, 0.0) AS imputation_score,
               d.deploy_id AS suspected_deploy_id, d.deploy_service, d.version AS deploy_version,
               round_even(d.adjusted, 4) AS deploy_score
        FROM episodes e LEFT JOIN fault_of f USING (endpoint_id, signal_type, opened_at)
        LEFT JOIN deploy_of d USING (endpoint_id, signal_type, opened_at)"""),
    "onsets": (("replayed",), """
        SELECT endpoint_id, detector, time AS onset FROM (
          SELECT *, lag(fire, 1, false) OVER w AS f1, lag(fire, 2, false) OVER w AS f2
          FROM (SELECT endpoint_id, time, 'static' AS detector, static_fire AS fire FROM replayed
                UNION ALL SELECT endpoint_id, time, 'layered', layered_fire FROM replayed)
          WINDOW w AS (PARTITION BY endpoint_id, detector ORDER BY time))
        WHERE fire AND f1 AND NOT f2"""),
    "found": (("injections", "onsets"), """
        SELECT i.*, CASE WHEN contains(lower(source_file), 'stress') THEN 'stress'
                         WHEN contains(lower(source_file), 'core') THEN 'core' ELSE 'all' END AS magnitude,
               (SELECT min(epoch(o.onset) - epoch(i.injected_at)) FROM onsets o WHERE o.detector = 'static' AND o.endpoint_id = i.target_endpoint
                  AND o.onset BETWEEN i.injected_at AND i.cleared_at + INTERVAL 12 HOUR) AS delay_static,
               (SELECT min(epoch(o.onset) - epoch(i.injected_at)) FROM onsets o WHERE o.detector = 'layered' AND o.endpoint_id = i.target_endpoint
                  AND o.onset BETWEEN i.injected_at AND i.cleared_at + INTERVAL 12 HOUR) AS delay_layered
        FROM injections i"""),
    "outside": (("onsets", "injections"), """
        SELECT * FROM onsets o WHERE NOT EXISTS (SELECT 1 FROM injections i
          WHERE o.onset BETWEEN i.injected_at AND i.cleared_at + INTERVAL 12 HOUR)"""),
    "hours": (("injections",), """
        SELECT (epoch(max(cleared_at)) - epoch(min(injected_at)) + 1200) / 3600.0 AS h FROM injections"""),
})


def with_blocks(names, body: str) -> str:
    """SELECT ``body`` preceded by the named blocks and everything they need."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in BLOCKS[n][0]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return body
    def kind(n: str) -> str:
        """With a forest among them, blocks are computed once; those that name themselves are recursive."""
        once = any(b.startswith("forest") for b in ordered) and not re.search(rf"\b{n}\b", BLOCKS[n][1])
        return "MATERIALIZED " if once else ""

    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {kind(n)}({BLOCKS[n][1]})" for n in ordered) + "\n" + body


def num(expr: str, name: str | None = None) -> str:
    """Comparable number: six decimals, no negative zero."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr.split('.')[-1]}"


def stamp(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr.split('.')[-1]}"
