"""Explicit schemas of every table, as DDL strings."""

from __future__ import annotations

SPANS = (
    "span_id bigint, ts timestamp, service string, method string, route string, "
    "span_kind string, status_code int, latency_ms double, attrs map<string,string>"
)
SAMPLES = "ts timestamp, metric string, labels map<string,string>, value double"
FEATURES = (
    "time timestamp, endpoint_id string, service string, service_tier string, rps double, "
    "p50_ms double, p95_ms double, p99_ms double, error_rate_5xx double, error_rate_4xx double"
)
BASELINE = (
    "endpoint_id string, metric string, dow int, hour_bucket int, p10 double, p50 double, "
    "p90 double, sample_count bigint, updated_at timestamp"
)
INJECTIONS = (
    "scenario_id string, fault_type string, target_service string, target_endpoint string, "
    "injected_at timestamp, cleared_at timestamp, magnitude map<string,string>, source_file string"
)
DEPLOYS = (
    "deploy_id string, service string, version string, deployed_at timestamp, metadata string"
)
EDGES = (
    "parent_endpoint_id string, child_endpoint_id string, parent_service string, "
    "child_service string, call_type string"
)
SLOS = "endpoint_id string, slo_p99_ms double, slo_error_rate_5xx double"
ENDPOINTS = "method string, route string, service string, service_tier string"
MODEL_HEALTH = (
    "checked_at timestamp, model_trained_at timestamp, n_live bigint, ks_drift double, "
    "ref_mean double, live_mean double, live_p95 double, live_anomaly_rate double, "
    "drift_flag boolean"
)
EXPLANATION = (
    "struct<summary:string,suspected_cause:string,checks:array<string>,fallback:boolean>"
)
TREE_NODES = (
    "tree int, node int, feature int, threshold double, left int, right int, "
    "is_leaf boolean, depth int, size int"
)
MODEL_META = (
    "version string, trained_at timestamp, n_samples bigint, subsample int, trees int, "
    "contamination double, window_size int, lookback_days int, feature_names array<string>, "
    "feature_medians array<double>, p50 double, p95 double, p99 double, max double"
)

# One fault entry of a ground-truth file, all fields as text so that bad values become nulls.
FAULT_ENTRY = (
    "struct<scenario_id:string,fault_type:string,target_service:string,target_endpoint:string,"
    "injected_at:string,cleared_at:string,magnitude:map<string,string>>"
)
