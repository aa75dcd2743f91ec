"""All tunable numbers in one place, as one immutable settings object."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# They must agree with the published behaviour to give the same
# results, so they are listed as they are.
# ---------------------------------------------------------------------------

# Upper bounds of the latency histogram, milliseconds (the last bucket is +Inf).
LATENCY_BOUNDS_MS = (
    2.0, 4.0, 6.0, 8.0, 10.0, 50.0, 100.0, 200.0, 400.0, 800.0,
    1000.0, 1400.0, 2000.0, 5000.0, 10000.0, 15000.0,
)

# Span attributes that carry personal data.
PII_ATTRIBUTES = ("http.url", "http.target", "net.peer.ip", "enduser.id", "user.id")

# Service level objectives per endpoint: p99 latency (ms) and 5xx rate (percent).
ENDPOINT_SLOS = (
    ("GET /orders/{order_id}", 300.0, 5.0),
    ("GET /orders", 300.0, 5.0),
    ("POST /payments", 1500.0, 5.0),
    ("GET /api/orders/{order_id}", 600.0, 5.0),
    ("GET /api/orders", 600.0, 5.0),
    ("POST /api/payments", 2000.0, 5.0),
)
DEFAULT_SLO_P99_MS = 500.0
DEFAULT_SLO_5XX = 10.0

# Tracked endpoints: method, route, service, tier.
ENDPOINTS = (
    ("GET", "/api/orders/{order_id}", "gateway", "gateway"),
    ("GET", "/api/orders", "gateway", "gateway"),
    ("POST", "/api/payments", "gateway", "gateway"),
    ("GET", "/orders/{order_id}", "orders", "service"),
    ("GET", "/orders", "orders", "service"),
    ("POST", "/payments", "payments", "service"),
)

# Call topology: parent, child, parent service, child service, call type.
CALL_EDGES = (
    ("GET /api/orders/{order_id}", "GET /orders/{order_id}", "gateway", "orders", "direct"),
    ("GET /api/orders", "GET /orders", "gateway", "orders", "direct"),
    ("POST /api/payments", "POST /payments", "gateway", "payments", "direct"),
    ("POST /payments", "GET /orders/{order_id}", "payments", "orders", "cascade"),
)

# Weight of the last call edge when a degraded dependency is suspected.
CALL_TYPE_WEIGHTS = {"direct": 1.0, "cascade": 0.7}
OTHER_CALL_WEIGHT = 0.75

# Metrics that have a seasonal baseline.
BASELINE_METRICS = ("p50_ms", "p95_ms", "p99_ms", "rps", "error_rate_5xx", "error_rate_4xx")

# Canonical order of the model features.
MODEL_FEATURES = (
    "baseline_dev_p50",
    "baseline_dev_p95",
    "baseline_dev_p99",
    "error_rate_5xx",
    "latency_slope",
    "p99_over_p50",
    "rps_delta",
)

# Word lists of the explanation rubric (the scored texts may be French).
ACTION_TERMS = (
    "verifi", "examin", "confirm", "investig", "analys", "inspect", "compar", "consult",
    "logs", "metriqu", "métriqu", "cpu", "memoir", "mémoir", "db", "requet", "requêt",
    "endpoint", "deploy", "déploie", "pool", "latence", "erreur", "trafic",
)
HEDGE_TERMS = (
    "suspect", "faible", "incertain", "probable", "possible", "score", "peut", "semble",
    "pourrait", "hypoth", "non confirm", "a confirmer", "à confirmer",
)

# Alert states and the columns of the campaign summary.
ALERT_STATES = ("ok", "pending", "firing", "resolving")
SUMMARY_COLUMNS = (
    "scenario", "tier", "duration_yaml_s", "duration_effective_s",
    "tp", "fp", "fn", "precision", "recall", "f1",
    "fp_per_hour", "delay_median_s", "status", "error",
)


@dataclass(frozen=True)
class Settings:
    """Numbers of the production setup; tests and demos override single fields."""

    # feature windows
    cycle_seconds: int = 60
    rate_seconds: int = 300
    window_size: int = 10
    min_window: int = 3

    # seasonal baseline
    baseline_days: int = 14
    baseline_min_samples: int = 10
    injection_margin_seconds: int = 300

    # scoring
    deviation_scale: float = 2.0
    fire_threshold: float = 0.6
    strong_layer: float = 0.3
    critical_score: float = 0.8
    critical_slo_factor: float = 2.0
    ttd_min_slope: float = 0.5
    ttd_horizon_minutes: float = 120.0

    # alerting
    fire_after: int = 3
    resolve_after: int = 3
    compat_resolving: bool = False
    clear_threshold: float | None = None  # below fire_threshold: an open alert holds down to it
    offline_fire_after: int = 2

    # attribution
    causal_window_seconds: int = 1800
    deploy_window_seconds: int = 1800
    match_bonus: float = 1.2
    graph_depth: int = 3
    rca_cap: float = 0.95
    rca_high: float = 0.70
    rca_medium: float = 0.35
    neighbour_lookback_seconds: int = 600

    # evaluation
    grace_seconds: int = 120
    pad_seconds: int = 600
    evaluation_margin_seconds: int = 300
    sibling_score: float = 0.90

    # model
    trees: int = 200
    subsample: int = 256
    seed: int = 42
    contamination: float = 0.02
    reference_rows: int = 500
    min_train_rows: int = 200
    train_days: int = 14
    sanity_ks_max: float = 0.35
    drift_ks_max: float = 0.30
    drift_min_live: int = 50
    drift_live_cut: float = 0.5
    recall_tolerance: float = 0.05
    fp_tolerance_rel: float = 0.50
    fp_tolerance_abs: int = 2
    max_data_age_hours: float = 24.0
    label_margin_seconds: int = 120
    supervised_days: int = 40

    # explanation and retention
    history_hours: int = 48
    history_limit: int = 5
    retention_days: int = 90
    compact_after_days: int = 7
    max_endpoints: int = 10000

    features: tuple = field(default=MODEL_FEATURES)


PRODUCTION = Settings()
