"""The driver tables read as telemetry: every event is one request span."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CALL_EDGES, ENDPOINT_SLOS, ENDPOINTS, PRODUCTION
from ..operators.alerts import alert_log, episodes
from ..operators.attribution import deploy_attribution, fault_attribution
from ..operators.baseline import seasonal_baseline
from ..operators.model_ops import Trained, fit, scored_history, training_matrix
from ..operators.red import red_features
from ..operators.scoring import anomaly_rows, contributing, signals, time_to_degradation
from ..sources.tables import stored
from ..schemas import DEPLOYS, EDGES, SLOS

HOUR = 3600
CYCLE = 6 * HOUR
AS_OF = datetime(2024, 1, 31)

# Coarse numbers for a month of thin traffic; the rules stay the same.
SETTINGS = replace(
    PRODUCTION,
    cycle_seconds=CYCLE,
    rate_seconds=CYCLE,
    baseline_days=31,
    baseline_min_samples=3,
    injection_margin_seconds=0,
    train_days=31,
    grace_seconds=12 * HOUR,
    causal_window_seconds=12 * HOUR,
    deploy_window_seconds=12 * HOUR,
    neighbour_lookback_seconds=60 * HOUR,
    label_margin_seconds=0,
    history_hours=14 * 24,
)
BUCKET = 12 * HOUR

INJECTION_ROWS = [
    ("bad_deploy", "latency_step", "orders", "GET /orders/{order_id}", "2024-01-05 00:00", "2024-01-06 00:00", "bad_deploy.json"),
    ("latency_step_large", "latency_step", "orders", "GET /orders", "2024-01-09 06:00", "2024-01-10 06:00", "latency_step_large_core.json"),
    ("latency_step_large", "latency_step", "orders", "GET /orders", "2024-01-13 00:00", "2024-01-14 12:00", "latency_step_large_stress.json"),
    ("error_burst_high", "error_burst", "payments", "POST /payments", "2024-01-17 00:00", "2024-01-18 00:00", "error_burst_high_core.json"),
    ("error_burst_high", "error_burst", "payments", "POST /payments", "2024-01-21 00:00", "2024-01-22 12:00", "error_burst_high_stress.json"),
    ("pool_shrink_heavy", "pool_shrink", "orders", "GET /api/orders/{order_id}", "2024-01-13 00:00", "2024-01-13 18:00", "pool_shrink_heavy_core.json"),
    ("downstream_slow", "downstream_slow", "payments", "POST /api/payments", "2024-01-25 00:00", "2024-01-26 00:00", "downstream_slow_core.json"),
]
DEPLOY_ROWS = [
    ("d1", "orders", "v2.3.1", "2024-01-04 20:00"),
    ("d2", "payments", "v1.9.0", "2024-01-04 23:00"),
    ("d3", "orders", "v2.4.0", "2024-01-09 02:00"),
    ("d4", "gateway", "v7.0.0", "2024-01-20 06:00"),
]


def at(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


class Telemetry:
    """Lazily built DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self.settings = SETTINGS
        self.as_of = at(AS_OF)
        self._paths: list[str] = []

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        self._paths += out.inputFiles()[:1]
        return out

    def alive(self) -> bool:
        """Whether the written stage tables still exist."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(p) for p in self._paths]
        return all(p.getFileSystem(conf).exists(p) for p in paths)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def spans(self) -> DataFrame:
        return spans_from(self.events)

    @cached_property
    def features(self) -> DataFrame:
        """The feature table: written once, then read by every later step."""
        return self._stored(red_features(self.spans, self.settings), "features")

    def _values(self, rows: list[tuple], schema: str) -> DataFrame:
        """Constant rows as a relation of known size, so joins can weigh it without a hint."""

        def literal(v) -> str:
            if v is None:
                return "NULL"
            return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)

        fields = [f.strip().split(" ", 1) for f in schema.split(",")]
        names = ", ".join(n for n, _ in fields)
        body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
        casts = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in fields)
        return self.spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")

    @cached_property
    def injections(self) -> DataFrame:
        return self._values(
            INJECTION_ROWS,
            "scenario_id string, fault_type string, target_service string, target_endpoint string, "
            "injected_at timestamp, cleared_at timestamp, source_file string",
        )

    @cached_property
    def deploys(self) -> DataFrame:
        return self._values([(*r, None) for r in DEPLOY_ROWS], DEPLOYS)

    @cached_property
    def edges(self) -> DataFrame:
        return self._values(list(CALL_EDGES), EDGES)

    @cached_property
    def slos(self) -> DataFrame:
        return self._values(list(ENDPOINT_SLOS), SLOS)

    @cached_property
    def endpoints(self) -> DataFrame:
        rows = [(f"{m} {r}", s, t) for m, r, s, t in ENDPOINTS]
        return self._values(rows, "endpoint_id string, service string, service_tier string")

    @cached_property
    def baseline(self) -> DataFrame:
        return self._stored(seasonal_baseline(self.features, self.injections, self.as_of, self.settings), "baseline")

    @property
    def model(self) -> Trained:
        """The forest in use: fitted once per folder and session, like a promoted model, and kept when stage tables are forgotten."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _MODELS:
            matrix = training_matrix(self.features, self.baseline, self.injections, self.as_of, self.settings, BUCKET)
            _MODELS[key] = fit(matrix, AS_OF, self.settings)
        return _MODELS[key]

    @cached_property
    def scored(self) -> DataFrame:
        """All cycles scored by limits, band and forest."""
        return self._stored(
            scored_history(self.features, self.baseline, self.slos, self.model, self.settings, complete_only=False),
            "scored",
        )

    @cached_property
    def replayed(self) -> DataFrame:
        return scored_history(self.features, self.baseline, self.slos, self.model, self.settings)

    @cached_property
    def anomalies(self) -> DataFrame:
        # one cycle counts as a minute in the trend, so that its slope limits mean something
        ttd = F.when(F.col("anomaly"), time_to_degradation(settings=self.settings, cycle_seconds=60))
        return anomaly_rows(self.scored, contributing(self.settings, ttd=ttd))

    @cached_property
    def log(self) -> DataFrame:
        return self._stored(alert_log(signals(self.scored), self.settings), "log")

    @cached_property
    def episodes(self) -> DataFrame:
        return episodes(self.log)

    @cached_property
    def attributed(self) -> DataFrame:
        faults = fault_attribution(self.episodes, self.injections, self.settings, bucket_seconds=BUCKET)
        return deploy_attribution(faults, self.deploys, self.settings)


_OPEN: dict[tuple[str, str], Telemetry] = {}
_MODELS: dict[tuple[str, str], Trained] = {}


def telemetry(spark: SparkSession, sf_dir: str) -> Telemetry:
    """Telemetry of a folder whose stage tables are shared by the queries of one session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN or not _OPEN[key].alive():
        _OPEN[key] = Telemetry(spark, sf_dir)
    return _OPEN[key]


def forget() -> None:
    """Make the next query build all stage tables again; the fitted model stays."""
    _OPEN.clear()


def spans_from(events: DataFrame) -> DataFrame:
    """Spans from events: endpoint by user, status by type and value, latency from the value."""
    pick = (F.col("user_id") % len(ENDPOINTS)).cast("int")

    def member(i: int) -> Column:
        return F.get(F.array(*[F.lit(e[i]) for e in ENDPOINTS]), pick)

    big = F.col("value") > 60
    return events.select(
        F.col("event_id").alias("span_id"),
        "ts",
        member(2).alias("service"),
        member(3).alias("service_tier"),
        member(0).alias("method"),
        member(1).alias("route"),
        F.concat_ws(" ", member(0), member(1)).alias("endpoint_id"),
        F.lit("SPAN_KIND_SERVER").alias("span_kind"),
        F.when((F.col("event_type") == "error") & big, 500)
        .when((F.col("event_type") == "signup") & big, 404)
        .otherwise(200)
        .alias("status_code"),
        (F.col("value") * 2).alias("latency_ms"),
        F.map_concat(
            F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")),
            F.create_map(F.lit("user.id"), F.col("user_id").cast("string")),
        ).alias("attrs"),
        "user_id",
    )
