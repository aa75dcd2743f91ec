"""Self-observability: freshness, counts, cadence, drift and timeline queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import ALERT_STATES, PRODUCTION, Settings
from ..functions.ordered import exact_quantiles, latest_before_chunk
from ..functions.scalars import seconds_between
from .baseline import with_baseline


def freshness(df: DataFrame, as_of: Column, time: str = "time", name: str = "lag_seconds") -> DataFrame:
    """Age of the newest row in seconds; null for an empty table."""
    newest = df.agg(F.max(time).alias("_t"))
    return newest.select(((F.unix_micros(as_of) - F.unix_micros("_t")) / F.lit(1e6)).alias(name))


def component_up(df: DataFrame, as_of: Column, time: str = "time", limit_seconds: int = 300) -> DataFrame:
    age = freshness(df, as_of, time)
    fresh = F.coalesce(F.col("lag_seconds"), F.lit(9999.0)) < limit_seconds
    return age.select(fresh.cast("int").alias("up"))


def state_counts(current: DataFrame, spark: SparkSession) -> DataFrame:
    """Alerts per state, with a zero row for a state nobody is in."""
    states = spark.createDataFrame([(s,) for s in ALERT_STATES], "state string")
    counts = current.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return states.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def firing_now(current: DataFrame) -> DataFrame:
    return current.agg(F.count_if(F.col("state") == "firing").alias("firing"))


def firings_in_range(history: DataFrame, since: Column, until: Column, time: str = "time") -> DataFrame:
    return history.where((F.col(time) >= since) & (F.col(time) <= until)).agg(
        F.count(F.lit(1)).alias("firings")
    )


def recent_firings(history: DataFrame, limit: int = 50, time: str = "time") -> DataFrame:
    return history.orderBy(F.desc(time), "endpoint_id", "signal_type").limit(limit)


def fallback_rate(explained: DataFrame) -> DataFrame:
    """Share of explanations that came from the template, in percent; null without any."""
    has = F.col("explanation").isNotNull()
    return explained.agg(
        (100.0 * F.count_if(F.col("explanation.fallback")) / F.nullif(F.count_if(has), F.lit(0))).alias("fallback_rate")
    )


def firing_duration(episodes: DataFrame) -> DataFrame:
    """Median seconds from opening to resolution."""
    closed = episodes.where(F.col("resolved_at").isNotNull() & F.col("opened_at").isNotNull())
    rows = closed.select(seconds_between("resolved_at", "opened_at").alias("seconds"))
    return exact_quantiles(rows, [], "seconds", {"median_seconds": 0.5})


def distinct_cycles(df: DataFrame, time: str = "time") -> DataFrame:
    return df.select(F.col(time).alias("cycle")).distinct()


def cadence(df: DataFrame, time: str = "time") -> DataFrame:
    """Gap to the previous cycle; days are ordered on their own and linked by their last cycle."""
    cycles = distinct_cycles(df, time).withColumn("_day", F.to_date("cycle"))
    carry = latest_before_chunk(cycles, [], "cycle", ["cycle"], "_day")
    before = F.coalesce(F.lag("cycle").over(W.partitionBy("_day").orderBy("cycle")), F.col("_prev.cycle"))
    return (
        cycles.join(carry, "_day")
        .withColumn("_before", before)
        .select("cycle", seconds_between("cycle", "_before").alias("gap_seconds"))
    )


def drift_state(health: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Flag of the newest check (at or above the limit); no check gives no row."""
    newest = health.groupBy().agg(F.max_by("ks_drift", "checked_at").alias("_ks"), F.count(F.lit(1)).alias("_n"))
    flag = F.coalesce(F.col("_ks"), F.lit(0.0)) >= settings.drift_ks_max
    return newest.where(F.col("_n") > 0).select(flag.cast("int").alias("drift"))


def drift_history(health: DataFrame, since: Column | None = None) -> DataFrame:
    rows = health if since is None else health.where(F.col("checked_at") >= since)
    return rows.select("checked_at", "ks_drift", "live_anomaly_rate").orderBy("checked_at")


def health_panel(features: DataFrame, baseline: DataFrame) -> DataFrame:
    """p50 and p99 of every cycle with the seasonal band of p99, error rates and load."""
    return with_baseline(features, baseline, ("p99_ms",)).select(
        "time", "endpoint_id", "p50_ms", "p99_ms",
        *[F.col(f"b_p99_ms.{p}").alias(f"band_{p}") for p in ("p10", "p50", "p90")],
        "error_rate_5xx", "error_rate_4xx", "rps",
    )


def layer_timeline(anomalies: DataFrame) -> DataFrame:
    """Score per layer over time, in long form."""
    layers = F.col("contributing.layers")
    items = F.array(
        *[F.struct(F.lit(n).alias("layer"), layers[n].alias("score")) for n in ("static", "baseline", "iforest")],
        F.struct(F.lit("combined").alias("layer"), F.col("contributing.combined").alias("score")),
    )
    return anomalies.select(F.col("detected_at").alias("time"), "endpoint_id", F.inline(items))


def annotations(episodes: DataFrame, deploys: DataFrame) -> DataFrame:
    """Firings, resolutions and deployments in one list."""
    fired = episodes.select(F.col("opened_at").alias("time"), F.lit("firing").alias("kind"),
                            F.concat_ws(" ", "endpoint_id", "signal_type").alias("label"))
    resolved = episodes.where(F.col("resolved_at").isNotNull()).select(
        F.col("resolved_at").alias("time"), F.lit("resolved").alias("kind"),
        F.concat_ws(" ", "endpoint_id", "signal_type").alias("label"))
    released = deploys.select(F.col("deployed_at").alias("time"), F.lit("deploy").alias("kind"),
                              F.concat_ws(" ", "service", "version").alias("label"))
    return fired.unionByName(resolved).unionByName(released).orderBy("time", "kind", "label")


def latest_anomaly(anomalies: DataFrame) -> DataFrame:
    """Newest assessment of every endpoint; a mergeable latest-by-key."""
    rest = [c for c in anomalies.columns if c != "endpoint_id"]
    return anomalies.groupBy("endpoint_id").agg(
        F.max_by(F.struct(*rest), "detected_at").alias("_a")
    ).select("endpoint_id", "_a.*")


def alerts_list(
    episodes: DataFrame, service: str | None = None, state: str | None = None,
    severity: str | None = None, since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    out = episodes
    for name, value in (("service", service), ("state", state), ("severity", severity)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if since is not None:
        out = out.where(F.col("opened_at") >= since)
    if until is not None:
        out = out.where(F.col("opened_at") <= until)
    return out


def detector_metrics(anomalies: DataFrame, log: DataFrame, explained: DataFrame) -> DataFrame:
    """Counters of the detector as (metric, value) rows."""
    a = anomalies.agg(
        F.count(F.lit(1)).alias("anomaly_writes"), F.count_distinct("endpoint_id").alias("endpoints_with_features")
    ).unpivot([], ["anomaly_writes", "endpoints_with_features"], "metric", "value")
    t = log.agg(
        F.count_if((F.col("state") == "firing") & (F.col("prev_state") != "firing")).alias("firing_transitions"),
        F.count_if((F.col("state") == "ok") & (F.col("prev_state") != "ok")).alias("resolved_transitions"),
    ).unpivot([], ["firing_transitions", "resolved_transitions"], "metric", "value")
    e = explained.agg(
        F.count_if(F.col("explanation.fallback")).alias("explanations_template"),
        F.count_if(~F.col("explanation.fallback")).alias("explanations_model"),
    ).unpivot([], ["explanations_template", "explanations_model"], "metric", "value")
    return a.unionByName(t).unionByName(e)


def response_run_stats(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Quality and latency statistics of explanation runs per key.

    Latency percentiles use the nearest rank ``int(n * p)`` over successful runs; the groups are
    few and may be huge, so they come from the two-pass quantile.
    """
    marks = ("correctness", "quality", "checks_actionability", "cause_calibration")
    failed = F.col("error").isNotNull()
    totals = sum((F.col(f"judge_score.{m}") for m in marks), F.lit(0))
    base = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failed).alias("errors"),
        F.avg(F.col("valid_json").cast("double")).alias("json_valid_rate"),
        F.avg(F.col("valid_schema").cast("double")).alias("schema_valid_rate"),
        F.avg(F.when(~failed, F.col("latency_ms"))).alias("latency_mean_ms"),
        F.avg("input_tokens").alias("input_tokens_mean"),
        F.avg("output_tokens").alias("output_tokens_mean"),
        F.avg("judge_score.correctness").alias("score_correctness_mean"),
        F.avg("judge_score.quality").alias("score_quality_mean"),
        F.avg("judge_score.checks_actionability").alias("score_checks_mean"),
        F.avg("judge_score.cause_calibration").alias("score_calibration_mean"),
        F.avg(totals).alias("score_total_mean"),
    )
    good = runs.where(~failed)
    middle = exact_quantiles(good, keys, "latency_ms", {"latency_median_ms": 0.5})
    high = exact_quantiles(
        good, keys, "latency_ms", {"latency_p90_ms": 0.9, "latency_p95_ms": 0.95}, nearest_rank=True
    )
    return base.join(middle, keys, "left").join(high, keys, "left")
