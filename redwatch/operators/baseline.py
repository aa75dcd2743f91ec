"""Seasonal baseline: quantiles by weekday and hour, fallbacks, lookup and exclusion of faults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BASELINE_METRICS, PRODUCTION, Settings
from ..functions.ordered import exact_quantiles
from ..functions.scalars import day_of_week, plus_seconds
from .joins import interval_join

LOOKUP_METRICS = ("p50_ms", "p95_ms", "p99_ms", "rps")
BAND = ("p10", "p50", "p90")


def lookback(features: DataFrame, as_of: Column, days: int, time: str = "time") -> DataFrame:
    """Rows of the ``days`` before ``as_of``; nothing from then on."""
    return features.where((F.col(time) >= plus_seconds(as_of, -days * 86400)) & (F.col(time) < as_of))


def exclude_injections(
    rows: DataFrame, injections: DataFrame, margin_seconds: int, time: str = "time", bucket_seconds: int = 3600
) -> DataFrame:
    """Rows in no fault window widened by the margin."""
    wide = injections.select(
        plus_seconds("injected_at", -margin_seconds).alias("_from"),
        plus_seconds("cleared_at", margin_seconds).alias("_to"),
    )
    return interval_join(rows, wide, time, "_from", "_to", (), "left_anti", bucket_seconds)


def metric_long(features: DataFrame, metrics: Sequence[str] = BASELINE_METRICS) -> DataFrame:
    """One row per (endpoint, time, metric), NaN and null values removed."""
    return (
        features.select("time", "endpoint_id", *metrics)
        .unpivot(["time", "endpoint_id"], list(metrics), "metric", "value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def seasonal_baseline(
    features: DataFrame,
    injections: DataFrame,
    as_of: Column,
    settings: Settings = PRODUCTION,
    metrics: Sequence[str] = BASELINE_METRICS,
) -> DataFrame:
    """p10 / p50 / p90 per (endpoint, metric, weekday, hour) of fault-free history.

    A group holds one row per cycle of one weekday hour in the lookback (120 with the production
    numbers), so the exact native percentile is bounded; all metrics share one scan and shuffle.
    """
    history = exclude_injections(
        lookback(features, as_of, settings.baseline_days), injections, settings.injection_margin_seconds
    )
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return (
        metric_long(history, metrics)
        .groupBy(
            "endpoint_id", "metric",
            day_of_week("time").alias("dow"), F.hour("time").alias("hour_bucket"),
        )
        .agg(q.alias("_q"), F.count(F.lit(1)).alias("sample_count"))
        .where(F.col("sample_count") >= settings.baseline_min_samples)
        .select(
            "endpoint_id", "metric", "dow", "hour_bucket",
            *[F.col("_q")[i].alias(n) for i, n in enumerate(BAND)],
            "sample_count",
            as_of.alias("updated_at"),
        )
    )


def baseline_fallback(baseline: DataFrame) -> DataFrame:
    """Widest band of an endpoint and metric over all its buckets."""
    return baseline.groupBy("endpoint_id", "metric").agg(
        F.min("p10").alias("p10"), F.avg("p50").alias("p50"), F.max("p90").alias("p90")
    )


def baseline_global(
    features: DataFrame, injections: DataFrame, as_of: Column, settings: Settings = PRODUCTION,
    metrics: Sequence[str] = BASELINE_METRICS,
) -> DataFrame:
    """Quantiles per metric over all endpoints; few huge groups, so the two-pass quantile."""
    history = exclude_injections(
        lookback(features, as_of, settings.baseline_days), injections, settings.injection_margin_seconds
    )
    return exact_quantiles(
        metric_long(history, metrics), ["metric"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    )


def _wide(baseline: DataFrame, keys: Sequence[str], metrics: Sequence[str], prefix: str) -> DataFrame:
    """One row per key with a band struct per metric; null where the metric has no row."""
    band = F.struct(*BAND)
    return baseline.groupBy(*keys).agg(
        *[F.first(F.when(F.col("metric") == m, band), ignorenulls=True).alias(f"{prefix}{m}") for m in metrics]
    )


def with_baseline(
    rows: DataFrame,
    baseline: DataFrame,
    metrics: Sequence[str] = LOOKUP_METRICS,
    time: str = "time",
    global_baseline: DataFrame | None = None,
) -> DataFrame:
    """Add ``b_<metric>`` band structs: exact weekday-hour bucket, else the endpoint's fallback.

    Whether the exact bucket exists decides, not whether its values are null.  With
    ``global_baseline`` a third level answers when the endpoint has no history at all.
    """
    exact = _wide(baseline, ("endpoint_id", "dow", "hour_bucket"), metrics, "_e_")
    fall = _wide(baseline_fallback(baseline), ("endpoint_id",), metrics, "_f_")
    out = (
        rows.withColumn("dow", day_of_week(time))
        .withColumn("hour_bucket", F.hour(time))
        .join(exact, ["endpoint_id", "dow", "hour_bucket"], "left")
        .join(fall, ["endpoint_id"], "left")
    )
    bands = {}
    for m in metrics:
        levels = [F.col(f"_e_{m}"), F.col(f"_f_{m}")]
        if global_baseline is not None:
            # at most one row per metric: a scalar subquery
            one = global_baseline.where(F.col("metric") == m).select(F.struct(*BAND))
            levels.append(one.scalar())
        bands[f"b_{m}"] = F.coalesce(*levels)
    out = out.withColumns(bands)
    helper = [c for c in out.columns if c[:3] in ("_e_", "_f_")]
    return out.drop(*helper, "dow", "hour_bucket")
