"""Rate / error / duration features from spans and from metric samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import LATENCY_BOUNDS_MS, PRODUCTION, Settings
from ..functions.ordered import exact_quantiles, latest_before_chunk, time_bin
from ..functions.scalars import cycle_start, is_finite, plus_seconds, status_class

SERVER = "SPAN_KIND_SERVER"
DIMENSIONS = ("endpoint_id", "service", "service_tier")
EXACT_BINS = 64  # per factor e of latency: some hundred bins per endpoint and cycle
QUANTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


# --------------------------------------------------------------------------- buckets


def bucket_aggs(latency: str = "latency_ms", bounds: Sequence[float] = LATENCY_BOUNDS_MS) -> list[Column]:
    """Cumulative bucket counters le_0 .. le_n; mergeable, so spans combine before the shuffle."""
    aggs = [F.expr(f"count_if({latency} <= {b}D)").alias(f"le_{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(latency).alias(f"le_{len(bounds)}"))
    return aggs


def quantile_from_buckets(q: float, bounds: Sequence[float], prefix: str = "le_") -> Column:
    """Quantile of the cumulative bucket counts with linear interpolation inside the bucket.

    The first bucket starts at zero, the open last bucket answers with the last finite bound and
    an empty histogram gives NaN.
    """
    total = f"double({prefix}{len(bounds)})"
    rank = f"({total} * {q}D)"
    cases = [f"WHEN {total} IS NULL OR {total} = 0 THEN double('NaN')"]
    for i, upper in enumerate(bounds):
        lower, below = (bounds[i - 1], f"{prefix}{i - 1}") if i else (0.0, "0")
        cases.append(
            f"WHEN {prefix}{i} >= {rank} THEN {lower}D + {upper - lower}D * "
            f"(({rank} - {below}) / double({prefix}{i} - {below}))"
        )
    return F.expr(f"CASE {' '.join(cases)} ELSE {float(bounds[-1])}D END")


def span_histogram(
    spans: DataFrame,
    cycle_seconds: int,
    dims: Sequence[str] = ("endpoint_id", "service", "status_code", "span_kind"),
    bounds: Sequence[float] = LATENCY_BOUNDS_MS,
) -> DataFrame:
    """Long bucket samples: one row per (dims, cycle, le) with the cumulative count."""
    wide = spans.groupBy(*dims, cycle_start("ts", cycle_seconds).alias("time")).agg(
        *bucket_aggs(bounds=bounds)
    )
    samples = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("n"))
            for i, b in enumerate([*bounds, float("inf")])
        ]
    )
    return wide.select(*dims, "time", F.inline(samples))


def call_counts(
    spans: DataFrame,
    cycle_seconds: int,
    dims: Sequence[str] = ("endpoint_id", "service", "status_code", "span_kind"),
) -> DataFrame:
    return spans.groupBy(*dims, cycle_start("ts", cycle_seconds).alias("time")).agg(
        F.count(F.lit(1)).alias("calls")
    )


def expire_idle_series(
    samples: DataFrame, keys: Sequence[str], as_of: Column, expiry_seconds: int = 300, time: str = "time"
) -> DataFrame:
    """Series without a sample in the last ``expiry_seconds`` are dropped."""
    alive = samples.groupBy(*keys).agg(F.max(time).alias("_seen"))
    alive = alive.where(F.col("_seen") >= plus_seconds(as_of, -expiry_seconds)).select(*keys)
    return samples.join(alive, list(keys), "left_semi")


def sum_by_le(histogram: DataFrame, dims: Sequence[str] = ("endpoint_id", "service", "time")) -> DataFrame:
    return histogram.groupBy(*dims, "le").agg(F.sum("n").alias("n"))


def histogram_quantile(
    buckets: DataFrame, q: float, dims: Sequence[str], name: str = "value", count: str = "n"
) -> DataFrame:
    """Quantile per group from long (le, cumulative count) rows; a group is one row per bound."""
    w = W.partitionBy(*dims).orderBy("le")
    placed = buckets.select(
        *dims,
        "le",
        F.col(count).cast("double").alias("_n"),
        F.coalesce(F.lag(F.col(count).cast("double")).over(w), F.lit(0.0)).alias("_below"),
        F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("_lower"),
        F.max(F.col(count).cast("double")).over(W.partitionBy(*dims)).alias("_total"),
    )
    rank = F.col("_total") * F.lit(q)
    estimate = F.when(F.col("le") == F.lit(float("inf")), F.col("_lower")).otherwise(
        F.col("_lower")
        + (F.col("le") - F.col("_lower")) * ((rank - F.col("_below")) / (F.col("_n") - F.col("_below")))
    )
    hit = (F.col("_n") >= rank) & (F.col("_total") > 0)
    return placed.groupBy(*dims).agg(
        F.coalesce(
            F.min_by(F.when(hit, estimate), F.when(hit, F.col("le"))), F.lit(float("nan"))
        ).alias(name)
    )


# --------------------------------------------------------------------------- counters


def counter_increase(
    samples: DataFrame, series: Sequence[str], chunk_seconds: int, time: str = "ts", value: str = "value"
) -> DataFrame:
    """Increase of a cumulative counter since its previous sample; a drop counts from zero.

    Each (series, time chunk) is ordered on its own and receives the last value of the chunk
    before it, so one busy series spreads over many tasks.
    """
    df = samples.withColumn("_chunk", time_bin(time, chunk_seconds))
    carry = latest_before_chunk(df, series, time, [value], "_chunk")
    w = W.partitionBy(*series, "_chunk").orderBy(time)
    prev = F.coalesce(F.lag(value).over(w), F.col("_prev").getField(value))
    v = F.col(value)
    return (
        df.join(carry, [*series, "_chunk"])
        .withColumn("_p", prev)
        .withColumn("increase", F.when(v < F.col("_p"), v).otherwise(v - F.col("_p")))
        .drop("_chunk", "_prev", "_p")
    )


def counter_rate(
    samples: DataFrame,
    series: Sequence[str],
    range_seconds: int,
    chunk_seconds: int | None = None,
    time: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Per-second rate of a counter for each aligned range of ``range_seconds``."""
    inc = counter_increase(samples, series, chunk_seconds or range_seconds, time, value)
    return inc.groupBy(*series, cycle_start(time, range_seconds).alias("time")).agg(
        (F.coalesce(F.sum("increase"), F.lit(0)) / F.lit(float(range_seconds))).alias("rate")
    )


def call_rate_per_minute(samples: DataFrame, series: Sequence[str], range_seconds: int = 900) -> DataFrame:
    return counter_rate(samples, series, range_seconds).select(
        *series, "time", (F.col("rate") * 60).alias("calls_per_minute")
    )


# --------------------------------------------------------------------------- RED features


def red_aggs(rate_seconds: int) -> list[Column]:
    """Counters of one feature window; all are sums."""
    return [
        *bucket_aggs(),
        F.count(F.lit(1)).alias("calls"),
        F.count_if(status_class("status_code", 5)).alias("n5"),
        F.count_if(status_class("status_code", 4)).alias("n4"),
        (F.count(F.lit(1)) / F.lit(float(rate_seconds))).alias("rps"),
    ]


def red_projection() -> list[Column]:
    """Feature columns from the counters of ``red_aggs``."""
    return [
        *[quantile_from_buckets(q, LATENCY_BOUNDS_MS).alias(n) for n, q in QUANTILES.items()],
        F.coalesce(100.0 * F.col("n5") / F.nullif(F.col("calls"), F.lit(0)), F.lit(0.0)).alias("error_rate_5xx"),
        F.coalesce(100.0 * F.col("n4") / F.nullif(F.col("calls"), F.lit(0)), F.lit(0.0)).alias("error_rate_4xx"),
    ]


def server_spans(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("span_kind") == SERVER)


def red_features(spans: DataFrame, settings: Settings = PRODUCTION, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """One row per endpoint and cycle; quantiles interpolate in the latency histogram.

    A single shuffle of partial counters: each map task sends at most one row per (endpoint,
    cycle), whatever the traffic of the endpoint.
    """
    counters = (
        server_spans(spans)
        .groupBy(*dims, cycle_start("ts", settings.cycle_seconds).alias("time"))
        .agg(*red_aggs(settings.cycle_seconds))
    )
    return counters.select("time", *dims, "rps", *red_projection(), F.col("calls").alias("span_count"))


def red_features_exact(
    spans: DataFrame, settings: Settings = PRODUCTION, dims: Sequence[str] = DIMENSIONS
) -> DataFrame:
    """The same features with exact interpolated quantiles instead of histogram ones.

    For audits: it reads the spans twice and moves only those in the value bins that hold a
    wanted rank, so a window with very many spans is not gathered in one task.
    """
    work = server_spans(spans).withColumn("time", cycle_start("ts", settings.cycle_seconds))
    keys = [*dims, "time"]
    counters = work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(status_class("status_code", 5)).alias("n5"),
        F.count_if(status_class("status_code", 4)).alias("n4"),
    )
    quant = exact_quantiles(work, keys, "latency_ms", QUANTILES, per_e_fold=EXACT_BINS)
    return counters.join(quant, keys, "left").select(
        "time",
        *dims,
        (F.col("calls") / F.lit(float(settings.cycle_seconds))).alias("rps"),
        *QUANTILES,
        (100.0 * F.col("n5") / F.col("calls")).alias("error_rate_5xx"),
        (100.0 * F.col("n4") / F.col("calls")).alias("error_rate_4xx"),
        F.col("calls").alias("span_count"),
    )


def sliding_red_features(
    spans: DataFrame, window_seconds: int = 300, slide_seconds: int = 60, dims: Sequence[str] = DIMENSIONS
) -> DataFrame:
    """Overlapping windows, batch or stream.

    Spans are first reduced to one row per (endpoint, slide step); only these partial counters
    are repeated for each window they belong to.
    """
    win = F.window("ts", f"{window_seconds} seconds", f"{slide_seconds} seconds")
    if spans.isStreaming:
        counters = server_spans(spans).groupBy(win.alias("w"), *dims).agg(*red_aggs(window_seconds))
        counters = counters.withColumn("time", F.col("w.start"))
    else:
        steps = (
            server_spans(spans)
            .groupBy(*dims, cycle_start("ts", slide_seconds).alias("ts"))
            .agg(*[a for a in red_aggs(window_seconds)[:-1]])
        )
        names = [c for c in steps.columns if c not in (*dims, "ts")]
        counters = (
            steps.groupBy(win.alias("w"), *dims)
            .agg(*[F.sum(n).alias(n) for n in names])
            .withColumn("time", F.col("w.start"))
            .withColumn("rps", F.col("calls") / F.lit(float(window_seconds)))
        )
    return counters.select("time", *dims, "rps", *red_projection(), F.col("calls").alias("span_count"))


def valid_features(features: DataFrame) -> DataFrame:
    """Cycles with a usable p99."""
    return features.where(is_finite("p99_ms"))


def drop_incomplete(features: DataFrame, key: str = "endpoint_id", time: str = "time") -> DataFrame:
    """Leave out the newest cycle of each endpoint unless it is the only one.

    Only the newest time and a row count per endpoint are grouped (mergeable), then joined back.
    """
    last = features.groupBy(key).agg(F.max(time).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    return (
        features.join(last, key)
        .where((F.col("_rows") == 1) | (F.col(time) < F.col("_last")))
        .drop("_last", "_rows")
    )


# --------------------------------------------------------------------------- cardinality


def quarantine_missing_route(spans: DataFrame) -> DataFrame:
    """Spans without a route go to one quarantine endpoint instead of opening new series."""
    missing = F.col("route").isNull() | (F.trim("route") == "")
    return spans.withColumn("endpoint_id", F.when(missing, "quarantine").otherwise(F.col("endpoint_id")))


def cap_endpoints(spans: DataFrame, limit: int) -> DataFrame:
    """Keep the ``limit`` busiest endpoints by name; the spans of the rest count as ``other``.

    No span is lost.  The kept list has at most ``limit`` rows.
    """
    kept = (
        spans.groupBy("endpoint_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), "endpoint_id")
        .limit(limit)
        .select("endpoint_id", F.lit(True).alias("_kept"))
    )
    return (
        spans.join(kept, "endpoint_id", "left")
        .withColumn("endpoint_id", F.when(F.col("_kept"), F.col("endpoint_id")).otherwise("other"))
        .drop("_kept")
    )


def min_over_time(samples: DataFrame, series: Sequence[str], range_seconds: int) -> DataFrame:
    """Minimum of a gauge per aligned range."""
    return samples.groupBy(*series, cycle_start("ts", range_seconds).alias("time")).agg(
        F.min("value").alias("min_value")
    )
