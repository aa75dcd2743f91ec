"""Layered anomaly score of a cycle: static limit, seasonal band, forest, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_SLO_5XX, DEFAULT_SLO_P99_MS, PRODUCTION, Settings
from ..functions.arrays import sorted_percentile
from ..functions.scalars import direction_of, finite_or_null, is_finite, one_sided_deviation, half_even
from .features import top_features

LAYERS = ("static", "baseline", "iforest")


def with_slos(rows: DataFrame, slos: DataFrame) -> DataFrame:
    """Add the limits of the endpoint, or the default limits."""
    out = rows.join(slos, "endpoint_id", "left")
    return out.withColumn(
        "slo_p99_ms", F.coalesce("slo_p99_ms", F.lit(DEFAULT_SLO_P99_MS))
    ).withColumn("slo_error_rate_5xx", F.coalesce("slo_error_rate_5xx", F.lit(DEFAULT_SLO_5XX)))


def layer_scores(rows: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Static and baseline layers and the direction, from p99, its band and the limits."""
    low = finite_or_null(F.col("b_p99_ms.p10"))
    high = finite_or_null(F.col("b_p99_ms.p90"))
    p99, slo = F.col("p99_ms"), F.col("slo_p99_ms")
    return rows.withColumns({
        "p10": low,
        "expected": finite_or_null(F.col("b_p99_ms.p50")),
        "p90": high,
        "direction": direction_of(p99, low, high),
        "static_breach": p99 > slo,
        "static_norm": F.when(
            p99 > slo, F.least(F.lit(1.0), (p99 - slo) / (slo + 1e-6))
        ).otherwise(0.0),
        "baseline_norm": F.least(
            F.lit(1.0), one_sided_deviation(p99, low, high) / F.lit(settings.deviation_scale)
        ),
    })


def combine(rows: DataFrame, settings: Settings = PRODUCTION, ml: str | None = "ml_norm") -> DataFrame:
    """Combined score, decision, layer and severity.

    ``ml`` names the calibrated forest score; it counts only for a degradation.  Without it the
    forest layer is 0.
    """
    ml_norm = F.coalesce(F.col(ml), F.lit(0.0)) if ml else F.lit(0.0)
    out = rows.withColumn("ml_norm", ml_norm).withColumn(
        "ml_gated", F.when(F.col("direction") == "degradation", F.col("ml_norm")).otherwise(0.0)
    )
    base = F.col("baseline_norm") + (1.0 - F.col("baseline_norm")) * F.col("ml_gated")
    floored = F.when(F.col("static_breach"), F.greatest(base, F.col("static_norm"))).otherwise(base)
    out = out.withColumn("combined", F.when(is_finite(floored), floored).otherwise(0.0))
    out = out.withColumn(
        "anomaly", F.col("static_breach") | (F.col("combined") >= settings.fire_threshold)
    )
    scores = [F.col("static_norm"), F.col("baseline_norm"), F.col("ml_gated")]
    strong = sum(((s >= settings.strong_layer).cast("int") for s in scores), F.lit(0))
    top = F.greatest(*scores)
    first_top = F.when(scores[0] == top, LAYERS[0]).when(scores[1] == top, LAYERS[1]).otherwise(LAYERS[2])
    return out.withColumn(
        "layer", F.when(strong >= 2, "combined").when(F.col("anomaly"), first_top)
    ).withColumn(
        "severity",
        F.when(
            (F.col("p99_ms") > F.col("slo_p99_ms") * settings.critical_slo_factor)
            | (F.col("combined") >= settings.critical_score),
            "critical",
        ).otherwise("warning"),
    )


def time_to_degradation(
    series: str = "p99_ms_series", slopes: str = "p99_slopes", slo: str = "slo_p99_ms",
    settings: Settings = PRODUCTION, cycle_seconds: int | None = None,
) -> Column:
    """Struct with the minutes until the trend of p99 meets its limit, or null.

    The point uses the median pairwise slope, the bounds its upper and lower quartile.
    """
    y, limit = F.col(series), F.col(slo)
    per_minute = 60.0 / (cycle_seconds or settings.cycle_seconds)
    now = F.element_at(y, -1)
    slope = sorted_percentile(slopes, 0.5) * per_minute

    def minutes(s: Column) -> Column:
        m = (limit - now) / s
        return F.when((s >= settings.ttd_min_slope) & (m >= 0), m)

    point = minutes(slope)

    def result(mid, low, high, breaching: bool) -> Column:
        return F.struct(
            mid.alias("ttd_minutes"), low.alias("ttd_low"), high.alias("ttd_high"),
            half_even(slope, 2).alias("slope_ms_per_min"), F.lit(breaching).alias("already_breaching"),
        )

    zero = F.lit(0.0)
    usable = (F.size(y) >= 3) & limit.isNotNull()
    return F.when(usable & (now >= limit), result(zero, zero, zero, True)).when(
        usable & (point <= settings.ttd_horizon_minutes),
        result(
            half_even(point, 1),
            half_even(minutes(sorted_percentile(slopes, 0.75) * per_minute), 1),
            half_even(minutes(sorted_percentile(slopes, 0.25) * per_minute), 1),
            False,
        ),
    )


def contributing(settings: Settings = PRODUCTION, top: Column | None = None, ttd: Column | None = None) -> Column:
    """Evidence document of a scored cycle; numbers that are not finite become null."""

    def number(name: str, digits: int) -> Column:
        return half_even(finite_or_null(name), digits)

    ranked = top if top is not None else top_features(settings)
    return F.struct(
        number("combined", 4).alias("combined"),
        F.struct(
            number("static_norm", 4).alias("static"),
            number("baseline_norm", 4).alias("baseline"),
            number("ml_gated", 4).alias("iforest"),
        ).alias("layers"),
        F.col("direction").alias("direction"),
        number("ml_norm", 4).alias("ml_norm"),
        F.transform(
            ranked, lambda p: F.struct(p["name"].alias("name"), finite_or_null(p["score"]).alias("score"))
        ).alias("top_features"),
        (ttd if ttd is not None else F.when(F.col("anomaly"), time_to_degradation(settings=settings))).alias("ttd"),
        F.struct(
            F.lit("p99_ms").alias("metric"),
            number("p99_ms", 2).alias("observed"),
            number("expected", 2).alias("expected"),
            F.when(
                F.col("p10").isNotNull() & F.col("p90").isNotNull(),
                F.array(half_even("p10", 2), half_even("p90", 2)),
            ).alias("band"),
        ).alias("baseline"),
    )


def anomaly_rows(scored: DataFrame, doc: Column | None = None) -> DataFrame:
    """Rows of the anomaly store: one per scored cycle."""
    return scored.select(
        F.sha2(F.concat_ws("|", "endpoint_id", F.unix_micros("time").cast("string")), 256).alias("anomaly_id"),
        "endpoint_id",
        F.lit("p99_ms").alias("signal_type"),
        F.col("time").alias("detected_at"),
        half_even("combined", 4).alias("score"),
        F.coalesce("layer", F.lit("combined")).alias("layer"),
        "direction",
        (doc if doc is not None else contributing()).alias("contributing"),
    )


def signals(scored: DataFrame) -> DataFrame:
    """Two alert signals per scored cycle: latency and 5xx rate.

    ``score`` is 0 for a clean cycle, ``level`` is the value that was compared in any case.
    """
    err, slo = F.col("error_rate_5xx"), F.col("slo_error_rate_5xx")
    bad = F.coalesce(err > slo, F.lit(False))
    latency = F.struct(
        F.lit("p99_ms").alias("signal_type"),
        F.col("anomaly").alias("anomaly"),
        F.when(F.col("anomaly"), F.col("severity")).alias("severity"),
        F.when(F.col("anomaly"), F.col("combined")).otherwise(0.0).alias("score"),
        F.col("p99_ms").alias("raw_value"),
        F.col("layer").alias("layer"),
        F.col("combined").alias("level"),
    )
    errors = F.struct(
        F.lit("error_rate_5xx").alias("signal_type"),
        bad.alias("anomaly"),
        F.when(bad, "critical").alias("severity"),
        F.when(bad, (err - slo) / (slo + 1e-6)).otherwise(0.0).alias("score"),
        err.alias("raw_value"),
        F.when(bad, "static").alias("layer"),
        F.coalesce((err - slo) / (slo + 1e-6), F.lit(0.0)).alias("level"),
    )
    return scored.select("endpoint_id", "service", "time", F.inline(F.array(latency, errors)))


def replay_flags(scored: DataFrame) -> DataFrame:
    """Fire flags of the two detectors: fixed limits only, and all layers."""
    err = F.coalesce(F.col("error_rate_5xx") > F.col("slo_error_rate_5xx"), F.lit(False))
    return scored.withColumn("static_fire", F.col("static_breach") | err).withColumn(
        "layered_fire", F.col("anomaly") | err
    )
