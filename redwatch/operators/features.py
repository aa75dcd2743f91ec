"""Endpoint-relative model features over the last cycles of an endpoint.

The input is one row per (endpoint, cycle), so one endpoint has at most retention / cycle rows
(129 600 for 90 days of minutes) whatever its traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import PRODUCTION, Settings
from ..functions.arrays import pairwise_slopes, theil_sen, top_by_abs
from ..functions.scalars import finite_or_null, safe_ratio, signed_deviation, half_even

SERIES = ("p50_ms", "p95_ms", "p99_ms", "rps", "error_rate_5xx")


def rolling(settings: Settings = PRODUCTION, key: str = "endpoint_id", time: str = "time"):
    return W.partitionBy(key).orderBy(time).rowsBetween(-(settings.window_size - 1), 0)


def rolling_window(rows: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Add the finite p99 and rps series and the last finite value of each metric."""
    w = rolling(settings)
    added = {"window_rows": F.count(F.lit(1)).over(w)}
    for m in ("p99_ms", "rps"):
        added[f"{m}_series"] = F.collect_list(finite_or_null(m)).over(w)
    for m in SERIES:
        last = F.last(finite_or_null(m), ignorenulls=True).over(w)
        added[f"last_{m}"] = F.coalesce(last, F.lit(0.0))
    return rows.withColumns(added)


def _positive(c: Column) -> Column:
    """The value if it can serve as a divisor."""
    return F.when(finite_or_null(c) > 1e-6, c)


def derived_features(rows: DataFrame, settings: Settings = PRODUCTION, extra: tuple[str, ...] = ()) -> DataFrame:
    """Add the seven model features to rows that carry ``b_<metric>`` bands.

    ``extra`` names optional saturation columns; they are added as ``last_<name>``.
    """
    out = rolling_window(rows, settings)
    w = rolling(settings)
    for name in extra:
        last = F.last(finite_or_null(name), ignorenulls=True).over(w)
        out = out.withColumn(f"last_{name}", F.coalesce(last, F.lit(0.0)))
    return from_window(out, settings)


def from_window(rows: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Model features from the columns of ``rolling_window``; no window of its own, so it also
    runs on a stream."""
    out = rows.withColumn("p99_slopes", pairwise_slopes("p99_ms_series"))
    raw_slope = theil_sen("p99_slopes", "p99_ms_series", settings.min_window)
    slope_unit = F.coalesce(_positive(F.col("b_p99_ms.p50")), _positive(F.col("last_p50_ms")), F.lit(1.0))
    rps = F.col("rps_series")
    rps_step = F.when(
        F.size(rps) >= 2, F.element_at(rps, -1) - F.get(rps, F.size(rps) - 2)
    ).otherwise(0.0)
    rps_unit = F.coalesce(_positive(F.col("b_rps.p50")), _positive(F.col("last_rps")))

    def deviation(metric: str) -> Column:
        return signed_deviation(f"last_{metric}", F.col(f"b_{metric}.p10"), F.col(f"b_{metric}.p90"))

    return out.withColumns({
        "baseline_dev_p50": deviation("p50_ms"),
        "baseline_dev_p95": deviation("p95_ms"),
        "baseline_dev_p99": deviation("p99_ms"),
        "feature_error_rate_5xx": F.col("last_error_rate_5xx"),
        "latency_slope": raw_slope / slope_unit,
        "p99_over_p50": safe_ratio("last_p99_ms", "last_p50_ms"),
        "rps_delta": F.coalesce(rps_step / rps_unit, F.lit(0.0)),
    })


def feature_columns(settings: Settings = PRODUCTION) -> list[str]:
    """Column that holds each model feature, in canonical order."""
    return ["feature_error_rate_5xx" if f == "error_rate_5xx" else f for f in settings.features]


def model_inputs(settings: Settings = PRODUCTION) -> list[Column]:
    """The model features in canonical order, rounded to nine decimals.

    Without the rounding the last bits of a sum decide whether a feature varies inside a node, and with it the whole tree below.
    """
    values = [F.col(c).cast("double") for c in feature_columns(settings)]
    return [F.when(F.abs(v) < 1e6, F.floor(v * 1e9 + 0.5) / F.lit(1e9)).otherwise(v) for v in values]


def feature_vector(settings: Settings = PRODUCTION) -> Column:
    return F.array(*model_inputs(settings))


def top_features(settings: Settings = PRODUCTION, k: int = 3) -> Column:
    """The largest feature values by absolute size, as array of (name, score)."""
    ranked = top_by_abs(settings.features, [F.col(c) for c in feature_columns(settings)], k)
    return F.transform(
        ranked, lambda p: F.struct(p["name"].alias("name"), half_even(p["score"], 4).alias("score"))
    )
