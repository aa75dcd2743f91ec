"""Scalar column expressions: finite guards, bands, directions, dates, text matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def finite_or_null(c) -> Column:
    c = col(c)
    return F.when(is_finite(c), c)


def half_even(c, digits: int) -> Column:
    """Round half to even on the binary value."""
    scale = F.lit(float(10**digits))
    return F.rint(col(c) * scale) / scale


def clean_round(c, digits: int = 2) -> Column:
    """NaN becomes null, everything else is rounded half-even."""
    c = col(c)
    return F.when(~F.isnan(c), half_even(c, digits))


def clamp(c, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col(c)))


def safe_ratio(num, den) -> Column:
    num, den = col(num), col(den)
    ok = is_finite(num) & is_finite(den) & (F.abs(den) >= 1e-6)
    return F.when(ok, num / den).otherwise(0.0)


def signed_deviation(value, low, high) -> Column:
    """Two-sided distance from the band in band widths; 0 inside or without a usable band."""
    value, low, high = col(value), col(low), col(high)
    band = high - low
    usable = is_finite(value) & is_finite(low) & is_finite(high) & (band >= 1e-6)
    return (
        F.when(usable & (value > high), (value - high) / band)
        .when(usable & (value < low), (value - low) / band)
        .otherwise(0.0)
    )


def one_sided_deviation(value, low, high) -> Column:
    """Distance above the band only, with a small constant against a zero width."""
    value, low, high = col(value), col(low), col(high)
    above = low.isNotNull() & high.isNotNull() & (value > high)
    return F.when(above, (value - high) / (high - low + 1e-6)).otherwise(0.0)


def direction_of(value, low, high) -> Column:
    value, low, high = col(value), col(low), col(high)
    known = is_finite(value) & low.isNotNull() & high.isNotNull()
    return (
        F.when(known & (value > high), "degradation")
        .when(known & (value < low), "improvement")
        .otherwise("normal")
    )


def status_of_direction(direction) -> Column:
    direction = col(direction)
    return (
        F.when(direction == "degradation", "degraded")
        .when(direction == "improvement", "improved")
        .when(direction.isNotNull(), "normal")
        .otherwise("unknown")
    )


def day_of_week(ts) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(col(ts)) - 1).cast("int")


def seconds_between(later, earlier) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1e6)


def plus_seconds(ts, seconds) -> Column:
    if isinstance(seconds, Column):
        return F.timestamp_micros(F.unix_micros(col(ts)) + (seconds * 1000000).cast("long"))
    return F.timestamp_micros(F.unix_micros(col(ts)) + F.lit(int(round(seconds * 1000000))))


def cycle_start(ts, cycle_seconds: int) -> Column:
    """Start of the tumbling cycle that holds ``ts``."""
    secs = F.unix_seconds(col(ts))
    return F.timestamp_seconds(secs - F.pmod(secs, F.lit(cycle_seconds)))


def status_class(status, klass: int) -> Column:
    return col(status).between(klass * 100, klass * 100 + 99)


def endpoint_id(method, route) -> Column:
    return F.concat_ws(" ", col(method), col(route))


def endpoint_match(target_endpoint, target_service, endpoint) -> Column:
    """Same endpoint, one name inside the other, or the service name inside the endpoint name."""
    target = F.lower(F.trim(F.coalesce(col(target_endpoint), F.lit(""))))
    service = F.lower(F.coalesce(col(target_service), F.lit("")))
    name = F.lower(F.trim(col(endpoint)))
    return (
        (target == name)
        | ((target != "") & F.contains(name, target))
        | ((name != "") & F.contains(target, name))
        | ((service != "") & F.contains(name, service))
    )


def magnitude_label(source_file) -> Column:
    name = F.lower(F.coalesce(col(source_file), F.lit("")))
    return (
        F.when(F.contains(name, F.lit("stress")), "stress")
        .when(F.contains(name, F.lit("core")), "core")
        .otherwise("all")
    )
