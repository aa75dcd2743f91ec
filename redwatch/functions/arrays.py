"""Expressions over small arrays: percentile with linear interpolation, pairwise slopes, top-k."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def sorted_percentile(sorted_array: str, q: float) -> Column:
    """Linear-interpolated percentile of an ascending array column; null for an empty one."""
    a, pos = sorted_array, f"((size({sorted_array}) - 1) * {float(q)}D)"
    lo, hi = f"get({a}, int(floor({pos})))", f"get({a}, int(ceil({pos})))"
    return F.expr(f"CASE WHEN size({a}) > 0 THEN {lo} + ({hi} - {lo}) * ({pos} - floor({pos})) END")


def pairwise_slopes(series: str) -> Column:
    """Ascending slopes (y_j - y_i) / (j - i) over all pairs i < j of a short array column."""
    y = series
    one = f"transform(sequence(i + 1, size({y}) - 1), j -> (get({y}, j) - get({y}, i)) / double(j - i))"
    return F.expr(
        f"CASE WHEN size({y}) >= 2 THEN sort_array(flatten(transform(sequence(0, size({y}) - 2), i -> {one}))) "
        "ELSE cast(array() AS array<double>) END"
    )


def theil_sen(slopes, series, min_points: int) -> Column:
    """Median pairwise slope, 0 for a series that is too short."""
    return F.when(F.size(col(series)) >= min_points, sorted_percentile(slopes, 0.5)).otherwise(0.0)


def top_by_abs(names, values, k: int) -> Column:
    """The k named values of largest absolute size, first name wins ties."""
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("name"), v.alias("score"), F.lit(i).alias("pos"))
            for i, (n, v) in enumerate(zip(names, values))
        ]
    )
    ordered = F.array_sort(
        pairs,
        lambda a, b: F.when(F.abs(a["score"]) > F.abs(b["score"]), -1)
        .when(F.abs(a["score"]) < F.abs(b["score"]), 1)
        .otherwise(a["pos"] - b["pos"]),
    )
    return F.transform(
        F.slice(ordered, 1, k),
        lambda p: F.struct(p["name"].alias("name"), p["score"].alias("score")),
    )
