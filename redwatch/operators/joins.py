"""Interval and as-of joins as equi-joins.

The time axis is cut into buckets, and buckets into cells of 1, 8, 64 ... of them.  An interval is the union of few whole
cells, large ones inside and small ones at its ends: a dyadic index, at most 14 cells per size however long it
is.  A point lies in one cell of each size and asks for the sizes that occur.  The join is then an equi-join on (keys, size,
cell) plus a range check, so Spark can hash or sort-merge it, split skewed partitions, or broadcast a side when its measured
size allows it.  No hint is given: size decides at run time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import plus_seconds

#: A cell has 2^_BITS cells of the next smaller size.
_BITS = 3
#: Cells reach so far beyond 1970; an interval without an end lasts until then.
_FAR_SECONDS = 10_000 * 366 * 86_400


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("long")


def _sizes(bucket_seconds: int) -> int:
    """Number of cell sizes after which one cell holds all time."""
    return math.ceil(math.log2(_FAR_SECONDS / bucket_seconds) / _BITS)


def interval_cells(intervals: DataFrame, start: str, end: str, bucket_seconds: int) -> DataFrame:
    """One row per cell of each interval, with ``_size`` and ``_cell``; intervals that end before they start have none.

    The cells of an interval are disjoint and cover the buckets of its ends and all between.
    """
    sizes = _sizes(bucket_seconds)
    last = F.lit((1 << _BITS * sizes) - 1)
    wide = intervals.where(F.col(end).isNull() | (F.col(start) <= F.col(end)))
    wide = wide.withColumn("_a", _bucket(F.col(start), bucket_seconds))
    wide = wide.withColumn("_z", F.least(F.coalesce(_bucket(F.col(end), bucket_seconds), last), last) + 1)
    reach = (1 << _BITS + 1) - 2
    # whole cells of a size lie from lo up to hi; those inside whole cells of the next size are left to that one
    cells = F.expr(f"""
        flatten(transform(sequence(0, {sizes}), s -> transform(filter(
          array_union(sequence(-shiftright(-_a, {_BITS} * s), -shiftright(-_a, {_BITS} * s) + {reach}),
                      sequence(shiftright(_z, {_BITS} * s) - {reach}, shiftright(_z, {_BITS} * s))),
          k -> k >= -shiftright(-_a, {_BITS} * s) AND k < shiftright(_z, {_BITS} * s)
            AND (s = {sizes} OR k < -shiftright(-_a, {_BITS} * (s + 1)) * {1 << _BITS} OR k >= shiftright(_z, {_BITS} * (s + 1)) * {1 << _BITS}
              OR -shiftright(-_a, {_BITS} * (s + 1)) >= shiftright(_z, {_BITS} * (s + 1)))),
          k -> struct(s AS _size, k AS _cell))))""")
    return wide.withColumn("_c", F.explode(cells)).select("*", "_c._size", "_c._cell").drop("_a", "_z", "_c")


def _inside(time: str, start: str, end: str, open_start: bool, open_end: bool) -> Column:
    low = F.col(time) > F.col(start) if open_start else F.col(time) >= F.col(start)
    high = F.col(time) < F.col(end) if open_end else F.col(time) <= F.col(end)
    return low & (F.col(end).isNull() | high)


def _probes(points: DataFrame, cells: DataFrame, time: str, bucket_seconds: int) -> DataFrame:
    """Points once for every size that occurs among the cells; once without a cell if there is none."""
    sizes = cells.agg(F.collect_set("_size")).scalar()
    asked = points.withColumn("_s", sizes).withColumn("_ps", F.explode_outer("_s")).drop("_s")
    return asked.withColumn("_pc", F.call_function("shiftright", _bucket(F.col(time), bucket_seconds), F.col("_ps") * _BITS))


def _cell_join(probes: DataFrame, cells: DataFrame, keys: Sequence[str], inside: Column, how: str) -> DataFrame:
    for k in keys:
        cells = cells.withColumnRenamed(k, f"_k_{k}")
    cond = (F.col("_ps") == F.col("_size")) & (F.col("_pc") == F.col("_cell"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return probes.join(cells, cond & inside, how).drop("_ps", "_pc", "_cell", *[f"_k_{k}" for k in keys])


def interval_marks(
    points: DataFrame,
    intervals: DataFrame,
    time: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    name: str = "inside",
    bucket_seconds: int = 3600,
    open_start: bool = False,
    open_end: bool = False,
) -> DataFrame:
    """Points with the flag ``name``: whether some interval of the same ``keys`` contains the point.

    The points are read once and keep their number, however many intervals contain them. All their columns are carried through a
    shuffle, so callers select those they need beforehand.
    """
    keys = list(keys)
    cells = interval_cells(intervals.select(*keys, F.col(start).alias("_from"), F.col(end).alias("_till")), "_from", "_till", bucket_seconds)
    probes = _probes(points.withColumn("_id", F.monotonically_increasing_id()), cells, time, bucket_seconds)
    hits = _cell_join(probes, cells, keys, _inside(time, "_from", "_till", open_start, open_end), "left")
    plain = [F.col(f"`{c}`") for c in points.columns]
    return hits.groupBy("_id", *plain).agg(F.max(F.col("_size").isNotNull()).alias(name)).drop("_id")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    time: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    how: str = "inner",
    bucket_seconds: int = 3600,
    open_start: bool = False,
    open_end: bool = False,
) -> DataFrame:
    """Join each point to the intervals that contain it (closed ends unless opened).

    An interval without an end is still going on: it contains every later point.

    ``how`` is inner, left_semi or left_anti.  ``keys`` are equal-named columns of both
    sides; other column names must not collide.
    """
    keys = list(keys)
    if how == "inner":
        cells = interval_cells(intervals, start, end, bucket_seconds)
        probes = _probes(points, cells, time, bucket_seconds)
        return _cell_join(probes, cells, keys, _inside(time, start, end, open_start, open_end), how).drop("_size")
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"no interval join of the kind {how}")
    marked = interval_marks(points, intervals, time, start, end, keys, "_hit", bucket_seconds, open_start, open_end)
    return marked.where("_hit" if how == "left_semi" else "NOT _hit").drop("_hit")


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    keys: Sequence[str],
    tolerance_seconds: int,
    values: Sequence[str],
    strict: bool = False,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """For each left row the ``values`` of the newest right row within the tolerance before it.

    ``strict`` leaves out a right row at the very same time.  Values are null without a match.

    Both sides are interleaved in time order and the newest right row is carried forward, so no
    pairs are formed.  Time is cut into buckets of one tolerance; a right row also enters the next
    bucket, hence a bucket knows all rows it may need and a busy key spreads over its buckets.
    """
    size = bucket_seconds or max(int(tolerance_seconds), 1)
    if size < tolerance_seconds:
        raise ValueError("buckets must be at least as long as the tolerance")
    # at equal times a left row comes after right rows, or before them when strict
    left_side = F.lit(-1 if strict else 1)
    l = left.select(
        *keys,
        _bucket(F.col(left_time), size).alias("_b"),
        F.col(left_time).alias("_t"),
        left_side.alias("_side"),
        F.struct(*left.columns).alias("_row"),
    )
    r = right.select(
        *keys,
        F.explode(F.array(_bucket(F.col(right_time), size), _bucket(F.col(right_time), size) + 1)).alias("_b"),
        F.col(right_time).alias("_t"),
        F.lit(0).alias("_side"),
        F.struct(F.col(right_time).alias("_from"), *values).alias("_val"),
    )
    upto = (
        W.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    mixed = l.unionByName(r, allowMissingColumns=True).withColumn(
        "_best", F.last("_val", ignorenulls=True).over(upto)
    )
    near = F.col("_best._from") >= plus_seconds("_t", -tolerance_seconds)
    return mixed.where(F.col("_row").isNotNull()).select(
        *[F.col(f"_row.{c}").alias(c) for c in left.columns],
        *[F.when(near, F.col(f"_best.{v}")).alias(v) for v in values],
    )
