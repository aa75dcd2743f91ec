"""Global order without a global sort in one task.

A plain ``Window.orderBy`` over few keys sends all rows of a key to one task.  Here values are
first cut into many narrow, monotone bins.  Only per-bin totals (bounded by the number of bins)
meet in one task; the rows themselves are sorted per (key, bin).  A bin that holds too many rows is
cut again between its own smallest and largest value, level by level, until each bin fits or
holds a single value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import stored
from .scalars import col

BINS_PER_E_FOLD = 256
#: Rows of a bin beyond which it is cut again, and the smallest and largest number of parts.
CROWD = 200_000
CUTS = (32, 1024)


def value_bin(value, per_e_fold: int = BINS_PER_E_FOLD) -> Column:
    """Monotone bin of a number: about 0.4 % relative width, finer around zero."""
    v = col(value)
    # values below one get an extra factor, so that scores in [0, 1] spread over many bins too
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * 16.0) * per_e_fold).cast("long")


def time_bin(ts, seconds: int) -> Column:
    return F.floor(F.unix_seconds(col(ts)) / F.lit(seconds)).cast("long")


def _cut() -> Column:
    """Monotone part of ``_v`` between the smallest and largest value of its bin, which part for sure."""
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    width, endless = hi - lo, F.lit(float("inf"))
    beyond = F.when(lo == -endless, v > lo).otherwise(v >= hi).cast("long")
    return F.when(width == endless, beyond).otherwise(F.floor((v - lo) / width * F.col("_cuts")).cast("long"))


def _crowded(crowd: int) -> Column:
    # NaN counts as largest and cannot be cut off by width
    return (F.col("_n") > crowd) & (F.col("_lo") < F.col("_hi")) & ~F.isnan("_hi")


def _cuts(crowd: int) -> Column:
    """About eight parts per ``crowd`` rows, so that the number of all bins follows the rows / ``crowd``."""
    return F.least(F.lit(CUTS[1]), F.greatest(F.lit(CUTS[0]), F.ceil(F.col("_n") * 8 / crowd))).alias("_cuts")


def _extent(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def refined_bins(
    df: DataFrame, keys: Sequence[str], value: Column, first: Column, crowd: int = CROWD
) -> DataFrame:
    """Add ``_bin``, a path of part numbers; paths compare as the values do.

    ``first`` is the bin of the first level, monotone in ``value``.  Every bin of more than
    ``crowd`` rows and more than one value is cut again (``CUTS``); a level reads the rows of the
    level before, and its table has at most rows / ``crowd`` entries.  A bin of one value stays, however
    many rows it has: count equal values beforehand.  Each level takes five to ten bits off the range.
    """
    keys = list(keys)
    work = df.withColumn("_v", value.cast("double")).withColumn("_bin", F.array(first.cast("long")))
    level = 1
    while True:
        crowded = stored(
            _extent(work.where(F.size("_bin") == level), keys)
            .where(_crowded(crowd))
            .select(*keys, "_bin", "_lo", "_hi", _cuts(crowd)),
            "crowded",
        )
        if crowded.isEmpty():
            return work.drop("_v")
        part = F.concat("_bin", F.array(_cut()))
        work = (
            work.join(crowded, [*keys, "_bin"], "left")
            .withColumn("_bin", F.when(F.col("_lo").isNull(), F.col("_bin")).otherwise(part))
            .drop("_lo", "_hi", "_cuts")
        )
        level += 1


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    bin_expr: Column | None,
    with_ties: bool = True,
    refine: Column | None = None,
    crowd: int = CROWD,
) -> DataFrame:
    """Add cumulative sums in ascending ``order`` (ties included, as a RANGE frame).

    ``bin_expr`` must be monotone in ``order``.  Without it the bins are range partitions cut by
    Spark from a sample, which also splits crowded stretches of the order; they are written once
    so that a repeated task sees the same bins.  With ``refine``, ``order`` as a number, bins of more
    than ``crowd`` rows are cut again (``refined_bins``); ``df`` should then be cheap to read.
    ``with_ties=False`` gives a ROWS frame for a unique order.
    """
    keys = list(keys)
    if bin_expr is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(parts, *keys, order)
        work = stored(ranged.withColumn("_bin", F.spark_partition_id()), "ranged")
    elif refine is not None:
        work = refined_bins(df, keys, refine, bin_expr, crowd)
    else:
        work = df.withColumn("_bin", bin_expr)
    for name, expr in sums.items():
        work = work.withColumn(f"_in_{name}", expr)
    before = (
        W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        work.groupBy(*keys, "_bin")
        .agg(*[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums])
        .select(
            *keys,
            "_bin",
            *[F.coalesce(F.sum(f"_tot_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
        )
    )
    inside = W.partitionBy(*keys, "_bin").orderBy(order)
    inside = (
        inside.rangeBetween(W.unboundedPreceding, W.currentRow)
        if with_ties
        else inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    joined = work.join(offsets, [*keys, "_bin"])
    for n in sums:
        joined = joined.withColumn(n, F.sum(f"_in_{n}").over(inside) + F.col(f"_off_{n}"))
    drop = ["_bin"] + [f"_in_{n}" for n in sums] + [f"_off_{n}" for n in sums]
    return joined.drop(*drop)


def _rank_structs(probs: dict[str, float], nearest_rank: bool) -> Column:
    """Wanted ranks (from 0) of a group of ``_total`` rows, one struct per probability."""
    ranks = []
    for name, q in probs.items():
        if nearest_rank:
            lo = F.least(F.floor(F.col("_total") * F.lit(q)), F.col("_total") - 1)
            hi, frac = lo, F.lit(0.0)
        else:
            pos = (F.col("_total") - 1) * F.lit(float(q))
            lo, hi = F.floor(pos), F.ceil(pos)
            frac = pos - lo
        ranks.append(
            F.struct(
                F.lit(name).alias("name"), lo.cast("long").alias("lo"),
                hi.cast("long").alias("hi"), frac.cast("double").alias("frac"),
            )
        )
    return F.array(*ranks)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    nearest_rank: bool = False,
    per_e_fold: int = BINS_PER_E_FOLD,
    crowd: int = CROWD,
) -> DataFrame:
    """Exact quantiles of few, possibly huge groups: one row per key, one column per probability.

    Pass one counts rows per value bin.  Pass two reads only the bins that hold a wanted rank and
    sorts inside them; while such a bin has more than ``crowd`` rows and more than one value, a pass
    between cuts it again and keeps only the parts with a wanted rank.  Nulls and NaN are ignored.
    ``nearest_rank`` takes element ``int(n * q)`` (bounded by the last one) instead of interpolating.
    Coarser bins (``per_e_fold``) suit many smaller groups: fewer counters in pass one, more rows in
    pass two.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_bin", F.array(value_bin("_v", per_e_fold)))

    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    bins = _extent(rows, keys).withColumns({
        "_before": F.sum("_n").over(part.orderBy("_bin")) - F.col("_n"),
        "_total": F.sum("_n").over(part),
    })
    holds = lambda at: (at >= F.col("_before")) & (at < F.col("_before") + F.col("_n"))
    placed = None
    while True:
        ranks = F.filter(_rank_structs(probs, nearest_rank), lambda r: holds(r["lo"]) | holds(r["hi"]))
        # written once: a few bins per key, read by the choice of rows and the next level
        wanted = stored(bins.withColumn("_ranks", ranks).where(F.size("_ranks") > 0), "wanted")
        small = wanted.where(~_crowded(crowd)).select(*keys, "_bin", "_before", "_ranks")
        counts = (
            rows.join(small.select(*keys, "_bin"), [*keys, "_bin"], "left_semi")
            .groupBy(*keys, "_bin", "_v")
            .agg(F.count(F.lit(1)).alias("_c"))
        )
        upto = F.sum("_c").over(W.partitionBy(*keys, "_bin").orderBy("_v"))
        found = (
            counts.withColumn("_upto", upto)
            .join(small, [*keys, "_bin"])
            .withColumn("_last", F.col("_before") + F.col("_upto") - 1)
            .withColumn("_first", F.col("_last") - F.col("_c") + 1)
            .withColumn("_r", F.explode("_ranks"))
            .select(*keys, "_v", "_first", "_last", "_r")
        )
        placed = found if placed is None else placed.unionByName(found)
        crowded = wanted.where(_crowded(crowd))
        if crowded.isEmpty():
            break
        above = crowded.select(*keys, F.col("_bin").alias("_up"), F.col("_before").alias("_start"), "_total")
        rows = rows.join(crowded.select(*keys, "_bin", "_lo", "_hi", _cuts(crowd)), [*keys, "_bin"]).select(
            *keys, "_v", F.concat("_bin", F.array(_cut())).alias("_bin")
        )
        inside = W.partitionBy(*keys, "_up").orderBy("_bin")
        bins = (
            _extent(rows, keys)
            .withColumn("_up", F.expr("slice(_bin, 1, size(_bin) - 1)"))
            .join(above, [*keys, "_up"])
            .withColumn("_before", F.col("_start") + F.sum("_n").over(inside) - F.col("_n"))
            .drop("_up", "_start")
        )
    aggs = []
    for name in probs:
        mine = F.col("_r.name") == name
        at_lo = F.max(F.when(mine & F.col("_r.lo").between(F.col("_first"), F.col("_last")), F.col("_v")))
        at_hi = F.max(F.when(mine & F.col("_r.hi").between(F.col("_first"), F.col("_last")), F.col("_v")))
        frac = F.max(F.when(mine, F.col("_r.frac")))
        aggs.append(F.when(frac > 0, at_lo + (at_hi - at_lo) * frac).otherwise(at_lo).alias(name))
    return placed.groupBy(*keys).agg(*aggs)


def latest_before_chunk(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], chunk: str
) -> DataFrame:
    """Per (key, chunk): the last ``values`` of the preceding non-empty chunk, as ``_prev``."""
    keys = list(keys)
    tail = df.groupBy(*keys, chunk).agg(
        F.max_by(F.struct(*values), F.col(order)).alias("_tail")
    )
    w = W.partitionBy(*keys).orderBy(chunk)
    return tail.select(*keys, chunk, F.lag("_tail").over(w).alias("_prev"))
