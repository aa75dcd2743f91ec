"""Global positions of rows without gathering them: range partitions, counted, and numbered on from one to the next."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stages

_BITS = 33
AT = "__at"


def sorted_parts(df: DataFrame, by: list[Column], stages: Stages) -> DataFrame:
    """``df`` in range partitions of the order ``by``, written, with ``__at``: partition number and place in the partition.

    Rows that tie on ``by`` are told apart by their place in ``df``, so that any number of equal rows can be cut into several
    partitions. ``df`` should be cheap to read (a written table): Spark reads it once more to choose the cuts.
    """
    own = df.withColumn("__row", F.monotonically_increasing_id())
    order = [*by, F.col("__row")]
    parts = own.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row")
    return stages.put(parts.withColumn(AT, F.monotonically_increasing_id()))


def part() -> Column:
    """Partition number of a row of ``sorted_parts``."""
    return F.shiftright(AT, _BITS).cast("int")


def place() -> Column:
    """Place of a row in its partition."""
    return F.col(AT).bitwiseAND(F.lit((1 << _BITS) - 1))


def global_rank(rows: DataFrame) -> Column:
    """Position, from 0, of every row of ``sorted_parts``; one count per partition reaches the driver."""
    counts = {r["part"]: r["n"] for r in rows.groupBy(part().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    known = sorted(counts)
    starts = dict(zip(known, accumulate((counts[p] for p in known), initial=0), strict=False))
    before = F.create_map(*[F.lit(x) for p in known for x in (p, starts[p])]) if known else F.create_map(F.lit(0), F.lit(0))
    return (F.element_at(before, part()) + place()).cast("long")


def positions(rows: DataFrame, group: str, by: list[Column], stages: Stages) -> DataFrame:
    """``rows`` with pos (place in its ``group`` in the order ``by``, from 0) and n (rows of the group); groups are not null.

    Rows are numbered in range partitions of (group, ``by``); what meets per group is one count per partition.
    """
    parts = sorted_parts(rows, [F.col(group), *by], stages)
    rows = parts.withColumn("__part", part()).withColumn("__place", place()).drop(AT)
    own = Window.partitionBy(group)
    cells = rows.groupBy(group, "__part").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    cells = cells.select(group, "__part", (F.sum("__n").over(own.orderBy("__part")) - F.col("__n") - F.col("__first")).alias("__before"), F.sum("__n").over(own).alias("n"))
    return rows.join(cells, [group, "__part"]).withColumn("pos", F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")
