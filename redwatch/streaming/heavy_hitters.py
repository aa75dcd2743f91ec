"""Busiest endpoints of a stream in bounded state.

Each shard keeps a Space-Saving summary in its subtracted form: at most ``capacity`` names with the
count each surely has, and one ``floor`` that no name exceeds its count by.  Rows go to shards by a
hash of the row, not of the name, so that one busy endpoint loads all shards alike; summaries add up.
Over all shards the floors sum to at most rows / (capacity + 1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .alert_stream import _use_rocksdb

SUMMARY = "shard int, seen bigint, floor bigint, endpoint_id string, at_least bigint"


def absorb(counts: pd.Series, floor: int, more: pd.Series, capacity: int) -> tuple[pd.Series, int]:
    """Add exact counts by name to a summary and cut it back to ``capacity`` names.

    The cut takes the largest count that has no place from every name, so a name loses at most what
    the floor gains, and each unit of the floor stands for ``capacity`` + 1 rows.
    """
    counts = counts.add(more, fill_value=0).astype(np.int64)
    if len(counts) > capacity:
        place = len(counts) - capacity - 1
        cut = int(np.partition(counts.to_numpy(), place)[place])
        counts = counts[counts > cut] - cut
        floor += cut
    return counts, floor


class SpaceSaving(StatefulProcessor):
    """Summary of one shard; emits all of it after each batch, named by the rows seen so far."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("summary", "seen bigint, floor bigint, names array<string>, counts array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        seen, floor, names, counts = self.state.get() if self.state.exists() else (0, 0, [], [])
        summary = pd.Series(list(counts), index=pd.Index(list(names), dtype=object), dtype=np.int64)
        for pdf in rows:
            seen += len(pdf)
            summary, floor = absorb(summary, floor, pdf["endpoint_id"].value_counts(), self.capacity)
        self.state.update((seen, floor, summary.index.tolist(), summary.tolist()))
        # a shard without names still has a floor to tell
        size = max(len(summary), 1)
        yield pd.DataFrame({
            "shard": np.full(size, key[0], np.int32), "seen": np.full(size, seen), "floor": np.full(size, floor),
            "endpoint_id": summary.index.tolist() or [None], "at_least": summary.tolist() or [0],
        })

    def close(self) -> None:
        pass


def endpoint_summaries(spans: DataFrame, row_id: str | Column, capacity: int = 1000, shards: int = 64) -> DataFrame:
    """Stream of shard summaries; rows without an endpoint count as ``quarantine``."""
    _use_rocksdb(spans)
    row = F.col(row_id) if isinstance(row_id, str) else row_id
    work = spans.select(
        F.pmod(F.xxhash64(row), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce("endpoint_id", F.lit("quarantine")).alias("endpoint_id"),
    )
    return work.groupBy("shard").transformWithStateInPandas(SpaceSaving(capacity), SUMMARY, "append", "None")


def bounds(summaries: DataFrame) -> DataFrame:
    """endpoint_id, at_least, at_most over the newest summary of each shard; repeated rows count once.

    The true count lies between the two.  An endpoint without a row has at most the sum of the floors.
    """
    newest = summaries.withColumn("_last", F.max("seen").over(W.partitionBy("shard"))).where("seen = _last")
    newest = newest.select("shard", "seen", "floor", "endpoint_id", "at_least").distinct()
    floors = newest.select("shard", "floor").distinct().select(F.sum("floor")).scalar()
    return (
        newest.where(F.col("endpoint_id").isNotNull())
        .groupBy("endpoint_id")
        .agg(F.sum("at_least").alias("at_least"))
        .withColumn("at_most", F.col("at_least") + floors)
    )


def busiest(summaries: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` endpoints of largest sure count, ties by name, and whether each surely belongs there.

    ``certain`` compares with the largest count that any endpoint outside can have.
    """
    ranked = bounds(summaries).orderBy(F.desc("at_least"), "endpoint_id").limit(limit + 1)
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("at_least"), "endpoint_id")  # limit + 1 rows
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    spare = F.max(F.when(F.col("rank") == limit + 1, F.col("at_most"))).over(W.partitionBy(F.lit(0)))
    # with no endpoint outside the list, only one without a row may still compete
    rest = F.coalesce(spare, F.col("at_most") - F.col("at_least"))
    return (
        ranked.withColumn("certain", F.col("at_least") >= rest)
        .where(F.col("rank") <= limit)
        .select("rank", "endpoint_id", "at_least", "at_most", "certain")
    )
