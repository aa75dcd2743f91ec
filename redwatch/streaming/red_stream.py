"""Feature windows over a stream of spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PRODUCTION, Settings
from ..operators.red import DIMENSIONS, red_aggs, red_projection, server_spans


def windowed_red(
    spans: DataFrame, window_seconds: int, slide_seconds: int | None = None, delay: str = "1 minute",
    dims: Sequence[str] = DIMENSIONS,
) -> DataFrame:
    """RED features of closed windows.

    The state of a window is one row of counters per endpoint.  In append mode a window comes out
    once the watermark has passed its end, so the newest incomplete window is never seen and
    later spans for it are dropped.
    """
    slide = slide_seconds or window_seconds
    win = F.window("ts", f"{window_seconds} seconds", f"{slide} seconds")
    counters = (
        server_spans(spans.withWatermark("ts", delay)).groupBy(win, *dims).agg(*red_aggs(window_seconds))
    )
    return counters.select(
        F.col("window.start").alias("time"), *dims, "rps", *red_projection(), F.col("calls").alias("span_count")
    )


def tumbling_red(spans: DataFrame, settings: Settings = PRODUCTION, delay: str = "1 minute") -> DataFrame:
    return windowed_red(spans, settings.cycle_seconds, None, delay)


def sliding_red(spans: DataFrame, settings: Settings = PRODUCTION, delay: str = "1 minute") -> DataFrame:
    """Longer windows that move by one cycle."""
    return windowed_red(spans, settings.rate_seconds, settings.cycle_seconds, delay)


def deduplicated(spans: DataFrame, delay: str = "10 minutes", key: Sequence[str] = ("span_id",)) -> DataFrame:
    """Each span once, although the sender may repeat it; ids are remembered for the delay."""
    return spans.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all data available now into a parquet table and read the table."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = (
        writer.option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
