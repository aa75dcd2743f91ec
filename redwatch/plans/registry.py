"""Registry of queries: a Spark plan per key and, where SQL can express it, its counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import model_sql  # noqa: F401  (registers the blocks of the forest)
from .fixture import Telemetry, telemetry
from .sql import with_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Plain output columns: rounded doubles, times as text, integers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(key: str, blocks: tuple[str, ...] | None = None, sql: str | None = None):
    """Register ``fn(telemetry) -> DataFrame`` under ``key``; ``sql`` selects from the blocks."""

    def register(fn: Callable[[Telemetry], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(telemetry(spark, sf_dir)))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_blocks(blocks or (), sql)
        return fn

    return register
