"""Spans and metric samples: redaction and loading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PII_ATTRIBUTES


def redact_attrs(spans: DataFrame, deny: Sequence[str] = PII_ATTRIBUTES, column: str = "attrs") -> DataFrame:
    """Remove personal attributes by name."""
    return spans.withColumn(column, F.map_filter(column, lambda k, v: ~k.isin(*deny)))


def keep_attrs(spans: DataFrame, allow: Sequence[str], column: str = "attrs") -> DataFrame:
    """Keep only listed attributes."""
    return spans.withColumn(column, F.map_filter(column, lambda k, v: k.isin(*allow)))


def samples_by_route(samples: DataFrame) -> DataFrame:
    """Sum of sample values per (service, route); a missing label counts as ''."""

    def label(name: str):
        return F.coalesce(F.element_at("labels", name), F.lit(""))

    return samples.groupBy(
        "ts", label("service_name").alias("service"), label("http_route").alias("route")
    ).agg(F.sum(F.col("value").cast("double")).alias("value"))
