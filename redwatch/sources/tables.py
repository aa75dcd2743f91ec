"""Table sinks and maintenance on plain parquet directories."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRODUCTION, Settings
from ..functions.scalars import finite_or_null, is_finite
from ..schemas import SPANS


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables, as the session names it.

    Only where driver and executors share one process (``local[...]``) may the setting be missing;
    then a temporary folder serves. On a cluster that would scatter files, so it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="redwatch-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new directory name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors and its lineage ends here."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back; unlike a checkpoint it stays columnar."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --------------------------------------------------------------------------- appends


def append_by_date(df: DataFrame, path: str, time: str) -> None:
    """Append rows below ``date=`` partitions, one shuffle so that a date gets few files."""
    df.withColumn("date", F.to_date(time)).write.mode("append").partitionBy("date").parquet(path)


def feature_rows(features: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """Rows of the feature table: tracked endpoints with a finite p99, missing error rates as 0."""
    out = features.where(is_finite("p99_ms"))
    if endpoints is not None:
        out = out.join(endpoints.select("endpoint_id"), "endpoint_id", "left_semi")
    return out.withColumn("error_rate_5xx", F.coalesce("error_rate_5xx", F.lit(0.0))).withColumn(
        "error_rate_4xx", F.coalesce("error_rate_4xx", F.lit(0.0))
    )


def write_features(features: DataFrame, path: str, endpoints: DataFrame | None = None) -> None:
    append_by_date(feature_rows(features, endpoints), path, "time")


def write_anomalies(anomalies: DataFrame, path: str) -> None:
    append_by_date(anomalies, path, "detected_at")


def write_log(rows: DataFrame, path: str) -> None:
    """Plain append, for alert history, evaluation runs, model health and explanations."""
    rows.write.mode("append").parquet(path)


def json_safe(df: DataFrame, *columns: str) -> DataFrame:
    """Numbers that are not finite become null (for columns or arrays of doubles)."""
    out = df
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        expr = F.transform(c, finite_or_null) if kind.startswith("array") else finite_or_null(c)
        out = out.withColumn(c, expr)
    return out


def upsert_baseline(old: DataFrame, new: DataFrame) -> DataFrame:
    """New buckets win, other old buckets stay."""
    key = ["endpoint_id", "metric", "dow", "hour_bucket"]
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def replace_table(df: DataFrame, root: str, version: str) -> str:
    """Write a full new version beside the old ones and return its path.

    Readers switch when the caller publishes the path, so they never see a half-written table.
    """
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


# --------------------------------------------------------------------------- deploy events


def deploy_rows(deploys: DataFrame, now: Column) -> DataFrame:
    """Deploy events with a default time and a stable generated id."""
    out = deploys.withColumn("deployed_at", F.coalesce("deployed_at", now))
    made = F.sha2(F.concat_ws("|", "service", "version", F.unix_micros("deployed_at").cast("string")), 256)
    return out.withColumn("deploy_id", F.coalesce("deploy_id", made))


def recent_deploys(
    deploys: DataFrame, as_of: Column, service: str | None = None, since_minutes: int = 1440, limit: int = 50
) -> DataFrame:
    """Newest deploys of the period, at most ``limit`` (1 to 500) of them."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    since = F.timestamp_micros(F.unix_micros(as_of) - F.lit(since_minutes * 60 * 1000000))
    out = deploys.where((F.col("deployed_at") >= since) & (F.col("deployed_at") <= as_of))
    if service is not None:
        out = out.where(F.col("service") == service)
    return out.orderBy(F.desc("deployed_at"), "deploy_id").limit(limit)


# --------------------------------------------------------------------------- reports


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv_report(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


# --------------------------------------------------------------------------- retention


def within_retention(df: DataFrame, as_of: Column, settings: Settings = PRODUCTION, time: str = "time") -> DataFrame:
    """Rows whose date partition is younger than the retention period."""
    return df.where(F.to_date(time) >= F.date_sub(F.to_date(as_of), settings.retention_days))


def compact_old(df: DataFrame, as_of: Column, settings: Settings = PRODUCTION, time: str = "time") -> DataFrame:
    """Rows older than the compaction age, grouped by date and ordered by endpoint, newest first.

    Rows of one date are spread over files by endpoint hash, so a busy date is not one task.
    """
    old = df.where(F.to_date(time) < F.date_sub(F.to_date(as_of), settings.compact_after_days))
    return (
        old.withColumn("date", F.to_date(time))
        .repartition("date", "endpoint_id")
        .sortWithinPartitions("date", "endpoint_id", F.desc(time))
    )


def expired_partitions(root: str, spark: SparkSession, as_of, settings: Settings = PRODUCTION) -> list[str]:
    """Names of the ``date=`` directories of ``root`` that are past retention."""
    limit = (as_of - timedelta(days=settings.retention_days)).date().isoformat()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n for n in names if n.startswith("date=") and n[5:] < limit)


def drop_expired(root: str, spark: SparkSession, as_of, settings: Settings = PRODUCTION) -> list[str]:
    """Delete the date partitions past retention; returns the dropped names."""
    dropped = expired_partitions(root, spark, as_of, settings)
    jvm = spark.sparkContext._jvm
    for name in dropped:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return dropped


# --------------------------------------------------------------------------- readers


def read_spans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SPANS).format(fmt).load(path)


def read_range(
    spark: SparkSession, path: str, schema: str, time: str, since: datetime, until: datetime | None = None
) -> DataFrame:
    """Rows of a date-partitioned table in a time range.

    The range is also given on ``date``, so whole partitions are pruned before the scan.
    """
    rows = spark.read.schema(f"{schema}, date date").parquet(path)
    rows = rows.where((F.col("date") >= F.lit(since.date())) & (F.col(time) >= F.lit(since)))
    if until is not None:
        rows = rows.where((F.col("date") <= F.lit(until.date())) & (F.col(time) <= F.lit(until)))
    return rows.drop("date")


def stream_spans(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(SPANS).format(fmt).options(**options).load(path)
