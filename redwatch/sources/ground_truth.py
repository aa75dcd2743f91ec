"""Ground-truth files: JSON, either a list of faults or an object with ``faults``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FAULT_ENTRY


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (source_file, body), searched recursively."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("body"))
    )


def _parsed(files: DataFrame) -> DataFrame:
    """Add the fault array (null when unreadable) and the file's own scenario name."""
    root = F.substring(F.trim("body"), 1, 1)
    obj = F.from_json("body", f"struct<scenario_id:string,faults:array<{FAULT_ENTRY}>>")
    return files.withColumn("_obj", F.when(root == "{", obj)).withColumn(
        "faults",
        F.when(root == "[", F.from_json("body", f"array<{FAULT_ENTRY}>")).otherwise(F.col("_obj.faults")),
    ).withColumn("_scenario", F.col("_obj.scenario_id")).drop("_obj")


def parse_time(text) -> Column:
    """ISO time with offset, Z or neither (then UTC); null when unreadable."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    zoned = F.when(t.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def injections_from(files: DataFrame) -> DataFrame:
    """One row per fault with both times; other entries and unreadable files are skipped."""
    e = _parsed(files).select("source_file", "_scenario", F.explode("faults").alias("e"))
    return e.select(
        F.coalesce("e.scenario_id", "_scenario", F.lit("unknown")).alias("scenario_id"),
        F.coalesce("e.fault_type", F.lit("unknown")).alias("fault_type"),
        F.coalesce("e.target_service", F.lit("")).alias("target_service"),
        F.coalesce("e.target_endpoint", F.lit("")).alias("target_endpoint"),
        parse_time("e.injected_at").alias("injected_at"),
        parse_time("e.cleared_at").alias("cleared_at"),
        F.coalesce("e.magnitude", F.create_map().cast("map<string,string>")).alias("magnitude"),
        "source_file",
    ).where(F.col("injected_at").isNotNull() & F.col("cleared_at").isNotNull())


def read_injections(spark: SparkSession, path: str) -> DataFrame:
    return injections_from(read_files(spark, path))


def unreadable_files(files: DataFrame) -> DataFrame:
    """Files whose body gives no fault list; the caller decides how to warn."""
    return _parsed(files).where(F.col("faults").isNull()).select("source_file")


def validate(files: DataFrame) -> DataFrame:
    """Per file: number of faults, faults without end, last end and the verdict."""
    faults = _parsed(files).select("source_file", F.explode_outer("faults").alias("e"))
    g = faults.groupBy("source_file").agg(
        F.count("e").alias("faults"),
        F.count_if(F.col("e").isNotNull() & F.col("e.cleared_at").isNull()).alias("missing_cleared"),
        F.max(parse_time("e.cleared_at")).alias("last_cleared_at"),
    )
    return g.withColumn("valid", (F.col("faults") > 0) & (F.col("missing_cleared") == 0))
