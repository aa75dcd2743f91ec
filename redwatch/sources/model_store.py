"""Versioned forest models on a shared folder: nodes, metadata and a promotion log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import PRODUCTION, Settings
from ..schemas import MODEL_META, TREE_NODES

POINTERS = "version string, promoted_at timestamp"


@dataclass(frozen=True)
class Model:
    version: str
    nodes: DataFrame
    meta: Row


class ModelStore:
    """Models below ``root``: ``nodes/version=..``, ``meta`` and ``promoted`` (append only)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def save(self, nodes: DataFrame, meta: DataFrame, version: str, promote: bool, now) -> None:
        """Write a version (never overwritten); move the pointer only when promoted."""
        nodes.write.mode("errorifexists").parquet(f"{self.root}/nodes/version={version}")
        meta.write.mode("append").parquet(f"{self.root}/meta")
        if promote:
            self.spark.createDataFrame([(version, now)], POINTERS).write.mode("append").parquet(
                f"{self.root}/promoted"
            )

    def _load(self, version: str | None) -> Model | None:
        if version is None:
            return None
        meta = (
            self.spark.read.schema(MODEL_META).parquet(f"{self.root}/meta")
            .where(F.col("version") == version).orderBy(F.desc("trained_at")).first()
        )
        nodes = self.spark.read.schema(TREE_NODES).parquet(f"{self.root}/nodes/version={version}")
        return Model(version, nodes, meta)

    def latest_version(self) -> str | None:
        """Version the pointer shows; cheap to ask again for every micro-batch."""
        if not self._exists("promoted"):
            return None
        row = self.spark.read.schema(POINTERS).parquet(f"{self.root}/promoted").agg(
            F.max_by("version", "promoted_at").alias("v")
        ).first()
        return row["v"]

    def load_latest(self) -> Model | None:
        return self._load(self.latest_version())

    def load_previous(self) -> Model | None:
        """Newest trained version, promoted or not."""
        if not self._exists("meta"):
            return None
        row = self.spark.read.schema(MODEL_META).parquet(f"{self.root}/meta").agg(
            F.max_by("version", "trained_at").alias("v")
        ).first()
        return self._load(row["v"])

    def ensure_reference(self, matrix: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
        """Fixed sample of the first training, written once and never changed."""
        path = f"{self.root}/reference"
        if not self._exists("reference"):
            reference_window(matrix, settings).write.mode("errorifexists").parquet(path)
        return self.spark.read.schema("row_id string, features array<double>").parquet(path)


def reference_window(matrix: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """A fixed number of rows by hash order; each task keeps only that many candidates."""
    return (
        matrix.select("row_id", "features")
        .orderBy(F.md5(F.concat_ws("|", "row_id", F.lit(str(settings.seed)))), "row_id")
        .limit(settings.reference_rows)
    )
