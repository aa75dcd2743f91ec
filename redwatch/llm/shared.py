"""Stage tables below the session's shared folder, and connected components."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_path

#: Spark's setting that deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stages:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    ``drop`` removes one as soon as a later table has replaced it; what the final, lazy result still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame, release: bool = False) -> DataFrame:
        """Write and read back. The shuffle files of the write go as it ends: nothing reads them again, and the driver's collections
        come later or, with a query that just ended, find them still held. With ``release`` there is such a collection too.
        """
        path = fresh_path(self.spark, self.name)
        conf = df.sparkSession.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                conf.unset(CLEANUP)
            else:
                conf.set(CLEANUP, before)
        if release:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df), (None, None))
            if path is not None:
                place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the columns ``a`` and ``b`` of ``links``; a component is named by its smallest node.

    Each round points every node to its smallest neighbour, follows the pointers once more, and contracts the graph; a star
    takes one round, a path a logarithmic number. Only links between different remaining nodes are kept.
    """
    stages = Stages(links.sparkSession, name)
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    edges = stages.put(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        first = edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up"))
        nearest = stages.put(first)
        above = nearest.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = stages.put(nearest.join(above, "up").select("node", F.col("top").alias("component")))
        stages.drop(nearest)
        if labels is None:
            labels = parent
        else:
            step = parent.select(F.col("node").alias("component"), F.col("component").alias("top"))
            old = labels
            labels = stages.put(old.join(step, "component", "left").select("node", F.coalesce("top", "component").alias("component")))
            stages.drop(old)
        left = parent.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        right = parent.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        rest = edges.join(left, "u").join(right, "v").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
        old_edges, edges = edges, stages.put(rest)
        stages.drop(old_edges)
        if parent is not labels:
            stages.drop(parent)
    stages.drop(edges)
    return labels
