"""From firing alert to message, once per incident: attribution, explanation and text of a micro-batch.

``Outbox.deliver`` is the body of a ``foreachBatch``.  Each batch owns one directory, named after the stream
and the batch, and leaves out incidents that an earlier batch or another stream has written.  A batch that
is repeated after a failure writes its own directory again with the same rows, so an incident is explained once
and has one message.  Senders read the directories in order and use ``alert_id`` to recognise a repeated send.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRODUCTION, Settings
from ..operators import attribution, explain
from ..operators.alerts import newly_fired

FIRING = (
    "alert_id string, endpoint_id string, signal_type string, service string, pending_since timestamp, "
    "opened_at timestamp, state string, severity string, score double, raw_value double, layer string"
)
MESSAGE = FIRING + (
    ", suspected_fault string, imputation_score double, suspected_deploy_id string, deploy_service string, "
    "deploy_version string, deploy_score double, "
    "explanation struct<summary:string,suspected_cause:string,checks:array<string>,fallback:boolean>, message string"
)


def _names(schema: str) -> list[str]:
    depth, names, word = 0, [], ""
    for c in schema + ",":
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and depth == 0:
            names.append(word.split()[0])
            word = ""
        else:
            word += c
    return names


def firings(log: DataFrame) -> DataFrame:
    """One row per incident that begins to fire within these log rows, with the id that ``episodes`` gives it."""
    ids = F.sha2(F.concat_ws("|", "endpoint_id", "signal_type", F.unix_micros("opened_at").cast("string")), 256)
    rows = newly_fired(log).select(
        ids.alias("alert_id"), "endpoint_id", "signal_type", "service", F.col("episode_start").alias("pending_since"),
        "opened_at", "state", "severity", "score", "raw_value", "layer",
    )
    rest = [c for c in rows.columns if c != "alert_id"]
    # a log row that arrives twice is one firing
    return rows.groupBy("alert_id").agg(F.max(F.struct(*rest)).alias("_r")).select("alert_id", "_r.*")


def write_up(
    fired: DataFrame, past: DataFrame, injections: DataFrame, deploys: DataFrame, slos: DataFrame,
    settings: Settings = PRODUCTION, bucket_seconds: int | None = None,
) -> DataFrame:
    """Attributed, explained and worded firings; ``past`` are the messages before them, for the history."""
    rows = attribution.fault_attribution(fired, injections, settings, bucket_seconds=bucket_seconds)
    rows = attribution.deploy_attribution(rows, deploys, settings)
    rows = rows.join(slos.select("endpoint_id", "slo_p99_ms", "slo_error_rate_5xx"), "endpoint_id", "left")
    limit = F.when(F.col("signal_type") == "p99_ms", F.col("slo_p99_ms")).otherwise(F.col("slo_error_rate_5xx"))
    rows = rows.withColumn("slo_threshold", limit).withColumn(
        "band", F.lit(None).cast("struct<p10:double,p50:double,p90:double>")
    )
    known = ["endpoint_id", "opened_at", "signal_type", "state", "severity", "suspected_fault"]
    rows = explain.recent_history(rows, past.select(*known).unionByName(rows.select(*known)), settings)
    return explain.notification_text(explain.template_explanation(explain.alert_context(rows)))


class Outbox:
    """Messages below ``root``; one ``stream`` name per checkpoint, since batch numbers start anew with each."""

    def __init__(self, spark: SparkSession, root: str, stream: str = "alerts"):
        self.spark, self.root, self.stream = spark, root.rstrip("/"), stream

    def _directory(self, batch_id: int) -> str:
        return f"stream={self.stream}-batch={batch_id:012d}"

    def written(self) -> list[str]:
        """Complete directories in order of their names."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n for n in names if fs.exists(path(f"{self.root}/{n}/_SUCCESS")))

    def messages(self, names: list[str] | None = None) -> DataFrame:
        """All messages, or those of some directories."""
        paths = [f"{self.root}/{n}" for n in (self.written() if names is None else names)]
        if not paths:
            return self.spark.createDataFrame([], MESSAGE)
        return self.spark.read.schema(MESSAGE).parquet(*paths)

    def deliver(self, log: DataFrame, batch_id: int, text: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Write the messages of the incidents that fire in ``log`` and have none yet; ``text`` is as ``write_up``.

        A batch without such an incident writes nothing.
        """
        own = self._directory(batch_id)
        # what this stream wrote later than the batch cannot exist when the batch is repeated
        past = self.messages([n for n in self.written() if n != own])
        fresh = firings(log).join(past.select("alert_id"), "alert_id", "left_anti")
        if fresh.isEmpty():
            return
        text(fresh, past).select(*_names(MESSAGE)).write.mode("overwrite").parquet(f"{self.root}/{own}")


def run_outbox(
    log: DataFrame, root: str, checkpoint: str, text: Callable[[DataFrame, DataFrame], DataFrame], stream: str = "alerts"
) -> DataFrame:
    """Deliver all log rows available now and read the messages."""
    box = Outbox(log.sparkSession, root, stream)
    query = (
        log.writeStream.foreachBatch(lambda batch, number: box.deliver(batch, number, text))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return box.messages()
