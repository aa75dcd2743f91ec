"""Seasonal baseline kept up to date by differences.

The state counts values per (endpoint, metric, weekday, hour).  When time moves on, the new cycles are
added and the expired ones subtracted; when the list of faults changes, the cycles that a fault now
covers are subtracted and those that it no longer covers added.  Only the weekday hours that
change are rewritten and only their quantiles computed again, so an hourly update reads two hours of
features instead of the whole lookback.  Features arrive as closed cycles in time order; a cycle written
for a time before the state's ``as_of`` is not seen until the next ``rebuild``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BASELINE_METRICS, PRODUCTION, Settings
from ..functions.scalars import day_of_week, plus_seconds
from .baseline import BAND, exclude_injections, metric_long
from .joins import interval_join

GROUP = ("endpoint_id", "metric", "dow", "hour_bucket")
COUNTS = "endpoint_id string, metric string, dow int, hour_bucket int, value double, n bigint"
BANDS = (
    "endpoint_id string, metric string, dow int, hour_bucket int, p10 double, p50 double, p90 double, "
    "sample_count bigint, updated_at timestamp"
)


def value_counts(rows: DataFrame, sign: int, metrics: Sequence[str]) -> DataFrame:
    """Signed count of each value per group, combined before the shuffle."""
    return (
        metric_long(rows, metrics)
        .groupBy(
            "endpoint_id", "metric", day_of_week("time").alias("dow"), F.hour("time").alias("hour_bucket"), "value"
        )
        .agg((F.count(F.lit(1)) * sign).alias("n"))
    )


def between(features: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return features.where((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end)))


def difference(
    features: DataFrame, before: tuple[datetime, DataFrame], after: tuple[datetime, DataFrame],
    settings: Settings = PRODUCTION, metrics: Sequence[str] = BASELINE_METRICS,
) -> DataFrame:
    """Signed value counts that lead from one (as_of, faults) to a later one."""
    (t0, old), (t1, new) = before, after
    days, margin = timedelta(days=settings.baseline_days), settings.injection_margin_seconds
    if t1 < t0:
        raise ValueError("the state is newer than as_of")
    entered = exclude_injections(between(features, max(t0, t1 - days), t1), new, margin)
    expired = exclude_injections(between(features, t0 - days, min(t0, t1 - days)), old, margin)
    pieces = [value_counts(entered, 1, metrics), value_counts(expired, -1, metrics)]

    window = ("injected_at", "cleared_at")
    was, now = old.select(*window).distinct(), new.select(*window).distinct()
    changed = was.exceptAll(now).unionByName(now.exceptAll(was))
    wide = changed.select(
        plus_seconds("injected_at", -margin).alias("_from"), plus_seconds("cleared_at", margin).alias("_to")
    )
    # two numbers: the stretch of time in which anything changed, for pruning
    first, last = wide.agg(F.min("_from"), F.max(F.coalesce("_to", F.lit(t0)))).first()
    start, end = max(t1 - days, first or t0), min(t0, (last or t0) + timedelta(microseconds=1))
    if first is not None and start < end:
        touched = interval_join(between(features, start, end), wide, "time", "_from", "_to", (), "left_semi")
        pieces.append(value_counts(exclude_injections(touched, old, margin), -1, metrics))
        pieces.append(value_counts(exclude_injections(touched, new, margin), 1, metrics))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out.groupBy(*GROUP, "value").agg(F.sum("n").alias("n")).where("n <> 0")


def merged(state: DataFrame, change: DataFrame) -> DataFrame:
    """State after a change; an error where more is taken away than was there."""
    total = state.unionByName(change).groupBy(*GROUP, "value").agg(F.sum("n").alias("n"))
    short = F.raise_error(F.lit("the features of the past differ from those counted: rebuild")).cast("bigint")
    return total.withColumn("n", F.when(F.col("n") < 0, short).otherwise(F.col("n"))).where("n > 0")


def bands(state: DataFrame, as_of: datetime, settings: Settings = PRODUCTION) -> DataFrame:
    """Baseline rows of the counted values, as ``seasonal_baseline`` gives them."""
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.col("n"))
    return (
        state.groupBy(*GROUP)
        .agg(q.alias("_q"), F.sum("n").alias("sample_count"))
        .where(F.col("sample_count") >= settings.baseline_min_samples)
        .select(
            *GROUP, *[F.col("_q")[i].alias(n) for i, n in enumerate(BAND)], "sample_count",
            F.lit(as_of).alias("updated_at"),
        )
    )


class BaselineState:
    """Versions of the state below a folder.

    A version holds the slices (weekday hours) that it rewrote, the faults it was made with and a list
    that names, for each of at most 168 slices, the version that wrote it last.  The list is written at the end, so
    a version without one does not exist, and a repeated update writes its own folder again.
    """

    def __init__(
        self, spark: SparkSession, root: str, settings: Settings = PRODUCTION, metrics: Sequence[str] = BASELINE_METRICS
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.settings, self.metrics = settings, tuple(metrics)

    def _names(self, folder: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[str]:
        done = [v for v in self._names(self.root) if "_SUCCESS" in self._names(f"{self.root}/{v}/heads")]
        return [v for v in done if v.startswith("version=")]

    def _heads(self, version: str) -> dict[str, dict[int, str]]:
        rows = self.spark.read.parquet(f"{self.root}/{version}/heads").collect()  # at most 2 x 168 and one
        heads: dict[str, dict[int, str]] = {"counts": {}, "bands": {}}
        for r in rows:
            if r["kind"] in heads:
                heads[r["kind"]][r["slice"]] = r["version"]
        return heads

    def _read(self, kind: str, heads: dict[int, str], slices=None) -> DataFrame:
        schema = COUNTS if kind == "counts" else BANDS
        paths = [
            f"{self.root}/{v}/{kind}/slice={s}" for s, v in sorted(heads.items()) if slices is None or s in slices
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, df: DataFrame, version: str, kind: str) -> set[int]:
        path = f"{self.root}/{version}/{kind}"
        sliced = df.withColumn("slice", F.col("dow") * 24 + F.col("hour_bucket"))
        sliced.write.mode("overwrite").partitionBy("slice").parquet(path)
        return {int(n[6:]) for n in self._names(path) if n.startswith("slice=")}

    def baseline(self, version: str | None = None) -> DataFrame:
        """Bands of a version, the newest by default; ``updated_at`` says when a weekday hour last changed."""
        version = version or self.versions()[-1]
        return self._read("bands", self._heads(version)["bands"])

    def advance(self, features: DataFrame, injections: DataFrame, as_of: datetime, rebuild: bool = False) -> str:
        """Bring the state to ``as_of`` and these faults; returns the version, which is named after the time."""
        name = f"version={as_of:%Y%m%dT%H%M%S%f}"
        # a repeated update starts from the version before it, as the first time
        older = [] if rebuild else [v for v in self.versions() if v < name]
        if not rebuild and any(v > name for v in self.versions()):
            raise ValueError("the state is newer than as_of")
        faults = injections.select("injected_at", "cleared_at").distinct()
        faults.write.mode("overwrite").parquet(f"{self.root}/{name}/faults")
        faults = self.spark.read.schema("injected_at timestamp, cleared_at timestamp").parquet(f"{self.root}/{name}/faults")
        if older:
            heads = self._heads(older[-1])
            since = datetime.strptime(older[-1], "version=%Y%m%dT%H%M%S%f")
            known = self.spark.read.schema(faults.schema).parquet(f"{self.root}/{older[-1]}/faults")
            change = difference(features, (since, known), (as_of, faults), self.settings, self.metrics)
        else:
            heads = {"counts": {}, "bands": {}}
            history = between(features, as_of - timedelta(days=self.settings.baseline_days), as_of)
            history = exclude_injections(history, faults, self.settings.injection_margin_seconds)
            change = value_counts(history, 1, self.metrics)
        touched = self._write(change, name, "change")
        change = self.spark.read.schema(COUNTS).parquet(f"{self.root}/{name}/change").drop("slice") if touched else None
        left: set[int] = set()
        shown: set[int] = set()
        if touched:
            now = merged(self._read("counts", heads["counts"], touched), change)
            left = self._write(now, name, "counts")
            fresh = self._read("counts", dict.fromkeys(left, name))
            shown = self._write(bands(fresh, as_of, self.settings), name, "bands")
        rows = [("time", -1, name)]
        for kind, written in (("counts", left), ("bands", shown)):
            kept = {s: v for s, v in heads[kind].items() if s not in touched}
            rows += [(kind, s, v) for s, v in {**kept, **dict.fromkeys(written, name)}.items()]
        self.spark.createDataFrame(rows, "kind string, slice int, version string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/{name}/heads")
        return name
