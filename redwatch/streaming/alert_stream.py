"""Stateful stream operators: last cycles per endpoint, alert state machine, deploy join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import PRODUCTION, Settings
from ..operators.alerts import BAD, BETWEEN, CLEAN, machine
from ..operators.baseline import with_baseline
from ..operators.features import SERIES, from_window
from ..operators.model_ops import Trained, layer_ml
from ..operators.scoring import combine, layer_scores, with_slos
from ..sources.tables import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(t) -> int:
    return int(pd.Timestamp(t).value // 1000)


def _stamp(us) -> pd.Timestamp:
    return pd.NaT if us is None else pd.Timestamp(int(us), unit="us")


def _in_order(rows: Iterator[pd.DataFrame], time: str, after: int | None) -> pd.DataFrame:
    """Rows of this batch in time order, without those at or before the last handled time."""
    pdf = pd.concat(list(rows), ignore_index=True)
    pdf["_us"] = [_micros(t) for t in pdf[time]]
    if after is not None:
        pdf = pdf[pdf["_us"] > after]
    return pdf.sort_values("_us")


class RollingWindow(StatefulProcessor):
    """Keeps the last cycles of an endpoint and adds the columns of ``rolling_window``."""

    def __init__(self, columns: Sequence[str], size: int):
        self.columns, self.size = list(columns), size

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{m} array<double>" for m in SERIES)
        self.state = handle.getValueState("recent", f"last_us bigint, {fields}")

    def handleInputRows(self, key, rows, timerValues):
        if self.state.exists():
            last, *recent = self.state.get()
            recent = [list(s) for s in recent]
        else:
            last, recent = None, [[] for _ in SERIES]
        pdf = _in_order(rows, "time", last)
        out = []
        for row in pdf.to_dict("records"):
            for series, m in zip(recent, SERIES):
                v = row[m]
                series.append(float(v) if v is not None and v == v and abs(v) != float("inf") else float("nan"))
                del series[: -self.size]
            last = row["_us"]
            good = {m: [v for v in s if v == v] for m, s in zip(SERIES, recent)}
            out.append(
                [row[c] for c in self.columns]
                + [len(recent[0]), good["p99_ms"], good["rps"]]
                + [good[m][-1] if good[m] else 0.0 for m in SERIES]
            )
        if out:
            self.state.update((last, *recent))
        names = self.columns + ["window_rows", "p99_ms_series", "rps_series"] + [f"last_{m}" for m in SERIES]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def rolling_window_stream(features: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Stream form of ``rolling_window``; the state of an endpoint is its last cycles."""
    _use_rocksdb(features)
    schema = T.StructType(list(features.schema.fields))
    schema = schema.add("window_rows", T.LongType())
    for m in ("p99_ms", "rps"):
        schema = schema.add(f"{m}_series", T.ArrayType(T.DoubleType()))
    for m in SERIES:
        schema = schema.add(f"last_{m}", T.DoubleType())
    return features.groupBy("endpoint_id").transformWithStateInPandas(
        RollingWindow(features.columns, settings.window_size), schema, "append", "None"
    )


def score_stream(
    features: DataFrame, baseline: DataFrame, slos: DataFrame, model: Trained | None = None,
    settings: Settings = PRODUCTION,
) -> DataFrame:
    """Scored cycles of a stream of features: stateful windows, then stateless expressions.

    Baseline and limits are static tables; a restarted query (or ``foreachBatch`` with
    ``CurrentModel``) takes up a newer model.
    """
    rows = with_baseline(rolling_window_stream(features, settings), baseline)
    rows = layer_scores(with_slos(from_window(rows, settings), slos), settings)
    if model is not None:
        rows = layer_ml(rows, model, settings)
    return combine(rows, settings, "ml_norm" if model is not None else None)


def batch_durations(query) -> list[tuple[int, float]]:
    """(batch id, seconds) of the recent micro-batches of a streaming query."""
    return [(p["batchId"], p["batchDuration"] / 1000.0) for p in query.recentProgress]


LOG_SCHEMA = (
    "endpoint_id string, signal_type string, service string, time timestamp, anomaly boolean, "
    "severity string, score double, raw_value double, layer string, prev_state string, "
    "state string, pending_count int, resolving_count int, pending_since timestamp, "
    "opened_at timestamp, resolved_at timestamp, episode_start timestamp"
)
INPUT = ("service", "anomaly", "severity", "score", "raw_value", "layer")


class AlertMachine(StatefulProcessor):
    """The alert states of one signal; same table of states as the batch fold.

    With ``stale_after`` seconds a signal whose endpoint went silent is closed by an event-time
    timer.
    """

    def __init__(self, settings: Settings, stale_after: int | None = None):
        self.states = machine(settings)
        self.clear = settings.clear_threshold
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "alert", "code int, last_us bigint, began bigint, fired bigint, closed bigint, service string"
        )

    def _symbol(self, signal: str, row: dict) -> int:
        if bool(row["anomaly"]):
            return BAD
        held = self.clear is not None and signal == "p99_ms" and row["level"] >= self.clear
        return BETWEEN if held else CLEAN

    def _row(self, key, us, before, code, began, fired, closed, values):
        prev, (state, count, *_) = self.states[before][0], self.states[code]
        return [
            key[0], key[1], values["service"], _stamp(us), values["anomaly"], values["severity"],
            values["score"], values["raw_value"], values["layer"], prev, state,
            count if state == "pending" else 0, count if state == "resolving" else 0,
            _stamp(began if state != "ok" else None),
            _stamp(fired if fired is not None and began is not None and fired >= began else None),
            _stamp(closed if state == "ok" else None), _stamp(began),
        ]

    def _move(self, before, symbol, us, began, fired, closed):
        code = self.states[before][2 + symbol]
        was, now = self.states[before][0], self.states[code][0]
        if was == "ok" and now != "ok":
            began = us
        if now == "firing" and was in ("ok", "pending"):
            fired = us
        if now == "ok" and was != "ok":
            closed = us
        return code, began, fired, closed

    def handleInputRows(self, key, rows, timerValues):
        code, last, began, fired, closed, service = (
            self.state.get() if self.state.exists() else (0, None, None, None, None, None)
        )
        out = []
        for row in _in_order(rows, "time", last).to_dict("records"):
            before, last, service = code, row["_us"], row["service"]
            code, began, fired, closed = self._move(
                before, self._symbol(key[1], row), last, began, fired, closed
            )
            out.append(self._row(key, last, before, code, began, fired, closed, {c: row[c] for c in INPUT}))
        if out:
            self.state.update((code, last, began, fired, closed, service))
            if self.stale_after:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(last // 1000 + self.stale_after * 1000)
        yield _log_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.state.exists():
            code, last, began, fired, closed, service = self.state.get()
            if self.states[code][0] != "ok":
                us = expiredTimerInfo.getExpiryTimeInMs() * 1000
                silent = dict(
                    service=service, anomaly=False, severity=None, score=0.0, raw_value=None, layer=None
                )
                out.append(self._row(key, us, code, 0, began, fired, us, silent))
                self.state.update((0, last, began, fired, us, service))
        yield _log_frame(out)

    def close(self) -> None:
        pass


def _log_frame(rows: list) -> pd.DataFrame:
    names = [f.split()[0] for f in LOG_SCHEMA.split(", ")]
    pdf = pd.DataFrame(rows, columns=names)
    for c in ("time", "pending_since", "opened_at", "resolved_at", "episode_start"):
        pdf[c] = pd.to_datetime(pdf[c])
    for c in ("score", "raw_value"):
        pdf[c] = pdf[c].astype(float)
    return pdf


def alert_stream(
    signals: DataFrame, settings: Settings = PRODUCTION, stale_after: int | None = None
) -> DataFrame:
    """Alert log of a stream of signals, in the columns of the batch ``alert_log``.

    ``signals`` needs a watermark on ``time`` when ``stale_after`` is used.
    """
    _use_rocksdb(signals)
    mode = "EventTime" if stale_after else "None"
    return signals.groupBy("endpoint_id", "signal_type").transformWithStateInPandas(
        AlertMachine(settings, stale_after), LOG_SCHEMA, "append", mode
    )


def deploy_join_stream(
    fired: DataFrame, deploys: DataFrame, settings: Settings = PRODUCTION, delay: str = "5 minutes"
) -> DataFrame:
    """Newly fired alerts with every deployment of the window before them.

    Both streams have watermarks and the join a time range, so old state is dropped.  The best
    candidate is chosen afterwards by ``attribution.deploy_attribution`` on the written rows.
    """
    seconds = settings.deploy_window_seconds

    def bucket(ts: str):
        return F.floor(F.unix_seconds(ts) / seconds).cast("long")

    # a deployment reaches into at most two buckets, an alert lies in one: an equality key
    left = fired.withColumn("_b", bucket("opened_at")).withWatermark("opened_at", delay)
    right = deploys.select(
        "deploy_id", F.col("service").alias("deploy_service"), "version", "deployed_at",
        F.explode(F.array(bucket("deployed_at"), bucket("deployed_at") + 1)).alias("_db"),
    ).withWatermark("deployed_at", delay)
    return left.join(
        right,
        F.expr(
            f"_b = _db AND deployed_at <= opened_at AND deployed_at >= opened_at - INTERVAL {seconds} SECONDS"
        ),
    ).drop("_b", "_db")


def publish_current(batch: DataFrame, root: str, batch_id: int) -> str:
    """foreachBatch body: rebuild the current-alert table from the last version and this batch.

    Versions are directories named after the batch, so a repeated batch overwrites only itself.
    """
    from ..operators.alerts import current_alerts, upsert_current

    spark = batch.sparkSession
    path = f"{root.rstrip('/')}/version={batch_id:012d}"
    new = current_alerts(batch)
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    older = []
    if fs.exists(base):
        names = [s.getPath().getName() for s in fs.listStatus(base)]
        older = sorted(n for n in names if n.startswith("version=") and n < path.rsplit("/", 1)[1])
    if older:
        new = upsert_current(spark.read.parquet(f"{root.rstrip('/')}/{older[-1]}"), new)
    new.write.mode("overwrite").parquet(path)
    return path


def checkpoint_for(df: DataFrame, name: str) -> str:
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}"
