"""Training, promotion gates, drift and threshold tuning of the forest layer."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRODUCTION, Settings
from ..functions.ordered import exact_quantiles, running_totals, value_bin
from ..functions.scalars import seconds_between, half_even
from ..sources.model_store import Model, ModelStore
from ..sources.tables import stored
from .baseline import exclude_injections, lookback, with_baseline
from .evaluation import detections, onsets_outside, replay_onsets, span_hours, with_ratios
from .features import derived_features, feature_vector, model_inputs
from .forest import (
    Forest, ablation_attribution, calibrate, calibration_params, feature_medians, train_forest,
)
from .red import drop_incomplete, valid_features
from .scoring import combine, layer_scores, replay_flags, with_slos


def with_row_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "row_id", F.sha2(F.concat_ws("|", "endpoint_id", F.unix_micros("time").cast("string")), 256)
    )


def feature_matrix(features: DataFrame, baseline: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Model features of every complete cycle with a long enough window."""
    usable = drop_incomplete(valid_features(features))
    rows = derived_features(with_baseline(usable, baseline), settings)
    return with_row_id(rows).where(F.col("window_rows") >= settings.min_window)


def training_matrix(
    features: DataFrame, baseline: DataFrame, injections: DataFrame, as_of: Column,
    settings: Settings = PRODUCTION, bucket_seconds: int = 3600,
) -> DataFrame:
    """Fault-free rows of the matrix; faults still appear in the windows of their neighbours."""
    rows = feature_matrix(lookback(features, as_of, settings.train_days), baseline, settings)
    clean = exclude_injections(rows, injections, settings.injection_margin_seconds, "time", bucket_seconds)
    return clean.withColumn("features", feature_vector(settings))


@dataclass
class Trained:
    """A fitted forest with what is needed to use it."""

    nodes: DataFrame
    meta: DataFrame
    forest: Forest
    medians: list[float]
    p50: float
    p99: float


def fit(
    matrix: DataFrame, trained_at: datetime, settings: Settings = PRODUCTION, version: str | None = None
) -> Trained:
    """Train, score the training rows and calibrate.

    The matrix is written once and read for each step.  Only the node table (bounded by trees and
    subsample), seven medians and four percentiles reach the driver.
    """
    spark = matrix.sparkSession
    matrix = stored(matrix.select("row_id", "features"), "matrix")
    n = matrix.count()
    if n < settings.min_train_rows:
        raise ValueError(f"{n} training rows, at least {settings.min_train_rows} needed")
    nodes = stored(train_forest(matrix, n, settings), "nodes")
    forest = Forest(spark, nodes, min(settings.subsample, n))
    cols = [F.get("features", F.lit(i)) for i in range(len(settings.features))]
    raw = stored(matrix.select("row_id", forest.score(cols).alias("raw")), "raw")
    calib = calibration_params(raw).first()
    by_name = {r["feature"]: r["median"] for r in feature_medians(matrix, settings.features).collect()}
    medians = [by_name[f] for f in settings.features]
    version = version or trained_at.strftime("%Y%m%d_%H%M%S")
    meta = spark.createDataFrame(
        [(
            version, trained_at, n, min(settings.subsample, n), settings.trees, settings.contamination,
            settings.window_size, settings.train_days, list(settings.features), medians,
            calib["p50"], calib["p95"], calib["p99"], calib["max"],
        )],
        _META,
    )
    return Trained(nodes, meta, forest, medians, calib["p50"], calib["p99"])


from ..schemas import MODEL_META as _META  # noqa: E402


def from_store(spark: SparkSession, model: Model) -> Trained:
    m = model.meta
    meta = spark.createDataFrame([m], _META)
    return Trained(
        model.nodes, meta, Forest(spark, model.nodes, m["subsample"]), list(m["feature_medians"]),
        m["p50"], m["p99"],
    )


class CurrentModel:
    """The promoted model, loaded again only when the pointer has moved."""

    def __init__(self, store: ModelStore):
        self.store, self._version, self._model = store, None, None

    def get(self) -> Trained | None:
        version = self.store.latest_version()
        if version != self._version:
            self._model = from_store(self.store.spark, self.store.load_latest())
            self._version = version
        return self._model


def layer_ml(rows: DataFrame, model: Trained, settings: Settings = PRODUCTION) -> DataFrame:
    """Add ``raw_ml`` and the calibrated ``ml_norm``; short windows score 0."""
    cols = model_inputs(settings)
    out = rows.withColumn("raw_ml", model.forest.score(cols))
    norm = calibrate("raw_ml", model.p50, model.p99)
    return out.withColumn(
        "ml_norm", F.when(F.col("window_rows") >= settings.min_window, norm).otherwise(0.0)
    )


def with_attribution(rows: DataFrame, model: Trained, settings: Settings = PRODUCTION) -> DataFrame:
    """Add ``ml_top``: the three features that raise the forest score most."""
    cols = model_inputs(settings)
    out = rows.withColumn("_drops", model.forest.ablation(cols, model.medians))
    return out.withColumn(
        "ml_top", ablation_attribution("_drops", settings.features, model.p50, model.p99)
    ).drop("_drops")


def scored_history(
    features: DataFrame, baseline: DataFrame, slos: DataFrame, model: Trained | None = None,
    settings: Settings = PRODUCTION, complete_only: bool = True,
) -> DataFrame:
    """All layers of every valid cycle, from features to the fire flags."""
    usable = valid_features(features)
    if complete_only:
        usable = drop_incomplete(usable)
    rows = derived_features(with_baseline(usable, baseline), settings)
    rows = layer_scores(with_slos(rows, slos), settings)
    if model is not None:
        rows = layer_ml(rows, model, settings)
    return replay_flags(combine(rows, settings, "ml_norm" if model is not None else None))


# --------------------------------------------------------------------------- KS and gates


def ks_statistic(a: DataFrame, b: DataFrame, value_a: str, value_b: str) -> DataFrame:
    """One row: largest gap between the two empirical distributions, and both sizes.

    Values are counted first, then accumulated bin-wise, so no task sorts all rows.
    """
    both = a.select(F.col(value_a).alias("v"), F.lit(1).alias("ia"), F.lit(0).alias("ib")).unionByName(
        b.select(F.col(value_b).alias("v"), F.lit(0).alias("ia"), F.lit(1).alias("ib"))
    )
    # written once: the inputs may be costly to score and the counts are read several times
    counts = stored(
        both.where(F.col("v").isNotNull()).groupBy("v").agg(
            F.sum("ia").alias("na"), F.sum("ib").alias("nb")
        ),
        "value-counts",
    )
    total = counts.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    cum = running_totals(
        counts, [], "v", {"ca": F.col("na"), "cb": F.col("nb")}, value_bin("v"), refine=F.col("v")
    )
    ta, tb = total.select("ta").scalar(), total.select("tb").scalar()
    gap = F.abs(F.col("ca") / ta - F.col("cb") / tb)
    return cum.agg(F.max(gap).alias("ks"), F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"))


def sanity_gate(
    candidate: Trained, previous: Trained | None, reference: DataFrame, settings: Settings = PRODUCTION
) -> tuple[bool, float | None]:
    """Scores of both models on the reference rows must have similar distributions."""
    if previous is None or reference.isEmpty():
        return True, None
    cols = [F.get("features", F.lit(i)) for i in range(len(settings.features))]
    new = reference.select(candidate.forest.score(cols).alias("raw"))
    old = reference.select(previous.forest.score(cols).alias("raw"))
    ks = ks_statistic(new, old, "raw", "raw").first()["ks"]
    return ks <= settings.sanity_ks_max, ks


def recall_and_fp(
    scored: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION, bucket_seconds: int = 3600
) -> DataFrame:
    """One row: recall and false positives of the layered detector on a replay."""
    onsets = replay_onsets(scored, settings)
    found = detections(onsets, injections, settings, bucket_seconds)
    fp = onsets_outside(onsets, injections, settings, bucket_seconds).where(F.col("detector") == "layered")
    return found.agg(
        (F.count("delay_layered") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("recall")
    ).select(
        F.coalesce("recall", F.lit(0.0)).alias("recall"), fp.select(F.count(F.lit(1))).scalar().alias("fp")
    )


def promotion_check(candidate: DataFrame, current: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Compare two ``recall_and_fp`` rows: recall may not drop, false positives may not explode."""
    both = candidate.select(
        F.col("recall").alias("recall_candidate"), F.col("fp").alias("fp_candidate"),
        current.select("recall").scalar().alias("recall_current"),
        current.select("fp").scalar().alias("fp_current"),
    )
    slack = F.greatest(
        F.lit(settings.fp_tolerance_abs), F.floor(F.col("fp_current") * settings.fp_tolerance_rel)
    )
    return both.withColumn(
        "recall_ok", F.col("recall_candidate") >= F.col("recall_current") - settings.recall_tolerance
    ).withColumn("fp_ok", F.col("fp_candidate") <= F.col("fp_current") + slack).withColumn(
        "ok", F.col("recall_ok") & F.col("fp_ok")
    )


def freshness_gate(features: DataFrame, as_of: Column, settings: Settings = PRODUCTION) -> DataFrame:
    """Age of the newest cycle in hours and whether it is recent enough; an empty table passes."""
    return features.agg(F.max("time").alias("_t")).select(
        ((F.unix_micros(as_of) - F.unix_micros("_t")) / F.lit(3600e6)).alias("age_hours")
    ).withColumn(
        "fresh", F.coalesce(F.col("age_hours") <= settings.max_data_age_hours, F.lit(True))
    )


def train_and_promote(
    store: ModelStore, features: DataFrame, baseline: DataFrame, injections: DataFrame, slos: DataFrame,
    as_of: datetime, settings: Settings = PRODUCTION, force: bool = False, dry_run: bool = False,
    bucket_seconds: int = 3600,
) -> dict:
    """Train on fault-free history, check the three gates and promote when they pass (or forced)."""
    spark = store.spark
    at = F.lit(as_of)
    matrix = stored(
        training_matrix(features, baseline, injections, at, settings, bucket_seconds).select("row_id", "features"),
        "train",
    )
    candidate = fit(matrix, as_of, settings)
    reference = store.ensure_reference(matrix, settings) if not dry_run else matrix.limit(0)
    previous = store.load_previous()
    gate, ks = sanity_gate(candidate, from_store(spark, previous) if previous else None, reference, settings)
    current = store.load_latest()
    valid = True
    if current is not None and not injections.isEmpty():
        new = recall_and_fp(scored_history(features, baseline, slos, candidate, settings), injections, settings, bucket_seconds)
        old = recall_and_fp(
            scored_history(features, baseline, slos, from_store(spark, current), settings), injections, settings, bucket_seconds
        )
        valid = promotion_check(new, old, settings).first()["ok"]
    fresh = freshness_gate(features, at, settings).first()["fresh"]
    passed = gate and valid and fresh
    if not dry_run:
        store.save(candidate.nodes, candidate.meta, candidate.meta.first()["version"], passed or force, as_of)
    return {
        "sanity": gate, "ks": ks, "validation": valid, "fresh": fresh,
        "promoted": (passed or force) and not dry_run,
    }


# --------------------------------------------------------------------------- drift


def drift_summary(reference: DataFrame, live: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Means, p95 and share of high scores; both inputs have ``ml_norm``."""
    p95 = exact_quantiles(live, [], "ml_norm", {"q": 0.95}).select("q").scalar()
    return live.agg(
        F.count("ml_norm").alias("n_live"),
        F.avg("ml_norm").alias("live_mean"),
        F.avg((F.col("ml_norm") >= settings.drift_live_cut).cast("double")).alias("live_anomaly_rate"),
    ).select(
        "n_live", reference.select(F.avg("ml_norm")).scalar().alias("ref_mean"), "live_mean",
        p95.alias("live_p95"), "live_anomaly_rate",
    )


def drift_check(
    reference: DataFrame, live: DataFrame, checked_at: Column, trained_at: Column,
    settings: Settings = PRODUCTION,
) -> DataFrame:
    """Row of the model-health table; empty when there are too few live scores."""
    ks = ks_statistic(reference, live, "ml_norm", "ml_norm").select("ks").scalar()
    s = drift_summary(reference, live, settings).where(F.col("n_live") >= settings.drift_min_live)
    four = lambda c: half_even(c, 4)
    return s.withColumn("_ks", ks).select(
        checked_at.alias("checked_at"), trained_at.alias("model_trained_at"), "n_live",
        four("_ks").alias("ks_drift"), four("ref_mean").alias("ref_mean"),
        four("live_mean").alias("live_mean"), four("live_p95").alias("live_p95"),
        four("live_anomaly_rate").alias("live_anomaly_rate"),
        (F.col("_ks") > settings.drift_ks_max).alias("drift_flag"),
    )


def live_scores(anomalies: DataFrame, as_of: Column, hours: float) -> DataFrame:
    """Calibrated forest scores of the anomaly store in the last hours."""
    age = (F.unix_micros(as_of) - F.unix_micros("detected_at")) / F.lit(3600e6)
    return anomalies.where(age < hours).select(F.col("contributing.ml_norm").alias("ml_norm")).where(
        F.col("ml_norm").isNotNull()
    )


# --------------------------------------------------------------------------- tuning


def threshold_sweep(
    scored: DataFrame, injections: DataFrame, thresholds: list[float],
    settings: Settings = PRODUCTION, bucket_seconds: int = 3600,
) -> DataFrame:
    """Detection quality per fire threshold, all thresholds in one job."""
    flags = scored.withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    ).withColumn(
        "layered_fire", F.col("static_fire") | (F.col("combined") >= F.col("threshold"))
    )
    onsets = replay_onsets(flags, settings, ["threshold"]).where(F.col("detector") == "layered")
    found = detections(
        onsets, injections, settings, bucket_seconds, ["threshold"],
        {"threshold": [float(t) for t in thresholds]},
    )
    hits = found.groupBy("threshold").agg(
        F.count("delay_layered").alias("tp"),
        (F.count(F.lit(1)) - F.count("delay_layered")).alias("fn"),
    )
    fp = onsets_outside(onsets, injections, settings, bucket_seconds).groupBy("threshold").agg(
        F.count(F.lit(1)).alias("fp")
    )
    counts = hits.join(fp, "threshold", "left").fillna(0, ["fp"])
    hours = injections.select(span_hours(injections, settings.pad_seconds)).scalar()
    out = with_ratios(counts, zero_f1=True)
    return out.withColumn("fp_per_hour", F.col("fp") / hours)


def contamination_sweep(
    features: DataFrame, baseline: DataFrame, injections: DataFrame, slos: DataFrame, as_of: datetime,
    contaminations: list[float], settings: Settings = PRODUCTION, bucket_seconds: int = 3600,
) -> DataFrame:
    """Detection quality per contamination: a model is trained, and the history scored with it, for each value.

    The calibrated score does not use the binary cut that contamination moves, so equal rows are the expected finding.
    """
    moment = F.lit(as_of.isoformat(sep=" ")).cast("timestamp")
    matrix = stored(training_matrix(features, baseline, injections, moment, settings, bucket_seconds), "matrix")
    out = None
    for c in contaminations:
        own = replace(settings, contamination=float(c))
        model = fit(matrix, as_of, own)
        scored = stored(scored_history(features, baseline, slos, model, own), "replayed")
        one = threshold_sweep(scored, injections, [own.fire_threshold], own, bucket_seconds)
        one = one.drop("threshold").withColumn("contamination", F.lit(float(model.meta.first()["contamination"])))
        out = one if out is None else out.unionByName(one)
    return out
