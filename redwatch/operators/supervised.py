"""Comparison of the forest with supervised gradient boosting on labelled cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PRODUCTION, Settings
from ..functions.ordered import exact_quantiles, running_totals, value_bin
from ..functions.scalars import plus_seconds
from ..sources.tables import stored
from .forest import Forest, train_forest
from .joins import interval_marks


def label_windows(
    rows: DataFrame, injections: DataFrame, margin_seconds: int, time: str = "time",
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Add ``label``: 1 inside a fault window of the same endpoint, else 0."""
    wide = injections.select(
        F.col("target_endpoint").alias("endpoint_id"),
        plus_seconds("injected_at", -margin_seconds).alias("_from"),
        plus_seconds("cleared_at", margin_seconds).alias("_to"),
    )
    marked = interval_marks(rows, wide, time, "_from", "_to", ["endpoint_id"], "_hit", bucket_seconds)
    return marked.withColumn("label", F.col("_hit").cast("int")).drop("_hit")


def temporal_split(
    rows: DataFrame, time: str = "time", tie: Sequence[str] = ("endpoint_id", "row_id")
) -> DataFrame:
    """Add ``split``: the first half of all rows in time order is train, the rest test."""
    work = rows.withColumn("_order", F.struct(time, *tie))
    work = running_totals(work, [], "_order", {"_pos": F.lit(1)}, None, with_ties=False)
    half = rows.select(F.floor(F.count(F.lit(1)) / 2)).scalar()
    return work.withColumn("split", F.when(F.col("_pos") <= half, "train").otherwise("test")).drop("_order", "_pos")


def binary_metrics(rows: DataFrame, label: str = "label", predicted: str = "pred", score: str = "score") -> DataFrame:
    """Precision, recall, F1, ROC AUC and average precision in one row.

    Scores are counted per value and accumulated from high to low; average precision is the step
    sum.  Both areas are null when only one class occurs.
    """
    y, p = F.col(label) == 1, F.col(predicted) == 1
    # written once: the scores are costly and the counts are read several times
    counts = stored(
        rows.groupBy((-F.col(score)).alias("_s")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")),
        "score-counts",
    )
    cum = running_totals(
        counts, [], "_s", {"tp": F.col("pos"), "fp": F.col("neg")}, value_bin("_s"), refine=F.col("_s")
    )
    total = rows.agg(
        F.count_if(y).alias("P"), F.count_if(~y).alias("N"),
        F.count_if(y & p).alias("hit"), F.count_if(p).alias("said"),
    )
    areas = cum.agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("area"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("steps"),
    )
    t = total.withColumn("area", areas.select("area").scalar()).withColumn(
        "steps", areas.select("steps").scalar()
    )
    zero = F.lit(0.0)
    two = (F.col("P") > 0) & (F.col("N") > 0)
    out = t.select(
        F.coalesce(F.col("hit") / F.nullif(F.col("said"), F.lit(0)), zero).alias("precision"),
        F.coalesce(F.col("hit") / F.nullif(F.col("P"), F.lit(0)), zero).alias("recall"),
        F.when(two, F.col("area") / (F.col("P") * F.col("N"))).alias("roc_auc"),
        F.when(two, F.col("steps") / F.col("P")).alias("pr_auc"),
    )
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero)
    return out.select("precision", "recall", F.coalesce(f1, zero).alias("f1"), "roc_auc", "pr_auc")


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``: rows / (2 x rows of the class)."""
    n = rows.select(F.count(F.lit(1))).scalar()
    pos = rows.select(F.count_if(F.col(label) == 1)).scalar()
    size = F.when(F.col(label) == 1, pos).otherwise(n - pos)
    return rows.withColumn("weight", n / (2.0 * size))


def fit_boosting(train: DataFrame, rounds: int = 300, depth: int = 4, step: float = 0.1, seed: int = 42):
    data = balanced_weights(train).withColumn("vector", array_to_vector("features"))
    return GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth,
        stepSize=step, seed=seed,
    ).fit(data)


def boosting_scores(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows.withColumn("vector", array_to_vector("features")))
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn(
        "pred", (F.col("score") >= 0.5).cast("int")
    ).drop("vector", "rawPrediction", "probability", "prediction")


def forest_scores(train: DataFrame, test: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Forest scores of the test rows; the binary cut is the contamination quantile of training."""
    n = train.count()
    nodes = stored(train_forest(train, n, settings), "nodes")
    forest = Forest(train.sparkSession, nodes, min(settings.subsample, n))
    cols = [F.get("features", F.lit(i)) for i in range(len(settings.features))]
    scored = stored(train.select(forest.score(cols).alias("raw")), "raw")
    cut = exact_quantiles(scored, [], "raw", {"cut": 1.0 - settings.contamination}).first()["cut"]
    return test.withColumn("score", forest.score(cols)).withColumn(
        "pred", (F.col("score") > cut).cast("int")
    )


def supervised_compare(
    labelled: DataFrame, settings: Settings = PRODUCTION, rounds: int = 300
) -> tuple[DataFrame, object, DataFrame]:
    """Metrics of both models on the later half of the rows, the boosting model and the test rows.

    ``labelled`` has row_id, endpoint_id, time, features and label.
    """
    split = stored(temporal_split(labelled), "split")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    boosting = fit_boosting(train, rounds)
    sup = binary_metrics(boosting_scores(boosting, test)).withColumn("model", F.lit("gradient boosting"))
    uns = binary_metrics(forest_scores(train, test, settings)).withColumn("model", F.lit("isolation forest"))
    return sup.unionByName(uns), boosting, test


def _f1() -> Column:
    """F1 of ``pred`` against ``label`` as one aggregate."""
    actual, said = F.col("label") == 1, F.col("pred") == 1
    size = F.count_if(actual) + F.count_if(said)
    return F.coalesce(2 * F.count_if(actual & said) / F.nullif(size, F.lit(0)), F.lit(0.0))


def _shuffled_positions(rows: DataFrame, name: str, seed: int, row_id: str) -> DataFrame:
    """Add a dense position in hash order; bins of the hash give offsets, so no global sort."""
    work = rows.withColumn("_h", F.struct(F.xxhash64(row_id, F.lit(seed)).alias("h"), row_id))
    return running_totals(
        work, [], "_h", {name: F.lit(1)}, F.shiftright(F.col("_h.h"), 52), with_ties=False
    ).drop("_h")


def permutation_importance(
    model, test: DataFrame, names: Sequence[str], repeats: int = 5, seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """Mean drop of F1 when one feature is shuffled among the test rows."""
    base = test.select(row_id, "features", "label")
    placed = _shuffled_positions(base, "_pos", seed, row_id)
    variants = None
    for r in range(repeats):
        donor = _shuffled_positions(base, "_pos", seed + 1 + r, row_id).select(
            "_pos", F.col("features").alias("_donor")
        )
        one = placed.join(donor, "_pos").select(
            F.lit(r).alias("repeat"), F.posexplode(F.array(*[F.lit(n) for n in names])).alias("_j", "feature"),
            "features", "_donor", "label",
        )
        variants = one if variants is None else variants.unionByName(one)
    mixed = variants.withColumn(
        "features",
        F.transform("features", lambda x, i: F.when(i == F.col("_j"), F.get("_donor", i)).otherwise(x)),
    )
    whole = boosting_scores(model, base).select(_f1()).scalar()
    per = boosting_scores(model, mixed).groupBy("feature", "repeat").agg(_f1().alias("_f1"))
    return per.groupBy("feature").agg((whole - F.avg("_f1")).alias("importance"))
