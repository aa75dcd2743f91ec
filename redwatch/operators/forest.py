"""Isolation forest (Liu, Ting, Zhou 2008) on DataFrames.

Sampling, growth, scoring and attribution are distributed.  A tree grows from at most ``subsample``
rows.  The whole forest has at most trees x (2 x subsample - 1) nodes, which bounds what is
collected and broadcast, whatever the size of the data.

All draws are md5 numbers of (seed, tree, node) or (row id, tree, seed) and path lengths are summed
in units of 1e-9, so any engine that computes md5 and doubles grows the same trees and scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import PRODUCTION, Settings
from ..functions.arrays import top_by_abs
from ..functions.scalars import half_even
from ..functions.ordered import exact_quantiles

EULER_GAMMA = 0.5772156649015329


def expected_path(n):
    """Mean depth of an unsuccessful search among ``n`` points (array or number)."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    big = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


PATH_UNIT = 1e9


def _unit_hash(digest: Column, start: int = 1, digits: int = 13) -> Column:
    """Number in [0, 1) from hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("double") / F.lit(float(16**digits))


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _binomial_steps(n: int, p: float) -> list[float]:
    """P(X < k) for k = 1, 2 ... n of a binomial variable, as far as it differs from one."""
    if p >= 1.0:
        return [0.0] * n
    out, below = [], 0.0
    for k in range(n):
        log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
        below += math.exp(log)
        if below >= 1.0 - 1e-15:
            break
        out.append(below)
    return out or [1.0]


def tree_samples(
    matrix: DataFrame, n_rows: int, settings: Settings = PRODUCTION, row_id: str = "row_id"
) -> DataFrame:
    """Assign rows to trees: ``subsample`` distinct rows per tree, chosen by hashes of the row id.

    Every row is offered to every tree with the same chance, whatever the number of rows; a tree then takes the rows of smallest
    hash. One hash per row draws from the binomial distribution how many trees it is offered to, and only rows offered to some
    are hashed once more per tree. The choice does not depend on the partitioning.
    """
    per_tree = min(settings.subsample, n_rows)
    chance = min(1.0, (2.0 * per_tree + 64.0) / max(n_rows, 1))
    below = _binomial_steps(settings.trees, chance)
    u = _unit_hash(_digest(F.col(row_id), settings.seed))
    count = F.when(u >= below[0], F.size(F.filter(F.array(*[F.lit(x) for x in below]), lambda x: x <= u))).otherwise(0)
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(settings.trees - 1)),
        lambda t: F.struct(_digest(F.col(row_id), t, settings.seed + 1).alias("h"), t.alias("t")),
    )
    trees = F.transform(F.slice(F.array_sort(drawn), F.lit(1), F.col("_count")), lambda x: x["t"])
    pool = matrix.withColumn("_count", count).where(F.col("_count") > 0)
    offered_rows = pool.withColumn("tree", F.explode(trees)).drop("_count").withColumn(
        "_h", _digest(F.col(row_id), F.col("tree"), settings.seed + 2)
    )
    order = W.partitionBy("tree").orderBy("_h", row_id)
    return (
        offered_rows.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= per_tree)
        .drop("_h", "_n")
    )


def _split(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """Add to each row the split of its node: ``_size``, ``_f`` (null where nothing can be split) and ``_cut``.

    A feature is drawn among those that vary in the node, the cut between its smallest and largest value, the largest excluded,
    so both sides get rows under ``value <= cut``.
    """
    node = W.partitionBy("tree", "node")
    value = [F.get("features", F.lit(i)) for i in range(width)]
    seen = rows.withColumns({
        "_size": F.count(F.lit(1)).over(node),
        "_lo": F.array(*[F.min(v).over(node) for v in value]),
        "_hi": F.array(*[F.max(v).over(node) for v in value]),
        "_d": _digest(seed, F.col("tree"), F.col("node")),
    })
    varying = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("_hi", i) > F.get("_lo", i))
    drawn = seen.withColumn("_vary", varying).withColumn(
        "_f", F.get("_vary", F.floor(_unit_hash(F.col("_d"), 1, 8) * F.size("_vary")).cast("int"))
    )
    lo, hi = F.get("_lo", F.col("_f")), F.get("_hi", F.col("_f"))
    drawn = drawn.withColumn("_cut", lo + _unit_hash(F.col("_d"), 9, 13) * (hi - lo))
    return drawn.withColumn("_cut", F.when(F.col("_cut") >= hi, lo).otherwise(F.col("_cut"))).drop(
        "_lo", "_hi", "_d", "_vary"
    )


def train_forest(
    matrix: DataFrame, n_rows: int, settings: Settings = PRODUCTION, row_id: str = "row_id"
) -> DataFrame:
    """Node table of a forest; ``matrix`` has a row id and the array ``features``.

    All trees grow together, one level after the other: the rows of a node meet in a window, which draws the split and sends each
    row on to a child.  The windows of all levels reuse the one shuffle by tree of the samples.  Nodes are numbered as in a heap:
    the children of node k are 2k + 1 and 2k + 2.
    """
    limit = max(1, math.ceil(math.log2(max(2, min(settings.subsample, n_rows)))))
    rows = tree_samples(matrix, n_rows, settings, row_id).select(
        "tree", "features", F.lit(0).alias("node"), F.array().cast(_PATH).alias("path")
    )
    for depth in range(limit + 1):
        rows = _split(rows, len(settings.features), settings.seed)
        inner = F.col("_f").isNotNull() & F.lit(depth < limit) & F.col("node").isNotNull()
        step = F.struct(
            F.col("node"), F.when(inner, F.col("_f")).otherwise(-1).alias("feature"),
            F.when(inner, F.col("_cut")).otherwise(0.0).alias("threshold"), (~inner).alias("is_leaf"),
            F.lit(depth).alias("depth"), F.col("_size").cast("int").alias("size"),
        )
        left = F.get("features", F.col("_f")) <= F.col("_cut")
        child = F.when(inner, 2 * F.col("node") + F.when(left, 1).otherwise(2))
        # rows that have reached their leaf wait under a null node
        grown = F.when(F.col("node").isNull(), F.col("path")).otherwise(F.concat("path", F.array(step)))
        rows = rows.select("tree", "features", child.alias("node"), grown.alias("path"))
    nodes = rows.select("tree", F.inline("path")).groupBy("tree", "node").agg(
        *[F.first(c).alias(c) for c in ("feature", "threshold", "is_leaf", "depth", "size")]
    )
    child = lambda k: F.when(F.col("is_leaf"), -1).otherwise(2 * F.col("node") + k)
    return nodes.select(
        "tree", "node", "feature", "threshold", child(1).alias("left"), child(2).alias("right"), "is_leaf", "depth", "size"
    )


_PATH = "array<struct<node:int,feature:int,threshold:double,is_leaf:boolean,depth:int,size:int>>"


class Forest:
    """Scoring form of a node table, shipped to the workers once.

    The scoring functions are declared non-deterministic only so that the optimizer neither
    repeats them nor moves them into filters; their results depend on the features alone.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame, subsample: int):
        table = nodes.orderBy("tree", "node").toPandas()
        trees = []
        for _, t in table.groupby("tree"):
            t = t.sort_values("node")
            value = np.rint((t["depth"].to_numpy(float) + expected_path(t["size"].to_numpy())) * PATH_UNIT).astype(np.int64)
            leaf = t["is_leaf"].to_numpy(bool)
            own, ids = np.arange(len(t)), t["node"].to_numpy()
            trees.append((
                np.where(leaf, 0, t["feature"].to_numpy()).astype(np.int64),
                t["threshold"].to_numpy(float),
                np.where(leaf, own, np.searchsorted(ids, t["left"].to_numpy())).astype(np.int64),
                np.where(leaf, own, np.searchsorted(ids, t["right"].to_numpy())).astype(np.int64),
                value,
                int(t["depth"].max()) if len(t) else 0,
            ))
        self.trees = len(trees)
        self.subsample = subsample
        self._shipped = spark.sparkContext.broadcast((trees, float(expected_path(max(subsample, 2)))))

    def score(self, features: list[Column]) -> Column:
        """Anomaly score in (0, 1), larger is more anomalous; vectorised over Arrow batches."""
        shipped = self._shipped

        @F.pandas_udf("double")
        def forest_score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            return pd.Series(_score(x, *shipped.value))

        return forest_score.asNondeterministic()(*features)

    def ablation(self, features: list[Column], medians: list[float]) -> Column:
        """Score drop when each feature is set to its median, as array in feature order."""
        shipped = self._shipped
        center = np.asarray(medians, dtype=float)

        @F.pandas_udf("array<double>")
        def forest_drops(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            base = _score(x, *shipped.value)
            drops = np.empty_like(x)
            for j in range(x.shape[1]):
                y = x.copy()
                y[:, j] = center[j]
                drops[:, j] = base - _score(y, *shipped.value)
            return pd.Series(list(drops))

        return forest_drops.asNondeterministic()(*features)


def _score(x: np.ndarray, trees: list[tuple], norm: float) -> np.ndarray:
    total = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for feature, cut, left, right, value, depth in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            at = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
        total += value[at]
    return np.power(2.0, -(total / (PATH_UNIT * max(len(trees), 1))) / norm)


def calibrate(raw, p50: float, p99: float) -> Column:
    """Linear from the typical score (0) to the extreme training score (1), clipped."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    if p99 - p50 < 1e-9:
        return F.when(raw.isNotNull(), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - p50) / (p99 - p50)))


def calibration_params(scores: DataFrame, raw: str = "raw") -> DataFrame:
    """One row: p50, p95, p99 and max of the raw scores."""
    q = exact_quantiles(scores, [], raw, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    top = scores.select(F.max(raw)).scalar()
    return q.withColumn("max", top)


def feature_medians(matrix: DataFrame, names, features: str = "features") -> DataFrame:
    """Median of each feature, in long form (feature, median)."""
    long = matrix.select(F.posexplode(features).alias("_i", "value")).withColumn(
        "feature", F.get(F.array(*[F.lit(n) for n in names]), F.col("_i"))
    )
    return exact_quantiles(long, ["feature"], "value", {"median": 0.5})


def ablation_attribution(drops, names, p50: float, p99: float, k: int = 3) -> Column:
    """The k features whose removal lowers the score most, in calibrated units."""
    span = max(p99 - p50, 1e-9)
    d = F.col(drops) if isinstance(drops, str) else drops
    ranked = top_by_abs(names, [F.get(d, F.lit(i)) / span for i in range(len(names))], k)
    return F.transform(
        ranked, lambda p: F.struct(p["name"].alias("name"), half_even(p["score"], 4).alias("score"))
    )
