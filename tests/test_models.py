import math
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from redwatch.config import MODEL_FEATURES, PRODUCTION
from redwatch.operators import forest, model_ops, supervised
from redwatch.sources.model_store import ModelStore, reference_window
from redwatch.sources.tables import fresh_path

SMALL = replace(PRODUCTION, trees=30)
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i:04d}", [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(700, 7)))]
    return spark.createDataFrame(rows, "row_id string, features array<double>").cache()


@pytest.fixture(scope="module")
def model(matrix):
    return model_ops.fit(matrix, T0, SMALL)


def scores(spark, model, points):
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "i int, features array<double>")
    cols = [F.get("features", F.lit(i)) for i in range(7)]
    return [r["s"] for r in df.select("i", model.forest.score(cols).alias("s")).orderBy("i").collect()]


def test_forest_ranks_outliers_and_stays_in_range(spark, model):
    center, far, huge = scores(spark, model, [[0] * 7, [6] * 7, [1e6] * 7])
    assert 0 < center < 0.5 < far < 1 and huge > center


def test_every_tree_has_a_full_sample(matrix, model):
    leaves = model.nodes.where("is_leaf").groupBy("tree").agg(F.sum("size").alias("n"), F.max("depth").alias("d")).collect()
    assert len(leaves) == 30 and {r["n"] for r in leaves} == {256} and max(r["d"] for r in leaves) <= 8


def test_model_does_not_depend_on_partitioning(matrix, model):
    again = forest.train_forest(matrix.repartition(13), 700, SMALL)
    assert again.exceptAll(model.nodes).count() == 0 == model.nodes.exceptAll(again).count()
    other = forest.train_forest(matrix, 700, replace(SMALL, seed=1))
    assert other.exceptAll(model.nodes).count() > 0


def test_node_table_gives_the_same_score_as_a_plain_walk(spark, model):
    nodes = {(r["tree"], r["node"]): r for r in model.nodes.collect()}
    point = [0.3, -1.0, 2.0, 0.0, 1.5, -0.2, 0.7]
    total = 0.0
    for tree in range(30):
        n = nodes[tree, 0]
        while not n["is_leaf"]:
            n = nodes[tree, n["left"] if point[n["feature"]] <= n["threshold"] else n["right"]]
        total += n["depth"] + float(forest.expected_path(n["size"]))
    assert scores(spark, model, [point])[0] == pytest.approx(2 ** (-(total / 30) / float(forest.expected_path(256))))


def test_expected_path():
    assert list(forest.expected_path([1, 2])) == [0.0, 1.0] and float(forest.expected_path(256)) == pytest.approx(10.2448, abs=1e-3)


def test_attribution_names_the_odd_feature(spark, model):
    df = spark.createDataFrame([[0.0, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0]], ", ".join(f"{c} double" for c in ("baseline_dev_p50", "baseline_dev_p95", "baseline_dev_p99", "feature_error_rate_5xx", "latency_slope", "p99_over_p50", "rps_delta")))
    top = model_ops.with_attribution(df, model, SMALL).first()["ml_top"]
    assert len(top) == 3 and top[0]["name"] == "latency_slope" and top[0]["score"] > 0


def test_calibration_anchors(spark, matrix, model):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.3, 0.45, 0.6, 0.9)], "raw double")
    assert [r[0] for r in df.select(forest.calibrate("raw", 0.3, 0.6)).collect()] == pytest.approx([0, 0, 0.5, 1, 1])
    assert [r[0] for r in df.select(forest.calibrate("raw", 0.3, 0.3)).collect()] == [0.0] * 5
    x = np.array([r["features"] for r in matrix.collect()])
    assert model.medians == pytest.approx(list(np.median(x, axis=0)))
    assert model.meta.first()["feature_names"] == list(MODEL_FEATURES)


def test_ks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400).round(1), rng.normal(0.5, 1, size=300).round(1)
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "v double")
    ks = lambda p, q: model_ops.ks_statistic(frame(p), frame(q), "v", "v").first()["ks"]
    grid = np.concatenate([a, b])
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert ks(a, b) == pytest.approx(want) == ks(b, a)
    assert ks(a, a) == 0.0 and ks([1.0, 2.0], [8.0, 9.0]) == 1.0


def test_store_gates_and_reference(spark, matrix, model):
    store = ModelStore(spark, fresh_path(spark, "models"))
    assert store.load_latest() is None and store.load_previous() is None
    ref = store.ensure_reference(matrix, replace(SMALL, reference_rows=50))
    assert ref.count() == 50
    again = store.ensure_reference(matrix.limit(10), SMALL)
    assert again.exceptAll(ref).count() == 0
    store.save(model.nodes, model.meta, "20240101_000000", False, T0)
    assert store.load_latest() is None and store.load_previous().version == "20240101_000000"
    store.save(model.nodes, model.meta.withColumn("version", F.lit("b")), "b", True, T0)
    current = model_ops.CurrentModel(store)
    old = current.get()
    assert current.get() is old and old.medians == pytest.approx(model.medians)
    assert model_ops.sanity_gate(model, None, ref, SMALL) == (True, None)
    ok, ks = model_ops.sanity_gate(model, old, ref, SMALL)
    assert ok and ks == 0.0
    assert reference_window(matrix.repartition(5), replace(SMALL, reference_rows=50)).exceptAll(ref).count() == 0


def test_promotion_and_freshness(spark):
    frame = lambda r, f: spark.createDataFrame([(r, f)], "recall double, fp bigint")
    ok = lambda *a: model_ops.promotion_check(frame(*a[:2]), frame(*a[2:])).first()["ok"]
    assert ok(0.7, 10, 0.7, 10) and ok(0.65, 3, 0.7, 1) and ok(0.7, 15, 0.7, 10)
    assert not ok(0.6, 1, 0.7, 1) and not ok(0.7, 16, 0.7, 10) and not ok(0.7, 4, 0.7, 1)
    now = F.lit(T0)
    rows = lambda *h: spark.createDataFrame([(T0 - timedelta(hours=x),) for x in h], "time timestamp")
    assert model_ops.freshness_gate(rows(30, 20), now).first()["fresh"]
    assert not model_ops.freshness_gate(rows(30), now).first()["fresh"]
    assert model_ops.freshness_gate(rows(), now).first()["fresh"]


def test_drift_needs_enough_live_rows(spark):
    frame = lambda n, v: spark.createDataFrame([(v + i / 1000,) for i in range(n)], "ml_norm double")
    check = lambda n, v: model_ops.drift_check(frame(80, 0.1), frame(n, v), F.lit(T0), F.lit(T0)).collect()
    assert check(49, 0.9) == []
    assert check(60, 0.8)[0]["drift_flag"] and not check(80, 0.1)[0]["drift_flag"]


def test_too_few_rows_are_refused(matrix):
    with pytest.raises(ValueError):
        model_ops.fit(matrix.limit(50), T0, SMALL)


def test_binary_metrics(spark):
    # two ties across classes; areas checked against the definitions
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    s = [0.9, 0.8, 0.8, 0.7, 0.4, 0.4, 0.4, 0.1]
    rows = [(a, int(b >= 0.5), b) for a, b in zip(y, s)]
    got = supervised.binary_metrics(spark.createDataFrame(rows, "label int, pred int, score double")).first()
    pairs = [(p, n) for p, a in zip(s, y) if a for n, b in zip(s, y) if not b]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    ap, prev = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(a for a, b in zip(y, s) if b >= t)
        ap += (tp / 4 - prev) * tp / sum(b >= t for b in s)
        prev = tp / 4
    assert [got["precision"], got["recall"], got["f1"], got["roc_auc"], got["pr_auc"]] == pytest.approx([0.75, 0.75, 0.75, auc, ap])
    one = supervised.binary_metrics(spark.createDataFrame([(0, 0, 0.5)], "label int, pred int, score double")).first()
    assert one["roc_auc"] is None and one["f1"] == 0.0


def test_supervised_comparison_and_importance(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        bad = int(rng.random() < 0.2)
        x = rng.normal(size=7)
        x[2] += 4 * bad
        rows.append((f"r{i}", "e", T0 + timedelta(minutes=i), [float(v) for v in x], bad))
    df = spark.createDataFrame(rows, "row_id string, endpoint_id string, time timestamp, features array<double>, label int")
    split = supervised.temporal_split(df)
    assert split.where("split = 'train'").agg(F.max("time")).first()[0] == T0 + timedelta(minutes=199)
    metrics, boosting, test = supervised.supervised_compare(df, SMALL, rounds=5)
    by = {r["model"]: r for r in metrics.collect()}
    assert by["gradient boosting"]["pr_auc"] > 0.7 and by["isolation forest"]["roc_auc"] > 0.5
    imp = {r["feature"]: r["importance"] for r in supervised.permutation_importance(boosting, test, MODEL_FEATURES, 2).collect()}
    assert max(imp, key=imp.get) == "baseline_dev_p99" and len(imp) == 7


def test_sampling_chance_does_not_depend_on_the_number_of_rows(spark):
    """Far more rows than trees x subsample: every row may enter, and each tree is full."""
    settings = replace(SMALL, trees=8, subsample=32, seed=3)
    n = 20_000
    matrix = spark.range(n).select(F.col("id").cast("string").alias("row_id"), F.array(F.rand(1)).alias("features"))
    picked = forest.tree_samples(matrix, n, settings).select("tree", "row_id").collect()
    assert len(picked) == 8 * 32 and len({(r["tree"], r["row_id"]) for r in picked}) == len(picked)
    assert {r["tree"] for r in picked} == set(range(8))
    ids = np.array([int(r["row_id"]) for r in picked])
    assert abs(ids.mean() / n - 0.5) < 0.08 and (np.histogram(ids, 4, (0, n))[0] > 30).all()


def test_binomial_steps():
    steps = forest._binomial_steps(5, 0.3)
    want = np.cumsum([math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in range(5)])
    assert np.allclose(steps, want)


def test_trees_equal_a_plain_recursion(matrix, model):
    """One tree grown row by row from the same md5 draws."""
    import hashlib

    tree = 3
    rows = [r["features"] for r in forest.tree_samples(matrix, 700, SMALL).where(F.col("tree") == tree).collect()]
    want = {}

    def grow(part, node, depth):
        lo, hi = [min(c) for c in zip(*part)], [max(c) for c in zip(*part)]
        vary = [i for i in range(7) if hi[i] > lo[i]]
        if depth == 8 or not vary:
            want[node] = (-1, 0.0, len(part))
            return
        digest = hashlib.md5(f"{SMALL.seed}|{tree}|{node}".encode()).hexdigest()
        f = vary[int(int(digest[:8], 16) / 2**32 * len(vary))]
        cut = lo[f] + int(digest[8:21], 16) / 2**52 * (hi[f] - lo[f])
        cut = lo[f] if cut >= hi[f] else cut
        want[node] = (f, cut, len(part))
        grow([p for p in part if p[f] <= cut], 2 * node + 1, depth + 1)
        grow([p for p in part if p[f] > cut], 2 * node + 2, depth + 1)

    grow(rows, 0, 0)
    got = {r["node"]: (r["feature"], r["threshold"], r["size"]) for r in model.nodes.where(F.col("tree") == tree).collect()}
    assert got == want


def test_equal_rows_make_one_leaf(spark):
    same = spark.range(300).select(F.col("id").cast("string").alias("row_id"), F.array(*[F.lit(1.5)] * 7).alias("features"))
    nodes = forest.train_forest(same, 300, replace(SMALL, trees=4)).collect()
    assert len(nodes) == 4 and all(r["is_leaf"] and r["size"] == 256 and r["node"] == 0 for r in nodes)
