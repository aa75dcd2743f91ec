import duckdb
import pytest

from compare import connect, same

FOLDER = "/root/testdata/sf0.01"
# a quick selection; tests/compare.py runs all of them
KEYS = (
    "red_features", "red_features_exact", "histogram_quantile", "counter_rate", "seasonal_baseline", "baseline_global",
    "baseline_lookup", "score_replay", "alert_state_machine", "alert_episodes", "fault_attribution", "detection_stats",
    "threshold_sweep", "ks_cdf", "binary_metrics", "temporal_split", "explanation_rubric", "response_validate",
    "ground_truth_source", "label_windows", "cardinality_guard", "llm_run_stats", "iforest_train", "layer_ml", "layer_timeline",
    "ablation_attribution", "drift_check",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_every_sql_has_a_query(entry):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    parser = duckdb.connect()
    for text in sql.values():
        assert parser.execute("SELECT json_serialize_sql(?)", [text]).fetchone() is not None


def test_entry(spark, entry):
    df = entry.entry(spark)
    assert df.count() > 0 and "layered_fire" in df.columns


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, entry, key):
    diff, rows = same(entry.queries()[key](spark, FOLDER), con, entry.oracle_sql()[key])
    assert diff is None and rows > 0
