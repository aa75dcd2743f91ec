import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from redwatch.config import PRODUCTION
from redwatch.operators.baseline import seasonal_baseline
from redwatch.operators.baseline_state import BaselineState, difference, merged

MONDAY = datetime(2024, 1, 1)
METRICS = ("p99_ms", "rps")
SHORT = replace(PRODUCTION, baseline_days=14, baseline_min_samples=3)
FEATURE = "time timestamp, endpoint_id string, p99_ms double, rps double"
FAULT = "injected_at timestamp, cleared_at timestamp"


def day(n, minutes=0):
    return MONDAY + timedelta(days=n, minutes=minutes)


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """30 days of cycles every 20 minutes in four hours of the day; equal values, nulls and NaN among them."""
    rnd = random.Random(8)
    rows = [
        (day(d, 60 * h + 20 * m), e, rnd.choice([5.0, rnd.random() * 100, None, float("nan")]), rnd.choice([1.0, 2.0, rnd.random()]))
        for d in range(30) for h in (0, 5, 13, 23) for m in range(3) for e in ("a", "b")
    ]
    path = str(tmp_path_factory.mktemp("features"))
    spark.createDataFrame(rows, FEATURE).write.mode("overwrite").parquet(path)
    return spark.read.schema(FEATURE).parquet(path)


def content(df):
    return sorted(tuple(r) for r in df.select("endpoint_id", "metric", "dow", "hour_bucket", *[F.round(c, 9) for c in ("p10", "p50", "p90")], "sample_count").collect())


def full(history, faults, as_of):
    return content(seasonal_baseline(history, faults, F.lit(as_of), SHORT, METRICS))


def test_updates_equal_the_whole_lookback(spark, history, tmp_path):
    state = BaselineState(spark, str(tmp_path / "state"), SHORT, METRICS)
    one, late, ongoing = (day(9, 290), day(9, 330)), (day(12, 0), day(12, 30)), (day(21, 780), None)
    steps = [
        (day(13), [one]),
        (day(15), [one]),                       # two days in, one out
        (day(16, 330), [one, late]),            # a fault of four days ago becomes known
        (day(16, 330 + 60), [late]),            # one is withdrawn
        (day(23), [late, ongoing]),             # a week later, a fault that goes on
        (day(29), [late, (ongoing[0], day(21, 800))]),  # it had ended long ago
    ]
    for as_of, known in steps:
        faults = spark.createDataFrame(known, FAULT)
        state.advance(history, faults, as_of)
        assert content(state.baseline()) == full(history, faults, as_of), as_of
    assert len(state.versions()) == len(steps)
    # the last update again, as after a lost driver
    assert state.advance(history, faults, as_of) == state.versions()[-1]
    assert content(state.baseline()) == full(history, faults, as_of)
    with pytest.raises(ValueError):
        state.advance(history, faults, day(20))
    # beyond the lookback nothing is left
    empty = spark.createDataFrame([], FAULT)
    state.advance(history, empty, day(60))
    assert state.baseline().isEmpty() and not state._heads(state.versions()[-1])["counts"]


def test_an_hour_touches_two_hours(spark, history, tmp_path):
    none = spark.createDataFrame([], FAULT)
    state = BaselineState(spark, str(tmp_path / "state"), SHORT, METRICS)
    first = state.advance(history, none, day(20, 300))
    second = state.advance(history, none, day(20, 360))
    heads = state._heads(second)["bands"]
    # day 20 is a Sunday: hour 5 of it came in, hour 5 of the Sunday two weeks before went out
    assert [s for s, v in heads.items() if v == second] == [5] and len(heads) == 28
    assert {v for s, v in heads.items() if s != 5} == {first}
    assert difference(history, (day(20, 360), none), (day(20, 360), none), SHORT, METRICS).isEmpty()


def test_taking_away_too_much_is_an_error(spark):
    counts = spark.createDataFrame([("a", "rps", 1, 5, 1.0, 2)], "endpoint_id string, metric string, dow int, hour_bucket int, value double, n bigint")
    assert merged(counts, counts.withColumn("n", -F.col("n"))).isEmpty()
    with pytest.raises(Exception, match="rebuild"):
        merged(counts, counts.withColumn("n", F.lit(-3).cast("bigint"))).collect()
