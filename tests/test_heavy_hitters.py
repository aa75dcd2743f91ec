import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from redwatch.streaming import heavy_hitters
from redwatch.streaming.red_stream import run_to_table


def test_absorb_keeps_its_bounds():
    rnd = random.Random(2)
    for capacity in (1, 3, 20):
        counts, floor, truth = pd.Series(dtype="int64"), 0, Counter()
        for _ in range(40):
            batch = Counter(int(rnd.paretovariate(0.8)) for _ in range(rnd.choice([0, 1, 60])))
            truth.update(batch)
            counts, floor = heavy_hitters.absorb(counts, floor, pd.Series(dict(batch), dtype="int64"), capacity)
            assert len(counts) <= capacity and (counts > 0).all()
            assert floor <= truth.total() // (capacity + 1)
            for name, true in truth.items():
                sure = counts.get(name, 0)
                assert sure <= true <= sure + floor


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """Six files in six batches, the query started twice; one endpoint holds a third of the rows, most are rare."""
    rnd = random.Random(5)
    source, truth = tmp_path_factory.mktemp("spans"), Counter()
    out, checkpoint = (str(tmp_path_factory.mktemp(n) / n) for n in ("summaries", "state"))

    def add(n):
        names = [rnd.choice(["hot"] + [f"big{rnd.randrange(6)}", f"rare{rnd.randrange(5000)}"]) for _ in range(3000)]
        rows = [(n * 10_000 + i, None if name == "big0" else name) for i, name in enumerate(names)]
        truth.update("quarantine" if e is None else e for _, e in rows)
        spark.createDataFrame(rows, "span_id bigint, endpoint_id string").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        spans = spark.readStream.schema("span_id bigint, endpoint_id string").option("maxFilesPerTrigger", 1).parquet(str(source))
        return run_to_table(heavy_hitters.endpoint_summaries(spans, "span_id", capacity=60, shards=4), out, checkpoint)

    for n in range(3):
        add(n)
    run()
    for n in range(3, 6):
        add(n)
    return truth, run()


def test_summaries_stay_small_and_bound_the_counts(streamed):
    truth, summaries = streamed
    sizes = summaries.groupBy("shard", "seen").agg(F.count("*").alias("n"), F.max("floor").alias("floor")).collect()
    assert all(r["n"] <= 60 and r["floor"] <= r["seen"] // 61 for r in sizes)
    newest = {}
    for r in sizes:
        newest[r["shard"]] = max(newest.get(r["shard"], 0), r["seen"])
    # rows are dealt, not names: no shard is loaded by the hot endpoint
    assert sum(newest.values()) == truth.total() and max(newest.values()) < 0.3 * truth.total()
    got = {r["endpoint_id"]: r for r in heavy_hitters.bounds(summaries).collect()}
    assert all(r["at_least"] <= truth[e] <= r["at_most"] for e, r in got.items())
    error = next(iter(got.values()))["at_most"] - next(iter(got.values()))["at_least"]
    assert error <= truth.total() // 61 and all(truth[e] <= error for e in truth if e not in got)


def test_busiest_equals_the_batch_where_counts_part(streamed):
    truth, summaries = streamed
    got = heavy_hitters.busiest(summaries, 7).orderBy("rank").collect()
    want = {e for e, _ in truth.most_common(7)}
    assert {r["endpoint_id"] for r in got} == want and got[0]["endpoint_id"] == "hot" and all(r["certain"] for r in got)
    more = heavy_hitters.busiest(summaries, 9).collect()
    assert [r["certain"] for r in sorted(more, key=lambda r: r["rank"])][7:] == [False, False]
    # a batch that is written twice counts once
    assert heavy_hitters.busiest(summaries.unionAll(summaries), 7).orderBy("rank").collect() == got


def test_busiest_of_nothing(spark):
    none = spark.createDataFrame([], heavy_hitters.SUMMARY)
    assert heavy_hitters.busiest(none, 3).count() == 0
