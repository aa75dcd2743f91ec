import random
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from redwatch.config import PRODUCTION
from redwatch.operators import attribution, graph

INJ = "scenario_id string, fault_type string, target_service string, target_endpoint string, injected_at timestamp, cleared_at timestamp, source_file string"
EDGE = "parent_endpoint_id string, child_endpoint_id string, parent_service string, child_service string, call_type string"


@pytest.fixture(scope="module")
def fault(spark, minute):
    return spark.createDataFrame([("s", "latency", "orders", "GET /orders", minute(720), minute(730), "f.json")], INJ)


def alert(spark, at, endpoint="GET /orders", service="orders"):
    return spark.createDataFrame([("a1", endpoint, service, at)], "alert_id string, endpoint_id string, service string, opened_at timestamp")


@pytest.mark.parametrize("offset, endpoint, score", [
    (725, "other", 1.0), (705, "other", 0.5), (705, "GET /orders", 0.6), (685, "GET /orders", 0.0), (745, "other", 0.5), (725, "GET /orders", 1.0),
])
def test_fault_score(spark, minute, fault, offset, endpoint, score):
    r = attribution.fault_attribution(alert(spark, minute(offset), endpoint), fault).first()
    assert r["imputation_score"] == pytest.approx(score)
    assert r["suspected_fault"] == ("s:latency:GET /orders" if score else None)


def test_best_fault_prefers_score_then_match_then_time(spark, minute):
    rows = [("far", "f", "x", "zzz", minute(0), minute(5), "a"), ("match", "f", "orders", "GET /orders", minute(15), minute(40), "b"), ("early", "f", "x", "zzz", minute(10), minute(40), "c"), ("late", "f", "x", "zzz", minute(12), minute(40), "d")]
    inj = spark.createDataFrame(rows, INJ)
    got = lambda i: attribution.fault_attribution(alert(spark, minute(20)), i).first()["suspected_fault"]
    assert got(inj).startswith("match") and got(inj.where("scenario_id <> 'match'")).startswith("early")


def test_deploy_attribution(spark, minute):
    rows = [("old", "orders", "v1", minute(0)), ("near", "pay", "v2", minute(25)), ("own", "orders", "v3", minute(21)), ("after", "orders", "v4", minute(31))]
    d = spark.createDataFrame(rows, "deploy_id string, service string, version string, deployed_at timestamp")
    out = attribution.deploy_attribution(alert(spark, minute(30)), d).first()
    # 25: 1 - 5/30 = 0.8333; 21: (1 - 9/30) * 1.2 = 0.84
    assert (out["suspected_deploy_id"], out["deploy_score"]) == ("own", 0.84)
    prior = attribution.deploy_attribution(alert(spark, minute(30)), d.withColumn("kind", F.when(F.col("service") == "pay", "release").otherwise("flag")), kind_prior={"flag": 0.5}).first()
    assert prior["suspected_deploy_id"] == "near"
    none = attribution.deploy_attribution(alert(spark, minute(30)), d.where("deploy_id = 'after'")).first()
    assert none["suspected_deploy_id"] is None


def edges(spark, *pairs):
    return spark.createDataFrame([(p, c, f"{p}-svc", f"{c}-svc", t) for p, c, t in pairs], EDGE)


def graph_of(spark, minute, e, scores, root="A"):
    anomalies = spark.createDataFrame([(k, minute(5), s, d) for k, (s, d) in scores.items()], "endpoint_id string, detected_at timestamp, score double, direction string")
    rows = spark.createDataFrame([(root, minute(6))], "endpoint_id string, detected_at timestamp")
    return graph.service_graph(rows, e, anomalies, PRODUCTION).first()


DEG = "degradation"


@pytest.mark.parametrize("kind, score, conf, level", [("direct", 0.9, 0.9, "high"), ("cascade", 0.9, 0.63, "medium"), ("other", 1.0, 0.75, "high"), ("direct", 1.0, 0.95, "high"), ("cascade", 1.0, 0.7, "high")])
def test_one_hop_confidence(spark, minute, kind, score, conf, level):
    c = graph_of(spark, minute, edges(spark, ("A", "B", kind)), {"B": (score, DEG)})["root_cause_candidates"][0]
    assert (c["confidence_score"], c["confidence"]) == (conf, level)


def test_two_hops_use_the_last_call(spark, minute):
    g = graph_of(spark, minute, edges(spark, ("A", "B", "direct"), ("B", "C", "cascade")), {"C": (0.9, DEG), "B": (0.1, "normal")})
    c = g["root_cause_candidates"][0]
    assert (c["endpoint_id"], c["depth"], c["call_type"], c["confidence"], list(c["path"])) == ("C", 2, "cascade", "low", ["A", "B", "C"])
    assert [x["status"] for x in g["children"]] == ["normal"] and g["service"] == "A-svc"


def test_diamond_keeps_one_entry_and_bounds_depth(spark, minute):
    e = edges(spark, ("A", "B", "direct"), ("A", "C", "direct"), ("B", "D", "cascade"), ("C", "D", "direct"), ("D", "E", "direct"), ("E", "F", "direct"))
    g = graph_of(spark, minute, e, {k: (0.9, DEG) for k in "DEF"})
    assert [(c["endpoint_id"], c["confidence_score"], c["call_type"]) for c in g["root_cause_candidates"]] == [("D", 0.45, "direct"), ("E", 0.3, "direct")]


def test_neighbour_scores_are_earlier_and_recent(spark, minute):
    e = edges(spark, ("A", "B", "direct"))
    a = spark.createDataFrame([("B", minute(0), 0.1, "x"), ("B", minute(3), 0.2, "x"), ("B", minute(6), 0.9, "x")], "endpoint_id string, detected_at timestamp, score double, direction string")
    rows = spark.createDataFrame([("A", minute(m)) for m in (0, 6, 16, 17)], "endpoint_id string, detected_at timestamp")
    got = {r["detected_at"].minute: r["anomaly_score"] for r in graph.neighbour_scores(rows, graph.descendants(e), a).collect()}
    assert got == {0: None, 6: 0.2, 16: 0.9, 17: None}


def test_cycle_check_against_search(spark):
    rnd = random.Random(8)
    known = {(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(40)) if a < b}
    new = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(25)} - known
    every = known | {(a, b) for a, b in new if a != b}
    step = {}
    for a, b in every:
        step.setdefault(a, set()).add(b)

    def reaches(a, b):
        seen, todo = {a}, [a]
        while todo:
            for n in step.get(todo.pop(), ()):
                if n == b:
                    return True
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return a == b

    want = {(str(a), str(b)) for a, b in new if a == b or reaches(b, a)}
    frame = lambda s: spark.createDataFrame([(str(a), str(b)) for a, b in s], "parent_endpoint_id string, child_endpoint_id string")
    got = graph.topology_check(frame(known), frame(new)).collect()
    assert {(r[0], r[1]) for r in got} == want and len(got) == len(want) > 0


def test_sound_topology_and_load(spark):
    e = edges(spark, ("A", "B", "direct"), ("B", "C", "direct"))
    assert graph.topology_check(e.where("parent_endpoint_id = 'A'"), e.where("parent_endpoint_id = 'B'")).count() == 0
    more = edges(spark, ("A", "B", "direct"), ("C", "D", "direct"), ("C", "D", "direct"))
    assert [r["child_endpoint_id"] for r in graph.topology_load(e, more).collect()] == ["D"]


def strong(pairs):
    """{node: nodes of its component} by search from every node."""
    step = {}
    for a, b in pairs:
        step.setdefault(a, set()).add(b)
    nodes = {x for p in pairs for x in p}

    def reached(a):
        seen, todo = {a}, [a]
        while todo:
            for n in step.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    reach = {a: reached(a) for a in nodes}
    return {a: {b for b in reach[a] if a in reach[b]} for a in nodes}


def grouped(spark, pairs):
    """(groups of endpoints with the same component, rounds of trimming) for all endpoints of ``pairs``."""
    from redwatch.operators import components

    rounds, plain = [], components._trimmed
    components._trimmed = lambda edges: (rounds.append(1), plain(edges))[1]
    try:
        got = components.strong_components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    finally:
        components._trimmed = plain
    label = {r["node"]: r["component"] for r in got}
    assert len(label) == len(got) and not any(k == v for k, v in label.items())
    out = {}
    for x in {x for p in pairs for x in p}:
        out.setdefault(label.get(x, x), set()).add(x)
    return {frozenset(g) for g in out.values()}, len(rounds) // 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = 60
    pairs = [(str(rnd.randrange(n)), str(rnd.randrange(n))) for _ in range(50 + 20 * seed)]
    pairs += [(f"r{i}", f"r{(i + 1) % 17}") for i in range(17)] + [("x", "y"), ("y", "x"), ("y", "0"), ("r3", "z"), ("r5", "1")]
    got, _ = grouped(spark, pairs)
    assert got == {frozenset(g) for g in strong(pairs).values()}


def test_long_chains_take_few_rounds(spark):
    path = [(f"p{i}", f"p{i + 1}") for i in range(3000)]
    ring = [(f"q{i}", f"q{(i + 1) % 2000}") for i in range(2000)]
    got, rounds = grouped(spark, path + ring)
    assert rounds <= 25
    assert {len(g) for g in got} == {1, 2000} and len(got) == 3002
