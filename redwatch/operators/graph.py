"""Call graph of endpoints: descendants, parents, cycle check and root-cause candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CALL_TYPE_WEIGHTS, OTHER_CALL_WEIGHT, PRODUCTION, Settings
from ..functions.scalars import status_of_direction, half_even
from .components import strong_components
from .joins import asof_latest


def descendants(edges: DataFrame, roots: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """Endpoints reached from each root in at most ``depth`` calls, with path and last call type.

    A fixed, small number of self-joins; a path never visits an endpoint twice.
    """
    e = edges.select(
        F.col("parent_endpoint_id").alias("_p"), F.col("child_endpoint_id").alias("_c"),
        F.col("child_service").alias("_s"), F.col("call_type").alias("_t"),
        F.col("parent_service").alias("_ps"),
    )
    first = e.where(F.col("_p") != F.col("_c"))
    if roots is not None:
        first = first.join(roots.select(F.col("endpoint_id").alias("_p")).distinct(), "_p", "left_semi")
    level = first.select(
        F.col("_p").alias("root"), F.col("_c").alias("endpoint_id"), F.col("_s").alias("service"),
        F.col("_t").alias("call_type"), F.lit(1).alias("depth"), F.array("_p", "_c").alias("path"),
        F.col("_ps").alias("root_service"),
    )
    levels = [level]
    for d in range(2, depth + 1):
        level = (
            level.join(e, level["endpoint_id"] == e["_p"])
            .where(~F.array_contains("path", F.col("_c")))
            .select(
                "root", F.col("_c").alias("endpoint_id"), F.col("_s").alias("service"),
                F.col("_t").alias("call_type"), F.lit(d).alias("depth"),
                F.array_append("path", F.col("_c")).alias("path"), "root_service",
            )
        )
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).distinct()


def parents(edges: DataFrame) -> DataFrame:
    """One-call parents of every endpoint."""
    return edges.select(
        F.col("child_endpoint_id").alias("root"),
        F.col("parent_endpoint_id").alias("endpoint_id"),
        F.col("parent_service").alias("service"),
        "call_type",
        F.col("child_service").alias("root_service"),
    )


def neighbours(edges: DataFrame, depth: int = 3) -> DataFrame:
    """Distinct (root, endpoint_id) over descendants and parents."""
    return (
        descendants(edges, depth=depth).select("root", "endpoint_id")
        .unionByName(parents(edges).select("root", "endpoint_id"))
        .distinct()
    )


def current_service(edges: DataFrame) -> DataFrame:
    """Service of an endpoint: as a child if it is called, else as a parent."""
    as_child = edges.groupBy(F.col("child_endpoint_id").alias("root")).agg(
        F.min("child_service").alias("_child")
    )
    as_parent = edges.groupBy(F.col("parent_endpoint_id").alias("root")).agg(
        F.min("parent_service").alias("_parent")
    )
    return as_child.join(as_parent, "root", "full").select(
        "root", F.coalesce("_child", "_parent").alias("root_service")
    )


def topology_load(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New edges that are not stored yet."""
    key = ["parent_endpoint_id", "child_endpoint_id"]
    return new.dropDuplicates(key).join(existing, key, "left_anti")


def topology_check(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New edges that must be rejected: self-loops and edges on a cycle of all edges together.

    An edge lies on a cycle exactly if both its ends are in one strongly connected component.
    """
    key = ["parent_endpoint_id", "child_endpoint_id"]
    loops = new.where(F.col(key[0]) == F.col(key[1])).select(*key).distinct()
    proper = new.where(F.col(key[0]) != F.col(key[1])).select(*key).distinct()
    labels = strong_components(existing.select(*key).unionByName(proper), *key)
    ends = proper
    for c in key:
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left")
    first, second = (F.coalesce(f"_{c}", c) for c in key)
    return (
        loops.withColumn("reason", F.lit("self-loop"))
        .unionByName(ends.where(first == second).select(*key, F.lit("cycle").alias("reason")))
    )


# --------------------------------------------------------------------------- root cause


def rca_confidence_score(score, call_type, depth, settings: Settings = PRODUCTION) -> Column:
    """Plausibility of the causal link: score x weight of the last call / distance, capped."""
    weight = reduce(
        lambda acc, kv: acc.when(F.col(call_type) == kv[0], F.lit(kv[1])),
        CALL_TYPE_WEIGHTS.items(),
        F.when(F.lit(False), F.lit(0.0)),
    ).otherwise(OTHER_CALL_WEIGHT)
    far = F.lit(1.0) / F.greatest(F.lit(1), F.col(depth))
    return half_even(F.least(F.lit(settings.rca_cap), F.col(score) * weight * far), 2)


def rca_level(score, settings: Settings = PRODUCTION) -> Column:
    s = F.col(score)
    return F.when(s >= settings.rca_high, "high").when(s >= settings.rca_medium, "medium").otherwise("low")


def rca_reason(level, call_type, depth) -> Column:
    """Short note of the evidence: kind of call, distance, rating. It never calls a cause proven."""
    return F.format_string("%s evidence, %s call at distance %d, unproven", F.col(level), F.col(call_type), F.col(depth))


def neighbour_scores(
    rows: DataFrame, relations: DataFrame, anomalies: DataFrame, settings: Settings = PRODUCTION
) -> DataFrame:
    """Attach to each (row, neighbour) the neighbour's newest anomaly before the row.

    ``rows`` are (endpoint_id, detected_at); ``relations`` have ``root`` and the neighbour's
    ``endpoint_id``.  The upper bound is strict: only earlier cycles are known while one is scored.
    """
    left = rows.select(F.col("endpoint_id").alias("root"), "detected_at").join(relations, "root")
    right = anomalies.select(
        "endpoint_id", F.col("detected_at").alias("_seen"),
        F.col("score").alias("anomaly_score"), "direction",
    )
    out = asof_latest(
        left, right, "detected_at", "_seen", ["endpoint_id"], settings.neighbour_lookback_seconds,
        ["anomaly_score", "direction"], strict=True,
    )
    return out.withColumn("status", status_of_direction("direction"))


def root_cause_candidates(scored_descendants: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Degraded descendants, one entry per endpoint (best confidence, then shortest path)."""
    cand = scored_descendants.where(
        (F.col("direction") == "degradation") & F.col("anomaly_score").isNotNull()
    ).withColumn("confidence_score", rca_confidence_score("anomaly_score", "call_type", "depth", settings))
    keys = ["root", "detected_at", "endpoint_id"]
    rest = [c for c in cand.columns if c not in keys]
    rank = F.struct("confidence_score", (-F.col("depth")).alias("near"), F.concat_ws(">", "path").alias("p"))
    best = cand.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_b")).select(*keys, "_b.*")
    return best.withColumn("confidence", rca_level("confidence_score", settings)).withColumn(
        "reason", rca_reason("confidence", "call_type", "depth")
    )


def _listed(rows: DataFrame, fields: list, order: list, name: str) -> DataFrame:
    """One array per (root, detected_at); its length is bounded by the neighbours of an endpoint."""
    item = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("v"))
    return rows.groupBy("root", "detected_at").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias(name)
    )


def service_graph(
    rows: DataFrame, edges: DataFrame, anomalies: DataFrame, settings: Settings = PRODUCTION
) -> DataFrame:
    """Graph document per (endpoint_id, detected_at): service, children, parents, candidates."""
    desc = neighbour_scores(rows, descendants(edges, depth=settings.graph_depth), anomalies, settings)
    par = neighbour_scores(rows, parents(edges), anomalies, settings)
    info = ["endpoint_id", "service", "call_type"]
    state = ["status", "anomaly_score", "direction"]
    children = _listed(
        desc.where(F.col("depth") == 1), [*info, "depth", "path", *state], [F.col("endpoint_id")], "children"
    )
    parent_list = _listed(par, [*info, *state], [F.col("endpoint_id")], "parents")
    cand = _listed(
        root_cause_candidates(desc, settings),
        [*info, "depth", "path", *state, "confidence_score", "confidence", "reason"],
        [-F.col("confidence_score"), F.col("endpoint_id")],
        "root_cause_candidates",
    )
    keys = ["root", "detected_at"]
    out = children.join(parent_list, keys, "full").join(cand, keys, "left")
    return out.join(current_service(edges), "root", "left").select(
        F.col("root").alias("endpoint_id"), "detected_at", F.col("root_service").alias("service"),
        "children", "parents", "root_cause_candidates",
    )
