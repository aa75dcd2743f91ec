"""Strongly connected components of a directed graph, for graphs that do not fit one task.

Three steps alternate on a shrinking edge table. Trimming drops endpoints without an incoming or an outgoing edge: they lie on no cycle.
Contraction bypasses endpoints with one edge in and one out, those whose hash is below both neighbours', so a long chain shrinks by a
constant share a round; what was bypassed is undone at the end, in reverse. Where neither helps any more, colouring finds components:
the largest name that reaches an endpoint is its colour, and all endpoints that reach that name within the colour are one
component. No table is larger than the endpoints and edges together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: A round of trimming and contraction that leaves more than this share of the edges makes way for colouring.
SHRINK = 0.8


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that come from an endpoint with incoming and lead to one with outgoing edges."""
    entered = edges.select(F.col("v").alias("u")).distinct()
    left = edges.select(F.col("u").alias("v")).distinct()
    return edges.join(entered, "u", "left_semi").join(left, "v", "left_semi").select("u", "v")


def _bypassed(edges: DataFrame, turn: int) -> DataFrame:
    """(node, prev, next) of chosen endpoints with one edge in and one out; no two of them are neighbours."""
    entering = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("prev"), F.count(F.lit(1)).alias("_in"))
    leaving = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("next"), F.count(F.lit(1)).alias("_out"))
    draw = lambda c: F.xxhash64(F.lit(turn), F.col(c))
    chain = entering.where("_in = 1").join(leaving.where("_out = 1"), "node")
    return chain.where((draw("node") < draw("prev")) & (draw("node") < draw("next"))).select("node", "prev", "next")


def _contracted(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    rest = edges.join(chosen.select(F.col("node").alias("u")), "u", "left_anti").join(chosen.select(F.col("node").alias("v")), "v", "left_anti")
    short = chosen.where("prev <> next").select(F.col("prev").alias("u"), F.col("next").alias("v"))
    return rest.select("u", "v").unionByName(short).distinct()


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the largest name among an endpoint and all that reach it."""
    colours = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    colours = stored(colours.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "colours")
    while not colours.where("new").isEmpty():
        moved = edges.join(colours.where("new").select(F.col("node").alias("u"), "colour"), "u").groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("other"))
        best = F.greatest("colour", F.coalesce("other", "colour"))
        colours = stored(colours.join(moved, "node", "left").select("node", best.alias("colour"), (best > F.col("colour")).alias("new")), "colours")
    return colours.select("node", "colour")


def _roots_reached(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, component): endpoints that reach the endpoint that gave them their colour, over ``edges`` of one colour."""
    frontier = stored(colours.where("node = colour").select("node", F.col("colour").alias("component")), "frontier")
    found = [frontier]
    while not frontier.isEmpty():
        known = reduce(DataFrame.unionByName, found).select("node")
        before = edges.join(frontier.select(F.col("node").alias("v"), "component"), "v").select(F.col("u").alias("node"), "component").distinct()
        frontier = stored(before.join(known, "node", "left_anti"), "frontier")
        found.append(frontier)
        if len(found) % 8 == 0:
            found = [stored(reduce(DataFrame.unionByName, found), "reached")]
    return reduce(DataFrame.unionByName, found)


def strong_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, component) of endpoints in a component with others, but for the one that names it; all others are components alone.

    Two endpoints are in the same component exactly if their names, replaced by the component where there is one, are equal.
    """
    edges = stored(edges.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u <> v").distinct(), "edges")
    size, turn, undo = edges.count(), 0, []
    kind = edges.schema["u"].dataType.simpleString()
    labels = edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    while size:
        shrinking = True
        while size and shrinking:
            turn += 1
            trimmed = stored(_trimmed(_trimmed(edges)), "edges")
            chosen = stored(_bypassed(trimmed, turn), "bypassed")
            edges = stored(_contracted(trimmed, chosen), "edges")
            undo.append(chosen)
            left = edges.count()
            shrinking, size = left < SHRINK * size, left
        if not size:
            break
        colours = stored(_coloured(edges), "colours")
        both = edges.join(colours.select(F.col("node").alias("u"), "colour"), "u").join(colours.select(F.col("node").alias("v"), F.col("colour").alias("other")), "v")
        same = stored(both.where("colour = other").select("u", "v"), "edges")
        reached = stored(_roots_reached(same, colours), "component")
        labels = stored(labels.unionByName(reached.where("node <> component")), "labels")
        # an endpoint that leads into a found component is in it or in none with it
        edges = stored(same.join(reached.select(F.col("node").alias("u")), "u", "left_anti"), "edges")
        size = edges.count()
    for k, chosen in enumerate(reversed(undo)):
        name = lambda c, labels=labels: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        named = chosen.join(name("prev"), "prev", "left").join(name("next"), "next", "left")
        prev, after = F.coalesce("_prev", "prev"), F.coalesce("_next", "next")
        labels = labels.unionByName(named.where(prev == after).select("node", prev.alias("component")))
        if k % 4 == 3:
            labels = stored(labels, "labels")
    return labels
