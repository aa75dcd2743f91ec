"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Two small collections of minhash groups are computed per document. A table key is a pair, one group from each collection, so
``groups`` x ``groups`` tables need only 2 x ``groups`` x ``rows`` minhashes. Two documents meet in some table exactly if they
agree on a group of the first *and* on a group of the second collection; documents that share no group with anybody
on one of the sides are dropped before any pair key is formed.

Documents with equal shingle sets are one node, named by a number of its own: an id may stand for several texts, and each keeps its
links. Within a bucket every node is compared with the smallest one only; links found
so far make components. Buckets that still hold different components are looked at again: nodes with too many shingles of
their own leave, the rest of each crowd is compared in blocks, those outside the largest component against all. So no
link between candidates is lost, no list of pairs is formed, and most of a group of near copies costs one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stages, components
from .words import mix, window_starts, windows, words_of

#: A pair of similarity 0.85 shares a key with probability 0.99998, one of 0.8 with 0.9993, one of 0.3 with 0.08, one of 0.2 with 0.01.
GROUPS = 12
ROWS = 3
#: Shingles on either side of a block of comparisons.
BLOCK = 100_000

_SEEDS = np.random.default_rng(20240301).integers(1, 2**63, 4096, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(set sizes, shingle hashes row after row, each row sorted and distinct) per slice of a text column.

    A text of fewer than ``k`` words has its whole sequence as its only shingle; one without words has none.
    """
    for _, rows, hashes, bounds, _, _ in words_of(column, lower=True):
        at, text = window_starts(bounds, k)
        whole = windows(hashes, k)[at] if len(at) else np.zeros(0, np.uint64)
        cut = np.searchsorted(text, np.arange(rows + 1))
        sets = []
        for r in range(rows):
            n = bounds[r + 1] - bounds[r]
            if n >= k:
                sets.append(np.unique(whole[cut[r] : cut[r + 1]]))
            elif n:
                sets.append(windows(hashes[bounds[r] : bounds[r + 1]], int(n), seed=1))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield np.array([len(s) for s in sets], np.int64), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def group_keys(sizes: np.ndarray, shingles: np.ndarray, groups: int, rows: int) -> np.ndarray:
    """(texts, 2 x groups) keys: hashes of ``rows`` minhashes, the first collection in the first half. Needs no empty sets."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), 2 * groups), np.uint64)
    for g in range(2 * groups):
        key = np.full(len(sizes), _SEEDS[2048 + g], np.uint64)
        for j in range(rows):
            seed = _SEEDS[g * rows + j]
            value = (shingles ^ seed) * (seed | np.uint64(1))
            value ^= value >> np.uint64(32)
            key = mix(key + np.minimum.reduceat(value * np.uint64(0x9FB21C651E98DF25), starts))
        out[:, g] = key
    return out


def signatures(docs: DataFrame, k: int, groups: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (fingerprint of the set), keys (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sizes, shingles in shingle_sets(batch.column("text"), k):
                n = len(sizes)
                full = sizes > 0
                prints = fingerprints(sizes, shingles)
                keys = pa.nulls(n, pa.list_(pa.int64()))
                if full.any():
                    found = group_keys(sizes[full], shingles, groups, rows).view(np.int64)
                    width = np.where(full, 2 * groups, 0)
                    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
                    keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()), mask=pa.array(~full))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, n), pa.array(sizes), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), keys],
                    ["doc_id", "n", "f1", "f2", "keys"],
                )
                done += n

    rows_in = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows_in.mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def fingerprints(sizes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """(2, texts): two sums of hashes over each set, 0 for an empty one."""
    out, full = np.zeros((2, len(sizes)), np.uint64), sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        for i in range(2):
            out[i, full] = np.add.reduceat(mix(shingles ^ _SEEDS[4000 + i]), starts)
    return out


def stored_sets(docs: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node, set (sorted 64-bit shingle hashes as bytes) for ``nodes`` (node, n, f1, f2, and low, the id of a document that has the set).

    All texts of such an id are read; the fingerprint tells which of them is meant.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, shingles in shingle_sets(batch.column("text"), k):
                ends = np.cumsum(sizes)
                sets = [shingles[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
                f1, f2 = fingerprints(sizes, shingles).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(f1), pa.array(f2), pa.array(sets, pa.binary())], ["n", "f1", "f2", "set"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("low"), F.col(f"`{text_col}`").alias("text"))
    # the ids grow with the documents: merged at every size, never sent to all tasks
    wanted = nodes.select("low").distinct().hint("merge")
    sets = texts.join(wanted, "low", "left_semi").select("text").mapInArrow(gather, "n long, f1 long, f2 long, set binary")
    return sets.dropDuplicates(["n", "f1", "f2"]).join(nodes.select("node", "n", "f1", "f2"), ["n", "f1", "f2"]).select("node", "set")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets overlap by at least ``percent`` of their union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                joint = np.concatenate([p, q])
                joint.sort()
                both = int((joint[1:] == joint[:-1]).sum())
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def promising(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``nodes`` (node, n) without those of which too few shingles occur in any other of them to reach ``percent``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, blob in zip(batch.column("node").to_pylist(), batch.column("set"), strict=True):
                h = np.frombuffer(blob.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node, np.int64)), pa.array(h)], ["node", "shingle"])

    items = nodes.join(sets, "node").select("node", "set").mapInArrow(spread, "node long, shingle long")
    # a shingle that one node alone has lowers what that node can share: one row per such shingle, counted per node
    alone = items.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("often")).where("often = 1")
    lost = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    fit = 100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")
    return nodes.join(lost, "node", "left").where(fit).select(*nodes.columns)


def _block_links(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        stray = group.column("stray").to_numpy()
        node, component, n = (group.column(c).to_numpy() for c in ("node", "component", "n"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
        others = np.flatnonzero(~stray)
        if not len(others) or not stray.any():
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 2, schema=schema)
        tokens, ids = np.unique(np.concatenate([sets[i] for i in others]), return_inverse=True)
        starts = np.cumsum(n[others]) - n[others]
        present = np.zeros(len(tokens), np.int32)
        found = []
        for x in np.flatnonzero(stray):
            at = np.minimum(np.searchsorted(tokens, sets[x]), len(tokens) - 1)
            at = at[tokens[at] == sets[x]]
            present[at] = 1
            both = np.add.reduceat(present[ids], starts)
            present[at] = 0
            hit = (100 * both.astype(np.int64) >= percent * (n[x] + n[others] - both)) & (component[others] != component[x])
            # one link into each component is enough
            _, one = np.unique(component[others][hit], return_index=True)
            found += [(node[x], y) for y in node[others][hit][one]]
        table = np.array(found, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], schema=schema)

    return compare


def crowd_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components that met in some bucket; ``cells`` is (key, node, n, component).

    Nodes that met, directly or over others, are a crowd. The nodes outside a crowd's largest component are compared with
    all of the crowd, in blocks of about ``BLOCK`` shingles a side, and one link into each other component is kept.
    """
    stages = Stages(cells.sparkSession, "crowd")
    mixed = cells.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    here = cells.join(mixed, "key", "left_semi")
    nodes = stages.put(here.select("node", "n", "component").distinct())
    able = stages.put(promising(nodes, sets, percent))
    left = here.join(able.select("node"), "node", "left_semi")
    heads = left.groupBy("key").agg(F.min("node").alias("head"))
    crowds = components(left.join(heads, "key").select(F.col("head").alias("a"), F.col("node").alias("b")))
    rows = stages.put(able.join(crowds.select("node", F.col("component").alias("crowd")), "node"))
    stages.drop(nodes, able)
    parts = rows.groupBy("crowd", "component").agg(F.sum("n").alias("n"))
    sizes = parts.groupBy("crowd").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    blocks = sizes.select("crowd", F.col("top.component").alias("largest"), F.ceil(F.col("n") / BLOCK).cast("int").alias("mb"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("sb"))
    placed = rows.join(blocks, "crowd").withColumn("h", F.xxhash64("node"))
    every = placed.select("*", F.lit(False).alias("stray"), F.pmod("h", "mb").cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("s"))
    strays = placed.where("component <> largest").select("*", F.lit(True).alias("stray"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod("h", "sb").cast("int").alias("s"))
    both = every.unionByName(strays).select("crowd", "s", "m", "stray", "node", "component", "n").join(sets, "node")
    return both.groupBy("crowd", "s", "m").applyInArrow(_block_links(percent), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    groups: int = GROUPS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Texts are compared by their sets of ``k``-word shingles (A-Z folded); a link needs an overlap of ``percent`` of the union. A
    null text, or one without words, has an empty set and links with nothing. Equal sets are linked, so repeated rows
    share a component. Rows that share an id but not the text are documents of their own, each with its own links, and not
    linked by the id. A component is named by its smallest id. A row without an id is in no component (component_id null,
    kept false). Other columns are not read; an empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "minhash")
    signed = stages.put(signatures(docs, k, groups, rows, id_col, text_col))
    classes = (
        signed.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("n", "f1", "f2")
        .agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows"))
    )
    # numbered when written, so that the numbers stay
    nodes = stages.put(classes.withColumn("node", F.monotonically_increasing_id()))
    # keep what shares a group with another node, on both sides
    halves = nodes.select("node", "n", F.posexplode("keys").alias("place", "key"))
    # written before the join, as the heads are below: then the rows of a key that many share can be split over tasks
    met = stages.put(halves.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("key"))
    first = F.when(F.col("place") < groups, F.col("key"))
    second = F.when(F.col("place") >= groups, F.col("key"))
    sides = halves.join(met, "key").groupBy("node", "n").agg(F.collect_list(first).alias("x"), F.collect_list(second).alias("y"))
    paired = sides.where("size(x) > 0 AND size(y) > 0").select("node", "n", F.explode(F.expr("flatten(transform(x, p -> transform(y, q -> xxhash64(p, q))))")).alias("key"))
    cells = stages.put(paired)
    heads = cells.groupBy("key").agg(F.min("node").alias("head"), F.min_by("n", "node").alias("head_n"), F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = stages.put(heads)
    buckets = stages.put(cells.join(heads, "key"))
    stages.drop(cells, heads, met)
    wanted = stages.put(nodes.select("node", "n", "f1", "f2", "low").join(buckets.select("node").distinct(), "node", "left_semi"))
    sets = stages.put(stored_sets(docs, wanted, k, id_col, text_col))
    fit = 100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")
    stars = stages.put(buckets.where((F.col("head") < F.col("node")) & fit).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    links = stages.put(confirmed(stars, sets, percent))
    labels = components(links)
    # buckets that still hold several components
    named = buckets.select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = stages.put(crowd_links(named, sets, percent))
    if not found.isEmpty():
        labels = components(links.unionByName(found))
    stages.drop(buckets, sets, stars, wanted)
    linked = nodes.select("node", "n", "f1", "f2", "low", "rows").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # written before the join with their members, of which one component may have most
    lowest = stages.put(linked.groupBy("component").agg(F.min("low").alias("least"), F.sum("rows").alias("members")).where("members > 1").select("component", "least"))
    group = linked.join(lowest, "component").select("n", "f1", "f2", "least")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return signed.join(group, ["n", "f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )
