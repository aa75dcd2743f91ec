"""Embedding near-dedup: exact tiled comparison along principal components.

Unit vectors are rotated onto the principal components of all vectors, strongest first, and cut into tiles of ``TILE`` vectors that
lie near each other in the leading components. A pair of tiles is skipped when the boxes around them allow no cosine at the threshold.
Else its pairs are compared by the leading components alone: their product plus the product of the norms of what is left bounds the
cosine from above, and a pair is given up as soon as that bound is below the threshold. The few that remain get more components,
then the exact cosine in double precision. Tiles are written once; a task reads two at a time, whatever the input, and returns one
row per linked vector (links counted, and the smallest vector it reaches inside the two tiles), never the pairs.

Equal vectors are compared once. The comparison stays quadratic in the number of different vectors, as an exact one over
vectors without low-dimensional structure must; what shrinks is the work per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import fresh_path
from . import ranks
from .shared import Stages, components

#: Vectors per tile.
TILE = 4096
#: Components after which a pair can be given up; also those of a tile's box.
STEPS = (24, 40)
#: Leading components that order the tiles, and bits of each.
ORDER, ORDER_BITS = 4, 5
#: What single precision may err by in the first bound.
SLACK = 1e-4
#: Tasks that compare pairs of tiles, at most; each then takes several.
TASKS = 16_384


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component so that no square overflows or vanishes."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def principal(vectors: DataFrame, widths: list[int]) -> dict[int, np.ndarray]:
    """Principal axes of the unit vectors of each length in ``widths`` as columns, strongest first.

    Of ``vectors`` (width, vector) only the squared sums, width x width numbers a length, reach the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                u = units(matrix(batch.column("vector").filter(pa.array(width == w)), w))
                total[w] = total.get(w, 0) + u.T @ u
        for w, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w * w, w)), pa.array(np.arange(w * w)), pa.array(sums.ravel())], ["width", "cell", "value"])

    out = {w: np.zeros(w * w) for w in widths}
    if widths:
        rows = vectors.where(F.col("width").isin(widths)).select(F.col("width").cast("long").alias("width"), "vector")
        for r in rows.mapInArrow(moments, "width long, cell long, value double").groupBy("width", "cell").agg(F.sum("value").alias("value")).toLocalIterator():
            out[r["width"]][r["cell"]] = r["value"]
    return {w: np.linalg.eigh(sums.reshape(w, w))[1][:, ::-1].copy() for w, sums in out.items()}


def order_key(projected: np.ndarray) -> np.ndarray:
    """Number whose bits take turns among the leading components: vectors near each other there mostly get near numbers."""
    level = np.clip((projected[:, :ORDER] + 1) * (1 << ORDER_BITS - 1), 0, (1 << ORDER_BITS) - 1).astype(np.int64)
    out = np.zeros(len(level), np.int64)
    for bit in range(ORDER_BITS - 1, -1, -1):
        for k in range(level.shape[1]):
            out = out << 1 | level[:, k] >> bit & 1
    return out


def box(projected: np.ndarray) -> np.ndarray:
    """Smallest and largest leading components of a tile, and the largest norm of what is left: one row of 2 x lead + 1 numbers."""
    lead = min(STEPS[0], projected.shape[1])
    rest = np.sqrt((projected[:, lead:] ** 2).sum(axis=1)).max()
    return np.concatenate([projected[:, :lead].min(axis=0), projected[:, :lead].max(axis=0), [rest]])


def reach(a: np.ndarray, b: np.ndarray) -> float:
    """No two vectors of two boxes have a larger cosine."""
    lead = len(a) // 2
    corners = [x * y for x in (a[:lead], a[lead:-1]) for y in (b[:lead], b[lead:-1])]
    return float(np.max(corners, axis=0).sum() + a[-1] * b[-1])


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors whose cosine reaches the threshold; with ``same`` only i < j."""
    px, py = x @ axes, y @ axes
    steps = [s for s in STEPS if s < axes.shape[1]] or [axes.shape[1]]

    def rest(p: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt((p[:, k:] ** 2).sum(axis=1))

    lead = steps[0]
    left = np.column_stack([px[:, :lead], rest(px, lead)]).astype(np.float32)
    right = np.column_stack([py[:, :lead], rest(py, lead)]).astype(np.float32).T.copy()
    for low in range(0, len(x), block):
        i, j = np.nonzero(left[low : low + block] @ right >= np.float32(threshold - SLACK))
        i += low
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 17):
            a, b = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
            have = np.einsum("ij,ij->i", px[a, :lead], py[b, :lead])
            for k, to in zip(steps, [*steps[1:], None], strict=True):
                if to is None:
                    break
                have = have + np.einsum("ij,ij->i", px[a, k:to], py[b, k:to])
                open_ = have + rest(px, to)[a] * rest(py, to)[b] >= threshold - 1e-9
                a, b, have = a[open_], b[open_], have[open_]
            exact = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            yield a[exact], b[exact]


def local_roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id that each position reaches over the links (a, b)."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _written(path: str, axes: dict[int, np.ndarray]):
    """Writes one tile (node, copies and unit vectors) below ``path``; returns its name and box."""

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        width = key[0].as_py()
        u = units(matrix(rows.column("vector"), width))
        name = f"{path}/{width}-{key[1].as_py()}-{TaskContext.get().taskAttemptId()}.arrow"
        system, place = _place(name)
        table = pa.table({"node": rows.column("node"), "copies": rows.column("copies"), "unit": pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), width)})
        with system.open_output_stream(place) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        edge = box(u @ axes[width] if width in axes else u)
        return pa.table([[width], [key[1].as_py()], [name], [edge.tolist()]], schema=schema)

    schema = pa.schema([("width", pa.int64()), ("tile", pa.int64()), ("path", pa.string()), ("box", pa.list_(pa.float64()))])
    return write


def _read(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    system, place = _place(path)
    with system.open_input_file(place) as source:
        table = pa.ipc.open_file(source).read_all().combine_chunks()
    unit = table.column("unit").combine_chunks()
    return table.column("node").to_numpy(), table.column("copies").to_numpy(), unit.flatten().to_numpy().reshape(len(table), -1)


def _compared(axes: dict[int, np.ndarray], threshold: float):
    """(node, links, root) of the pairs of tiles (width, a, b: struct of tile, path and box)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, path = None, None
        for batch in batches:
            for width, a, b in zip(*(batch.column(c).to_pylist() for c in ("width", "a", "b")), strict=True):
                if reach(np.array(a["box"]), np.array(b["box"])) < threshold - 1e-9:
                    continue
                if a["path"] != path:
                    held, path = _read(a["path"]), a["path"]
                same = a["path"] == b["path"]
                yield _pair_links(held, held if same else _read(b["path"]), axes.get(width, np.eye(width)), threshold, same)

    return run


def _pair_links(left: tuple, right: tuple, axes: np.ndarray, threshold: float, same: bool) -> pa.RecordBatch:
    shift = 0 if same else len(left[0])
    ids, copies = (left[0], left[1]) if same else (np.concatenate([left[k], right[k]]) for k in (0, 1))
    count = np.zeros(len(ids), np.int64)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, j in linked(left[2], right[2], axes, threshold, same):
        b = j + shift
        np.add.at(count, a, copies[b])
        np.add.at(count, b, copies[a])
        found_a.append(a)
        found_b.append(b)
    root = local_roots(ids, np.concatenate(found_a), np.concatenate(found_b))
    hit = count > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(count[hit]), pa.array(root[hit])], ["node", "links", "root"])


def tile_links(classes: DataFrame, threshold: float, tile: int, stages: Stages) -> DataFrame:
    """(node, links, root) of ``classes`` (node, copies, width, vector), a row for each pair of tiles in which the node has links."""
    sizes = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a single tile needs no axes
    axes = principal(classes, [w for w, n in sizes.items() if n > tile])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, key = batch.column("width").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for w in set(np.unique(width).tolist()) & set(axes):
                own = width == w
                key[own] = order_key(units(matrix(batch.column("vector").filter(pa.array(own)), w)) @ axes[w])
            yield batch.append_column("near", pa.array(key))

    columns = "node long, copies long, width long, vector " + classes.schema["vector"].dataType.simpleString()
    keyed = stages.put(classes.select("node", "copies", F.col("width").cast("long").alias("width"), "vector").mapInArrow(place, f"{columns}, near long"))
    ordered = ranks.positions(keyed, "width", [F.col("near").asc()], stages)
    path = fresh_path(classes.sparkSession, "tiles")
    system, folder = _place(path)
    system.create_dir(folder, recursive=True)
    tiles = ordered.withColumn("tile", F.expr(f"pos div {tile}")).select("node", "copies", "width", "vector", "tile")
    files = stages.put(tiles.groupBy("width", "tile").applyInArrow(_written(path, axes), "width long, tile long, path string, box array<double>"))
    # a row per pair of tiles: each tile with those from itself on
    last = F.floor((F.element_at(F.create_map(*[F.lit(x) for w, n in sizes.items() for x in (int(w), n)]), F.col("width")) - 1) / tile).cast("long") if sizes else F.lit(0).cast("long")
    first = files.select("width", F.struct("tile", "path", "box").alias("a"), F.explode(F.sequence("tile", last)).alias("tile"))
    pairs = first.join(files.select("width", "tile", F.struct("tile", "path", "box").alias("b")), ["width", "tile"])
    n_pairs = sum(t * (t + 1) // 2 for t in (-(-n // tile) for n in sizes.values()))
    spread = stages.put(pairs.select("width", "a", "b")).repartitionByRange(max(1, min(TASKS, n_pairs)), "width", "a.tile", "b.tile")
    return stages.put(spread.mapInArrow(_compared(axes, threshold), "node long, links long, root long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different length do not
    either. Equal vectors link with each other. A row without an id counts in no component and for nobody's links
    (component_id null, kept false). Rows with the same id are vectors of their own, each with its own links, and not linked by
    the id. A component is named by its smallest id. Other columns are not read; an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    stages = Stages(vectors.sparkSession, "embedding")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    distinct = rows.where("vector IS NOT NULL AND vec_id IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # numbered when written, so that the numbers stay
    classes = stages.put(distinct.withColumn("width", F.size("vector")).withColumn("node", F.monotonically_increasing_id()))
    found = tile_links(classes, threshold, tile, stages)
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.select("vector", "low", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # written before the join with the members, of which one component may have most
    lowest = stages.put(named.groupBy("component").agg(F.min("low").alias("least")))
    named = named.join(lowest, "component").select("vector", "links", "least")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("least", "vec_id"))
    return rows.join(named, "vector", "left").select(
        "vec_id",
        F.when(known, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
