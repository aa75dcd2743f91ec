"""Merkle manifest of a dataset: a root over all rows, and for every row a witness that ties it to the root.

Rows are the leaves of one tree per group (``tree``), the groups' roots the leaves of a tree on top. Every run of ``ARITY``
neighbouring nodes becomes its hash, until one is left. Leaves are appended in order to ``OpenTree``: a node that joins an open run
is kept with what is known of its witness, its left siblings; when the run is complete, the right ones are added, and the parent
is appended one level up. A task appends the leaves of one aligned block of ``BLOCK``; the roots of the blocks are then
appended in the same way, block by block, until each tree has one node. Going back down, every block's witness is
handed to the block's leaves, which are appended once more: only one row per block moves, never the witnesses of all leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .shared import Stages

ARITY = 8
#: Levels that one task closes; a block is a whole subtree, so blocks line up with the runs of the tree.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left:string,right:string>"
_STEP_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


# --------------------------------------------------------------------------- one tree, leaf by leaf


class Node:
    """A complete subtree: its digest and, once its run is complete, its siblings there and its parent."""

    __slots__ = ("digest", "left", "parent", "right")

    def __init__(self, value: str, left: str = ""):
        self.digest, self.left, self.right, self.parent = value, left, "", None


class OpenTree:
    """A tree that grows leaf by leaf. ``height`` is how many levels it will have; None: until one node is left."""

    def __init__(self, arity: int = ARITY, height: int | None = None):
        self.arity, self.height, self.runs = arity, height, []

    def append(self, value: str, level: int = 0) -> Node:
        """Append a node. It starts with its left siblings as a partial witness; those to its right follow with their own append."""
        if level == len(self.runs):
            self.runs.append([])
        run = self.runs[level]
        node = Node(value, "".join([x.digest for x in run]))
        run.append(node)
        if len(run) == self.arity and level != self.height:
            self._complete(level)
        return node

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        right = ""
        for node in reversed(run):
            node.right = right
            right = node.digest + right
        parent = self.append(digest(right), level + 1)
        for node in run:
            node.parent = parent

    def close(self) -> str:
        """Complete the runs still open, from below, and return the root."""
        level = 0
        while True:
            above = any(self.runs[level + 1 :])
            last = level == self.height if self.height is not None else not above and len(self.runs[level]) == 1
            if last:
                return self.runs[level][0].digest
            if self.runs[level]:
                self._complete(level)
            level += 1


def witness(node: Node) -> list[dict[str, str]]:
    """Siblings left and right of a leaf and of its ancestors, from below, up to a node whose run is not complete."""
    out = []
    while node.parent is not None:
        out.append({"left": node.left, "right": node.right})
        node = node.parent
    return out


def _append_all(values: Iterable[str], arity: int, levels: int, alone: bool) -> tuple[str, list[Node]]:
    """Root and leaves of a block; ``alone``: the tree has no other block, so it ends where one node is left."""
    tree = OpenTree(arity, None if alone else levels)
    nodes = [tree.append(v) for v in values]
    return tree.close(), nodes


# --------------------------------------------------------------------------- trees over all rows


def _in_blocks(nodes: DataFrame, wide: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {wide}"))


def _above(nodes: DataFrame, stages: Stages, arity: int, levels: int) -> DataFrame:
    """(tree, pos, witness, root): for every block of ``nodes`` (tree, pos, n, digest) its witness and the root of its tree.

    ``n`` is the number of nodes of the tree. The blocks are closed, their roots taken as nodes and their blocks looked at in turn.
    """
    wide = arity**levels

    def shut(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        root, _ = _append_all(rows.sort_by("pos").column("digest").to_pylist(), arity, levels, n <= wide)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [-(-n // wide)], [root]], schema=schema)

    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    rows = _in_blocks(nodes, wide).select("tree", "block", "pos", "n", "digest")
    roots = stages.put(rows.groupBy("tree", "block").applyInArrow(shut, "tree string, pos long, n long, digest string"))
    if roots.where("n > 1").isEmpty():
        return roots.select("tree", "pos", F.array().cast(f"array<{_STEP}>").alias("witness"), F.col("digest").alias("root"))
    return stages.put(_handed_down(roots, _above(roots, stages, arity, levels), [], ["root"], arity, levels))


def _handed_down(nodes: DataFrame, above: DataFrame, kept: list[str], ends: list[str], arity: int, levels: int) -> DataFrame:
    """``nodes`` (tree, pos and ``kept``) with witness (inside the block, then that of the block in ``above``) and ``above``'s ``ends``."""
    wide = arity**levels
    left = _in_blocks(nodes, wide).select("tree", "pos", *[F.col(f"`{c}`") for c in kept], "n", "digest", "block")
    right = above.select("tree", F.col("pos").alias("block"), "witness", *ends)

    def down(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        _, leaves = _append_all(rows.column("digest").to_pylist(), arity, levels, rows.column("n")[0].as_py() <= wide)
        top = block.column("witness")[0].as_py()
        out = rows.drop_columns(["n", "digest", "block"]).append_column("witness", pa.array([witness(x) + top for x in leaves], _STEP_ARROW))
        for end in ends:
            out = out.append_column(end, pa.array([block.column(end)[0].as_py()] * len(leaves), pa.string()))
        return out

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in left.schema.fields[:-3])
    both = left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block"))
    return both.applyInArrow(down, f"{kinds}witness array<{_STEP}>" + "".join(f", {end} string" for end in ends))


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: per field ``-`` if null, else its UTF-8 length, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def witnessed(leaves: DataFrame, tree: str, by: list[str], value: str = "leaf", arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``leaves`` with tree_root, root and witness (array of the siblings left and right of the leaf and of its ancestors).

    Leaves are grouped by ``tree`` (a string column; null is a tree of its own, the first one) and ordered there by ``by``, nulls
    first; leaves that tie are ordered by their digest, so repeated rows take neighbouring places. The roots of the trees, in the
    order of their names' UTF-8 bytes, are the leaves of the top tree. A tree of one leaf has that leaf as its root. An empty
    table gives no rows. Digests are hex texts. The names ``tree``, ``pos``, ``n``, ``digest``, ``block``, ``witness``, ``root`` and
    ``tree_root`` are needed inside: other columns with these names are refused, callers pass what they need under others.
    """
    taken = {"tree", "pos", "n", "digest", "block", "witness", "root", "tree_root", "top"} & set(leaves.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} clash with those of the result")
    stages = Stages(leaves.sparkSession, "merkle")
    kept = list(leaves.columns)
    # a null name sorts before all others
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`")), F.lit(""))
    rows = stages.put(leaves.withColumn("tree", name).withColumn("digest", F.col(value)))
    nodes = stages.put(ranks.positions(rows, "tree", [F.col(c).asc_nulls_first() for c in (*by, "digest")], stages))
    blocks = _above(nodes, stages, arity, levels)
    subroots = blocks.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    top = stages.put(ranks.positions(stages.put(subroots), "tree", [F.col("name").asc()], stages))
    over = _handed_down(top, _above(top, stages, arity, levels), ["name"], ["root"], arity, levels)
    over = over.select(F.col("name").alias("tree"), F.col("witness").alias("rest"), "root")
    whole = blocks.withColumnRenamed("root", "tree_root").join(over, "tree").withColumn("witness", F.concat("witness", "rest"))
    found = _handed_down(nodes, stages.put(whole), kept, ["tree_root", "root"], arity, levels)
    return found.select(*[F.col(f"`{c}`") for c in kept], "tree_root", "root", "witness")


def folded(value: Column, path: Column) -> Column:
    """Root that a leaf's digest and its witness lead to."""
    return F.aggregate(path, value, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a witness, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, tree_root, root, witness, and the columns of ``carry`` (worked out from the document): one row per document.

    The leaf is the digest of ``fields``; documents are ordered by id in the tree of their ``tree`` value. A document without an id
    is a leaf before those with one; null or empty texts are fields like others; repeated rows are leaves of their own. Columns
    that are not named are not read; an empty table gives no rows.
    """
    columns = {"doc_id": F.col(f"`{id_col}`"), "leaf": leaf([F.col(f"`{f}`") for f in fields]), "__tree": F.col(f"`{tree}`").cast("string")} | (carry or {})
    return witnessed(docs.select(*[c.alias(k) for k, c in columns.items()]), "__tree", ["doc_id"]).drop("__tree")


def tampered_leaf(id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """Leaf of a document whose text has its A-Z lower-cased where 3 divides the crc32 of the decimal id; else its own."""
    upper = "".join(map(chr, range(65, 91)))
    changed = F.translate(F.col(f"`{text_col}`"), upper, upper.lower())
    struck = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return leaf([F.when(struck, changed).otherwise(F.col(f"`{f}`")) if f == text_col else F.col(f"`{f}`") for f in fields])


def audited(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest held against partly tampered documents."""
    rows = manifest(docs, carry={"now": tampered_leaf()})
    found = rows.withColumn("folded_root", folded(F.col("now"), F.col("witness")))
    return found.select(
        "doc_id", "leaf", F.col("tree_root").alias("subroot"), "root", proof_digest(F.col("witness")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: ``audited`` in DuckDB: crc32 over the digits of an id, levels of the trees and folding by recursion.
ORACLE = """
WITH RECURSIVE
table8 AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
struck AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 3 = 0 AS hit
  FROM documents, table8),
fields AS (
  SELECT doc_id, lang, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now, text,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
  FROM documents LEFT JOIN struck USING (doc_id)),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(now)) || ':' || now, '-')) AS now
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (
  SELECT 0 AS level, coalesce('=' || lang, '') AS tree, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY level, tree, pos // 8, n),
subroots AS (SELECT tree, level AS height, digest FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 8, n),
places AS (SELECT tree, height, row_number() OVER (ORDER BY tree) - 1 AS pos FROM subroots),
nodes AS (
  SELECT level, tree, pos, n, digest FROM low WHERE n > 1
  UNION ALL
  SELECT s.height + h.level, s.tree, h.pos, h.n, h.digest FROM places s, high h WHERE h.n > 1 AND h.pos // 8 = (s.pos // CAST(8 ** h.level AS BIGINT)) // 8),
runs AS (
  SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.level = b.level AND a.tree = b.tree AND a.pos // 8 = b.pos // 8 GROUP BY a.level, a.tree, a.pos),
fold AS (
  SELECT doc_id, leaf, coalesce('=' || p.lang, '') AS tree, s.height, 0 AS level, CASE WHEN s.height = 0 THEN s.pos ELSE p.pos END AS pos, s.pos AS top, now AS node, '' AS proof FROM placed p JOIN places s ON s.tree = coalesce('=' || p.lang, '')
  UNION ALL
  SELECT doc_id, leaf, f.tree, f.height, f.level + 1, CASE WHEN f.level + 1 = f.height THEN f.top ELSE f.pos // 8 END, f.top, sha256(l || node || r), proof || l || r
  FROM fold f JOIN runs ON runs.level = f.level AND runs.tree = f.tree AND runs.pos = f.pos),
ends AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1),
whole AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM ends JOIN subroots s USING (tree), whole
"""
