import hashlib
import zlib

import duckdb
import pytest
from data import documents, texts

from redwatch.llm import merkle_manifest
from redwatch.llm.merkle_manifest import OpenTree, digest, witness


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes, arity):
    """Levels of a tree, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, pos, arity):
    """(left, right) siblings per level."""
    out = []
    for level in levels[:-1]:
        low = pos // arity * arity
        out.append(("".join(level[low:pos]), "".join(level[pos + 1 : low + arity])))
        pos //= arity
    return out


def folded(node, steps):
    for left, right in steps:
        node = h(left + node + right)
    return node


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_force(rows, arity):
    """{position in rows: (leaf, subroot, root, proof, folded root)} for rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf(rows[i]))):
        trees.setdefault(rows[i][2], []).append(i)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {name: reduced([leaf(rows[i]) for i in trees[name]], arity) for name in names}
    top = reduced([levels[name][-1][0] for name in names], arity)
    out = {}
    for k, name in enumerate(names):
        for pos, i in enumerate(trees[name]):
            steps = path(levels[name], pos, arity) + path(top, k, arity)
            row = list(rows[i])
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                row[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
            out[i] = (leaf(rows[i]), levels[name][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), folded(leaf(row), steps))
    return out


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 150])
def test_open_tree_equals_the_levels_at_once(n):
    values = [digest(str(i)) for i in range(n)]
    tree = OpenTree(8)
    nodes = [tree.append(v) for v in values]
    root, levels = tree.close(), reduced(values, 8)
    assert root == levels[-1][0]
    for i, node in enumerate(nodes):
        assert [(s["left"], s["right"]) for s in witness(node)] == path(levels, i, 8)


def test_blocks_appended_to_a_tree_give_the_same_root():
    """A block of a larger tree closes all its levels, even above a single node."""
    values = [digest(str(i)) for i in range(21)]
    roots = []
    for i in range(0, 21, 4):
        block = OpenTree(2, 2)
        for v in values[i : i + 4]:
            block.append(v)
        roots.append(block.close())
    above = OpenTree(2)
    for r in roots:
        above.append(r)
    assert above.close() == reduced(values, 2)[-1][0]


def test_manifest_of_awkward_documents(spark):
    df = documents(spark).drop("n").repartition(5)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in documents(spark).collect()]
    want = sorted(brute_force(rows, 8).values())
    got = merkle_manifest.audited(df).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got) == want
    assert all(r.verified == (r.folded_root == r.root) for r in got) and len({r.verified for r in got}) == 2


def test_manifest_over_several_blocks_and_rounds(spark):
    """Blocks of four leaves: four rounds of block roots, ties, one name for most rows, names in byte order, lone leaves."""
    names = ["en"] * 70 + ["z", "Z", "é", "", None, None, "en-x"] + ["en"] * 30
    rows = [(i // 2, "s", name, i % 3, f"Text {i // 2}") for i, name in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    found = merkle_manifest.witnessed(
        df.select("doc_id", "lang", merkle_manifest.leaf([df[c] for c in merkle_manifest.FIELDS]).alias("leaf")), "lang", ["doc_id"], arity=2, levels=2
    )
    want = brute_force(rows, 2)
    got = [(r.leaf, r.tree_root, r.root, h("".join(s.left + s.right for s in r.witness))) for r in found.collect()]
    assert sorted(got) == sorted(x[:4] for x in want.values())
    assert all(folded(r.leaf, [(s.left, s.right) for s in r.witness]) == r.root for r in found.collect())


def test_manifest_of_nothing_and_clashing_names(spark):
    assert merkle_manifest.audited(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="clash"):
        merkle_manifest.witnessed(spark.createDataFrame([("a", 1, "x")], "lang string, pos long, leaf string"), "lang", ["pos"])


def test_oracle(spark):
    folder = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, source, CASE WHEN doc_id = 7 THEN 'alone' ELSE nullif(lang, 'de') END AS lang, n_chars, text FROM read_parquet('{folder}')")
    docs = spark.read.parquet(folder).selectExpr("doc_id", "source", "CASE WHEN doc_id = 7 THEN 'alone' ELSE nullif(lang, 'de') END AS lang", "n_chars", "text")
    got = merkle_manifest.audited(docs).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(merkle_manifest.ORACLE).fetchall())
