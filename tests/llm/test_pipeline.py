import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from data import components, documents, lines_left, near_links, prose, repeats_removed, shingles, texts, words

import corpus_pipeline
from redwatch.llm import language_id, line_dedup, packing
from redwatch.llm.shared import CLEANUP, Stages

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def chain(spark):
    """Rows before the first stage and after each one, on documents with awkward rows and clashing columns."""
    rows = texts() + [(100 + i, prose(70, 50 + i)) for i in range(6)] + [(110, prose(70, 50).replace(" ", "  "))]
    docs = documents(spark, rows)
    tables, out = Stages(spark, "chain"), [(docs.columns, docs.select("doc_id", "text", "source", "n_chars").collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = tables.put(stage(spark, docs, ""))
        out.append((docs.columns, docs.collect() if name == NAMES[-1] else docs.select("doc_id", "text", "source", "n_chars").collect()))
    return out


def key(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in rows)


def test_stages_are_the_dealt_ones():
    assert NAMES == ["language_id", "line_dedup", "minhash_dedup", "substring_dedup", "best_fit_packing"]


def test_columns_stay(chain):
    assert all(columns == chain[0][0] for columns, _ in chain[:-1])
    assert all(r.source == "src" for _, rows in chain[:-1] for r in rows)
    assert all(r.n_chars == len(r.text) for _, rows in chain[1:-1] for r in rows)


def test_language_stage(spark, chain):
    before, after = chain[0][1], chain[1][1]
    lost = {r.doc_id for r in before} - {r.doc_id for r in after}
    without = {r.doc_id for r in before if r.text is None or not any(c.isalpha() for c in r.text)}
    assert without <= lost and len(lost) <= len(without) + 3


UNKNOWN = [
    "La mattina presto il vecchio pescatore scese verso la spiaggia con le reti sulle spalle",
    "Wczesnym rankiem stary rybak zszedł na plażę z sieciami na ramionach",
    "Рано утром старый рыбак спустился к берегу с сетями на плечах",
    "asdf jkl qwer uiop zxcv bnm asdf hjkl wert yuio xcvb nmas dfgh jklq wert",
    "xkq zvw qqj wkx jzq vxk qzj kwv xqj zkv wqx jvk zqw xvj kqz wxv qjk",
]


def test_language_stage_drops_unknown_languages_and_noise(spark):
    """Texts in an unlearned language or in none go, at 60 to 90 characters and longer, with no label or a wrong one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = docs.where("length(text) >= 40")
    strange = [t for u in UNKNOWN for t in (u, "\n".join([u] * 30))]
    rows = [(-1 - i, t, (None, "en")[i % 2], "src", len(t)) for i, t in enumerate(strange)]
    mixed = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = corpus_pipeline.identify_language(spark, mixed, "").select("doc_id").collect()
    assert [strange[-1 - r.doc_id] for r in kept if r.doc_id < 0] == []
    ids = {r.doc_id for r in kept}
    want = [r.doc_id for r in clean.select("doc_id").collect()]
    assert len(want) > 900 and sum(i in ids for i in want) > 0.99 * len(want)


def test_line_stage(chain):
    before, after = chain[1][1], chain[2][1]
    left = lines_left([(r.doc_id, r.text) for r in before], line_dedup.MIN_CHARS)
    want = []
    for r in before:
        _, deleted, text = left[(r.doc_id, r.text)] if r.doc_id is not None else (0, 0, r.text)
        if not deleted or text:
            want.append(((r.doc_id is None, r.doc_id or 0), text))
    assert key(after) == sorted(want)


def test_minhash_stage(chain):
    """Of each group of near rows one stays, that of smallest id; rows without an id are compared as well."""
    before, after = chain[2][1], chain[3][1]
    sets = {k: shingles(r.text, 5) for k, r in enumerate(before)}
    root = components(sets, near_links(sets, 80))
    groups = {}
    for k, r in root.items():
        groups.setdefault(r, []).append(before[k])
    assert key(after)[: len(groups)] and sorted(i for i, _ in key(after)) == sorted(min((r.doc_id is None, r.doc_id or 0) for r in g) for g in groups.values())
    texts = {t for _, t in key(before)}
    assert all(t in texts for _, t in key(after))


def test_minhash_stage_drops_rows_read_twice(spark):
    text, other = prose(80, 60), prose(80, 61)
    rows = [(1, text), (1, text), (2, text + " more"), (None, text), (None, other), (None, other), (3, other + " x"), (4, None), (4, None), (5, prose(80, 62))]
    got = corpus_pipeline.dedup_near(spark, documents(spark, rows).repartition(3), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, text), (3, other + " x"), (4, None), (4, None), (5, prose(80, 62))], key=str)


def test_substring_stage(chain):
    before, after = chain[3][1], chain[4][1]
    want = []
    for r, (n, gone, left) in zip(before, repeats_removed([(r.doc_id, r.text) for r in before], 13), strict=True):
        if not gone or left:
            want.append(((r.doc_id is None, r.doc_id or 0), left if gone else r.text))
    assert key(after) == sorted(want)


def test_packing_stage(chain):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    before, after = chain[4][1], chain[5][1]
    want = []
    for r in before:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        want += [(r.doc_id or -1, k, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in after) == sorted(want)


def test_clean_documents_pass_untouched(chain):
    """Documents that share nothing with others come out as they went in."""
    start = {r.doc_id: r.text for r in chain[0][1]}
    end = {r.doc_id: r.text for r in chain[4][1]}
    assert all(end.get(100 + i) == start[100 + i] for i in range(1, 6)) and words(end[100]) == words(start[100])


def test_empty_and_unlabelled_tables(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else None


def test_run_equals_the_chained_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = Stages(spark, "again")
    for _, stage in corpus_pipeline.STAGES:
        docs = tables.put(stage(spark, docs, folder))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.select(*columns).collect())) and len(got) > 100
    assert language_id.UNDETERMINED == "und"


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for d in folders for f in Path(str(d)).rglob("shuffle_*")}


def test_written_stage_tables_leave_no_shuffle_files(spark):
    """The files of a write's shuffles go as it ends, also those of a table still in use; the setting is as before."""
    rows = spark.range(5000).selectExpr("xxhash64(id) AS k", "id")
    held = rows.groupBy("k").max("id")
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    out = Stages(spark, "shuffled").put(held)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP, None) == setting
    assert out.count() == 5000 and held.count() == 5000


def test_run_keeps_the_last_written_stage_only(spark, tmp_path, monkeypatch):
    """A stage's result goes once the next one is written; the given documents stay."""
    documents(spark, [(1, "a b"), (2, "c d"), (3, "e f")]).write.parquet(str(tmp_path / "documents.parquet"))
    steps = [("one", lambda s, d, f: d.where("doc_id <> 2")), ("two", lambda s, d, f: d.where("doc_id <> 3")), ("last", lambda s, d, f: d)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", steps)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.rglob("pipeline-*"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(shared.rglob("pipeline-*")) - before) == 1
    assert [r.doc_id for r in got.collect()] == [1]
    assert spark.read.parquet(str(tmp_path / "documents.parquet")).count() == 3
