import hashlib
import re
import zlib

import numpy as np
import pytest
from data import documents, components, lines_left, near_links, prose, repeated_window_words, repeats_removed, shingles, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redwatch.llm import embedding_dedup, language_id, line_dedup, minhash_dedup, packing, quality_rules, sentencepiece_codec, sharding, substring_dedup, url_filters
from redwatch.llm import shared

ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(5).persist()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_empty_tables(spark, none):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string")
    results = [
        line_dedup.dedup_lines(none), sharding.shard(none), embedding_dedup.near_duplicates(vectors), language_id.identify(none), packing.pack_documents(none),
        substring_dedup.remove_repeats(none), quality_rules.judge(none), minhash_dedup.near_duplicates(none), url_filters.judge(pages), sentencepiece_codec.encode(none),
    ]
    assert [r.count() for r in results] == [0] * len(results)


# --------------------------------------------------------------------------- 1 lines


def test_line_dedup(docs):
    want = lines_left(ROWS, line_dedup.MIN_CHARS)
    got = line_dedup.dedup_lines(docs).select("row.doc_id", "row.text", F.col("text").alias("left"), "n_lines", "n_deleted").collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.text is None:
            assert (r.left, r.n_lines, r.n_deleted) == (None, 0, 0)
        elif r.doc_id is None:
            assert (r.left, r.n_deleted) == (r.text, 0)
        else:
            assert (r.n_lines, r.n_deleted, r.left) == want[(r.doc_id, r.text)]


def test_line_runs_shorter_than_the_limit_count_together(spark):
    run = "aaaaaaa\nbbbbbbb\nccccccc\nddddddd"
    rows = [(1, run), (2, "start\n" + run + "\nend"), (3, "aaaaaaa\nddddddd\n" + run)]
    got = line_dedup.dedup_lines(documents(spark, rows)).select("row.doc_id", "text").collect()
    assert dict(map(tuple, got)) == {1: run, 2: "start\nend", 3: "aaaaaaa\nddddddd"}


# --------------------------------------------------------------------------- 2 shards


@given(st.lists(st.integers(1, 60), min_size=1, max_size=9), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_smallest_capacity(sizes, shards):
    def best(rest, left):
        if left == 1:
            return sum(rest)
        return min(max(sum(rest[:i]), best(rest[i:], left - 1)) for i in range(len(rest) + 1))

    assert sharding.smallest_capacity(sizes, shards) == best(sizes, shards)
    placed = sharding.cuts(sizes, shards)
    assert placed == sorted(placed) and max(placed) < shards


def test_sharding(docs):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(ROWS)
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    where = {}
    for r in got:
        assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    groups = {}
    for r in got:
        groups[r.group] = groups.get(r.group, 0) + r.size
    load = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert max(load.values()) == sharding.smallest_capacity([groups[g] for g in sorted(groups)], 4)


# --------------------------------------------------------------------------- 3 vectors


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 48))
    near = base[:20] + 0.2 * rng.normal(size=(20, 48)) * np.linalg.norm(base[:20], axis=1)[:, None] / 7
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.vstack([base, near, near[:5] * 3]).astype(np.float32))]
    rows += [(200, None), (201, []), (202, [0.0] * 48), (203, [float("nan")] * 48), (204, [float("inf")] + [1.0] * 47), (205, [None] + [1.0] * 47)]
    # many lengths, and ids with several vectors
    rows += [(300 + w, [1.0] * w) for w in range(1, 24)] + [(400 + w, [1.0] * w) for w in range(3, 24)]
    rows += [(500, rows[3][1]), (500, rows[9][1]), (501, [5 * x for x in rows[9][1]]), (502, rows[3][1][:47] + [9.0])]
    rows += [(206, [1.0, 2.0]), (207, [1.0, 2.1]), (208, rows[0][1]), (208, rows[0][1]), (None, rows[0][1]), (209, [1e30] * 48), (210, [1e-30] * 48)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("vector", F.lit("x"))
    got = embedding_dedup.near_duplicates(df, 0.9, tile=16).collect()
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [v / np.abs(v).max() for _, v in fine]
    unit = [v / np.linalg.norm(v) for v in unit]
    count, links = [0] * len(fine), []
    for a in range(len(fine)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                count[a] += 1
                count[b] += 1
                links.append((a, b))
    root = components(range(len(fine)), links)
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, 10**9), fine[k][0])
    want = [(i, count[k], least[root[k]]) for k, (i, _) in enumerate(fine)]
    want += [(i, 0, i) for i, v in rows if i is not None and not (v and None not in v and np.isfinite(v).all() and any(v))]
    assert len(got) == len(rows) and len(links) > 20
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_boxes_bound_every_cosine():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (embedding_dedup.units(rng.normal(size=(7, 30)) * rng.exponential(size=30) + 2 * rng.normal(size=30)) for _ in range(2))
        assert embedding_dedup.reach(embedding_dedup.box(a), embedding_dedup.box(b)) >= (a @ b.T).max() - 1e-12
    near, far = (embedding_dedup.units(c + 0.01 * rng.normal(size=(5, 30))) for c in (np.eye(30)[0], np.eye(30)[1]))
    assert embedding_dedup.reach(embedding_dedup.box(near), embedding_dedup.box(far)) < 0.9


# --------------------------------------------------------------------------- 4 languages


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.truth for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(docs):
    got = language_id.identify(docs).collect()
    assert len(got) == len(ROWS)
    without = {i for i, t in ROWS if t is None or not any(c.isalpha() for c in t)}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (r.doc_id in without)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_pieces_do_not_matter(monkeypatch):
    import pyarrow as pa

    column = pa.array(["Übergänge über alles " * 50, None, "", "ça va 中文"])
    whole = [np.concatenate(x) for x in zip(*[g[:2] for g in language_id.grams(column, 0, 4)], strict=True)]
    monkeypatch.setattr(language_id, "SLICE", 7)
    parts = [np.concatenate(x) for x in zip(*[g[:2] for g in language_id.grams(column, 0, 4)], strict=True)]
    assert sorted(zip(*map(np.ndarray.tolist, whole), strict=True)) == sorted(zip(*map(np.ndarray.tolist, parts), strict=True))


# --------------------------------------------------------------------------- 5 packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_packing(docs, tokenizer):
    got = packing.pack_documents(docs, 256, with_ids=True).collect()
    want = []
    for i, t in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            own = ids[at : at + 256]
            want.append((i or -1, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    filled = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 256 and len(filled) <= -(-sum(r.length for r in got) // 256) + 1


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8))
@settings(max_examples=100, deadline=None)
def test_fullest_and_bins(histogram):
    bins = packing.plan_bins(histogram, 30)
    used = {}
    for b in bins:
        assert sum(x * n for x, n in b.content.items()) <= 30
        for x, n in b.content.items():
            used[x] = used.get(x, 0) + n * b.times
    assert used == histogram
    if histogram:
        # the first bin is as full as any combination with the longest piece
        longest, sums = max(histogram), {max(histogram)}
        for x, n in histogram.items():
            for _ in range(n - (x == longest)):
                sums |= {s + x for s in sums if s + x <= 30}
        assert sum(x * n for x, n in bins[0].content.items()) == max(sums)


@given(st.text(alphabet=st.sampled_from("aAbBéÉßſİıμ '’sdmlv0²½\t\n\x85\xa0\x1c.,!<|endoftext>中"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_bpe_equals_the_library(text):
    bpe = packing.WordBpe.load(packing.tokenizer_path())
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == bpe.whole.encode(text, add_special_tokens=False).ids


def test_word_bpe_equals_the_library_on_every_latin_character():
    bpe = packing.WordBpe.load(packing.tokenizer_path())
    texts = [t for c in map(chr, range(0x250)) for t in (c, c + "li", "al" + c, "a" + c + "b", c + c, f"Bu {c}n s{c} 1{c}2")]
    want = bpe.whole.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want, strict=True) if np.frombuffer(bpe.encode(t), "<u4").tolist() != w.ids] == []


# --------------------------------------------------------------------------- 6 substrings


def test_substring_dedup(docs):
    rows = [(i, t) for i, t in ROWS]
    want = sorted((i or -1, n, gone, hashlib.sha256(left.encode()).hexdigest()) for (i, _), (n, gone, left) in zip(rows, repeats_removed(rows, 13), strict=True))
    got = substring_dedup.remove_repeats(docs, 13, with_text=True).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 60_000 // 2
    for r in got:
        if r.text is not None:
            assert hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() == r.kept_sha256
        assert "source" in r.rest.asDict() and "copy" in r.rest.asDict()


def test_substring_other_window(spark):
    rows = [(1, "a b c d e f g h"), (2, "x b c d e f y"), (3, "b c d e"), (3, "other words b c d e")]
    got = substring_dedup.remove_repeats(documents(spark, rows), 4, with_text=True).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c d e f g h"), (2, "x y"), (3, ""), (3, "other words")]


# --------------------------------------------------------------------------- 7 quality


def test_quality_counts(docs):
    got = quality_rules.judge(docs).collect()
    want = []
    for i, t in ROWS:
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        repeats = repeated_window_words(t, 5)
        bad = len(w) < 10 or 100 * repeats > 20 * len(w)
        want.append((i or -1, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats, bad))
    assert sorted((r.doc_id or -1, *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.judge(docs).join(docs.select("doc_id", "text"), "doc_id").where("not base_failed and n_words >= 60").collect()
    loud = [r for r in got if sum(c.isupper() for c in r.text) > 0.2 * len(r.text) or r.n_symbols > 0.15 * len(r.text)]
    calm = [r for r in got if sum(c.isupper() for c in r.text) < 0.1 * len(r.text) and r.n_symbols < 0.002 * len(r.text)]
    assert len(loud) > 20 and not any(r.kept for r in loud)
    assert len(calm) > 500 and sum(r.kept for r in calm) > 0.995 * len(calm)


def test_quality_verdict_without_common_words(spark):
    """Lower-case word salad of any judged length without common words goes, and only that of these languages; clean texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    common = {w for own in quality_rules.COMMON_WORDS.values() for w in own}
    parts = [t for t in (r.text for r in docs.where("lang = 'en' AND text IS NOT NULL").orderBy("doc_id").limit(400).collect())]
    pool = [w for t in parts for w in re.findall(r"[a-z]{3,}", t) if w not in common]
    salad = [(-1 - k, " ".join(pool[37 * k : 37 * k + n]), lang) for k, (n, lang) in enumerate((n, lang) for n in (60, 100, 200, 500, 2000) for lang in ("en", None, "it"))]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(salad, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in quality_rules.judge(rows).where("not base_failed and n_words >= 20").collect()}
    assert all(got[i].kept == (lang == "it") for i, _, lang in salad)
    texts = {r.doc_id: r.text for r in docs.collect()}
    calm = [r for i, r in got.items() if i >= 0 and sum(c.isupper() for c in texts[i]) < 0.1 * len(texts[i]) and r.n_symbols < 0.002 * len(texts[i])]
    assert len(calm) > 500 and sum(r.kept for r in calm) > 0.99 * len(calm)


def test_distance(spark):
    p, q = np.array([1, 0, 3, 4]), np.array([0.5, 0.25, 0.25, 0.0])
    row = spark.range(1).select(quality_rules.distance(F.array(*[F.lit(int(x)).cast("long") for x in p]), F.array(*[F.lit(float(x)) for x in q])).alias("d")).first()
    a = p / p.sum()
    m = (a + q) / 2
    want = sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x) / 2 + sum(x * np.log2(x / y) for x, y in zip(q, m, strict=True) if x) / 2
    assert abs(row.d - np.sqrt(want)) < 1e-9


# --------------------------------------------------------------------------- 8 MinHash


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in ROWS if i is not None}
    root = components(sets, near_links(sets, percent))
    got = minhash_dedup.near_duplicates(docs, k, percent).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, False)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_minhash_of_ids_with_several_texts(spark, monkeypatch):
    """Each text of an id keeps its own links, alone and in a crowd of edited copies."""
    a, b = prose(100, 41).split(), prose(100, 42).split()
    edit = lambda w, *at: " ".join("edit" if i in at else x for i, x in enumerate(w))
    rows = [(5, edit(a)), (5, edit(b)), (7, edit(a, 3)), (9, edit(b, 50)), (9, edit(a, 90)), (11, "alone"), (11, edit(b, 51))]
    rng = np.random.default_rng(8)
    base = prose(150, 43).split()
    rows += [(20 + i // 2, edit(base, *rng.choice(150, rng.integers(0, 8), replace=False))) for i in range(80)]
    monkeypatch.setattr(minhash_dedup, "BLOCK", 700)
    sets = {k: shingles(t, 3) for k, (_, t) in enumerate(rows)}
    root = components(sets, near_links(sets, 85))
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, 10**9), rows[k][0])
    got = minhash_dedup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets[k]), least[root[k]]) for k, (i, _) in enumerate(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_crowds(spark, monkeypatch):
    """Many edited copies of one text: links that the smallest copy does not have are found too."""
    rng = np.random.default_rng(3)
    base = prose(150, 9).split()
    rows = []
    for i in range(160):
        own = list(base)
        for at in rng.choice(len(own), rng.integers(0, 9), replace=False):
            own[at] = f"edit{rng.integers(0, 40)}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t, 3) for i, t in rows}
    links = near_links(sets, 85)
    root = components(sets, links)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 700)
    got = minhash_dedup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert any(a != 0 and b != 0 and (0, b) not in set(links) for a, b in links)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 620)] + [(700, i) for i in range(701, 760)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == components(nodes, links)


# --------------------------------------------------------------------------- 9 URLs


URLS = [
    None, "", "no scheme", "http://", "http://example.net/en/1", "http://www.EXAMPLE.net/en/1?x=/de/", "https://example.net/de/1", "http://a.com/de/", "http://example.com/de/x#y",
    "http://b.example.com/de/x", "http://notexample.com/de/x", "http://x.org/fr/1", "http://xorg/fr/1", "http://x.net", "http://x.net?/", "ftp://a.net/x://y", "http://casino-win.example.com/en/1",
    "http://thering.example.org/en/2", "http://Ä.net/ü", "http://example.net/en", "http://x.net/\n/z",
]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("score", F.lit(1))
    got = {r.page_id: r for r in url_filters.judge(df).collect()}
    weights, intercept = url_filters.train()
    for i, u in enumerate(URLS):
        host, path = "", ""
        if u is not None and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S).groups()
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = []
        for what, rule in url_filters.RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, what))
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.score >= 0.5 else "allow")
    assert got[URLS.index("http://casino-win.example.com/en/1")].verdict == "block" and got[URLS.index("http://thering.example.org/en/2")].verdict == "allow"


# --------------------------------------------------------------------------- 10 pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())


@pytest.mark.parametrize("chunk", [64, 65_536])
def test_pieces(docs, library, chunk):
    rows = [(i, t) for i, t in ROWS if chunk > 64 or len(t or "") < 5000]
    source = docs.where(F.coalesce(F.length("text"), F.lit(0)) < (5000 if chunk == 64 else 10**9))
    encoded = sentencepiece_codec.encode(source, chunk=chunk).persist()
    parts = {}
    for r in sorted(encoded.collect(), key=lambda r: (r.doc_id or -1, r.chunk)):
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        if r.doc_id is not None and r.doc_id != 20:
            assert r.start == len(parts.setdefault(r.doc_id, []))
            parts[r.doc_id] += r.ids
    want = {i: library.encode(t or "") for i, t in rows if i is not None and i != 20}
    assert parts == want
    back = {}
    for r in sorted(sentencepiece_codec.decode(encoded).collect(), key=lambda r: (r.doc_id or -1, r.chunk)):
        if r.doc_id is not None and r.doc_id != 20:
            back[r.doc_id] = back.get(r.doc_id, "") + r.text
    assert back == {i: t or "" for i, t in rows if i is not None and i != 20}


@given(st.text(alphabet=st.sampled_from("abcdehinorst  \n▁é中;)}\r0"), min_size=1, max_size=120), st.integers(16, 40))
@settings(max_examples=150, deadline=None)
def test_transfer_matrices(text, chunk):
    import sentencepiece

    model = sentencepiece_codec.PieceModel.load(sentencepiece_codec.model_path())
    x = sentencepiece_codec.normalized(text)
    frames = [(x[max(0, c - 16) : c], x[c : c + chunk], x[c + chunk : c + chunk + 16]) for c in range(0, len(x), chunk)]
    best, back = {0: 0}, []
    for f in frames:
        step = {}
        for a, b, w in model.transfer(*f):
            if a in best and (b not in step or best[a] + w > step[b][0]):
                step[b] = (best[a] + w, a)
        back.append(step)
        best = {b: w for b, (w, _) in step.items()}
    states = [0]
    for step in reversed(back):
        states.append(step[states[-1]][1])
    states.reverse()
    ids = b"".join(model.backtrace(*f, states[k], states[k + 1]) for k, f in enumerate(frames))
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text) and -best[0] == len(ids) // 4
