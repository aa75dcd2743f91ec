import zlib

import numpy as np
import pyarrow as pa
import pytest
from data import documents, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redwatch.llm import packing, simple8b, token_files
from redwatch.llm.word_bpe import WordBpe

NUMBERS = st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.just(0), st.integers(0, 2**64 - 1), st.integers(2**60 - 2, 2**60 + 2))


def plain_words(ids):
    """Selectors and numbers per word, chosen one word after the other."""
    out, at = [], 0
    while at < len(ids):
        for s, (count, bits) in enumerate(zip(simple8b.COUNTS.tolist(), simple8b.BITS.tolist(), strict=True)):
            own = ids[at : at + count]
            if s == simple8b.ESCAPE or all(x < 1 << bits for x in own):
                out.append((s, own[:1] if s == simple8b.ESCAPE else own))
                at += 1 if s == simple8b.ESCAPE else count
                break
    return out


@given(st.lists(st.lists(NUMBERS, min_size=1, max_size=300), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_blocks_of_numbers(blocks):
    coded = [simple8b.encode(np.array(b, np.uint64)) for b in blocks]
    for (words, escapes), block in zip(coded, blocks, strict=True):
        want = plain_words(block)
        assert (words >> np.uint64(60)).tolist() == [s for s, _ in want]
        assert escapes.tolist() == [x for s, own in want if s == simple8b.ESCAPE for x in own]
    lengths = [np.array([len(x[i]) for x in coded]) for i in (0, 1)]
    back = simple8b.decode(np.concatenate([w for w, _ in coded]), lengths[0], np.array(list(map(len, blocks))), np.concatenate([e for _, e in coded]), lengths[1])
    assert back.tolist() == [x for b in blocks for x in b]


@given(st.lists(st.integers(0, 49_407), max_size=400))
@settings(max_examples=50, deadline=None)
def test_no_block_takes_more_words_than_numbers(ids):
    words, escapes = simple8b.encode(np.array(ids, np.uint64))
    assert len(words) <= len(ids) and not len(escapes)


def test_one_file(tmp_path):
    docs = [(3, [1, 2, 3]), (None, [7]), (4, list(range(1000))), (4, []), (9, [2**31])]
    file = token_files.TokenFile(str(tmp_path / "a.s8b"), block=64)
    for i, ids in docs:
        file.add(i, np.array(ids, np.uint32))
    path, *counts = file.close()
    assert counts == [5, 1005, 16, (tmp_path / "a.s8b").stat().st_size]
    reader = token_files.TokenReader(path)
    whole = [x for _, ids in docs for x in ids]
    assert reader.ids(0, 16).tolist() == whole and reader.ids(3, 5).tolist() == whole[192:320] and not len(reader.ids(16, 20))
    found = list(token_files.documents_of(reader, True))
    assert [(n, crc, ids.tolist()) for n, crc, ids in found] == [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids) for _, ids in docs]
    (tmp_path / "b.s8b").write_bytes((tmp_path / "a.s8b").read_bytes()[:-3])
    with pytest.raises(ValueError, match="not a whole token file"):
        token_files.TokenReader(str(tmp_path / "b.s8b"))


@pytest.mark.parametrize(("block", "file_ids"), [(128, 1000), (token_files.BLOCK, token_files.FILE_IDS)])
def test_files_hold_the_ids_of_the_library(spark, tmp_path, block, file_ids):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    df = documents(spark).withColumn("seq", F.lit("x")).withColumn("path", F.lit(1)).repartition(5)
    manifest = token_files.write(df, f"file://{tmp_path}/tokens", block=block, file_ids=file_ids)
    files = manifest.collect()
    assert sum(f.n_docs for f in files) == len(texts()) and (file_ids > 1000 or len(files) > 4)
    got = sorted(token_files.read(manifest, with_ids=True).collect(), key=lambda r: r.start)
    at, keys = 0, []
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
        keys.append((r.doc_id is not None, r.doc_id or 0))
    assert keys == sorted(keys) and at == sum(f.n_ids for f in files)
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts()]
    order = lambda x: (x[0] or -1, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=order) == sorted(want, key=order)


def test_files_of_nothing(spark):
    assert token_files.stored_ids(documents(spark, [])).count() == 0


SNIPPETS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'r", "'", "''", "s", "the", "LL", " ", "\n", "\u0085", "\u00a0", "\x1c", "\x00", "7", "²", "½", "é", "Ōĳ", "ʰ", "Ⱥ", "Ⱦ", "İ", "ß", ".", "!?", "<", "<|", "<|endoftext|>", "中文", "😀"]


@given(st.lists(st.lists(st.sampled_from(SNIPPETS), max_size=12).map("".join), max_size=8))
@settings(max_examples=300, deadline=None)
def test_texts_encoded_together_have_the_ids_of_the_library(some):
    bpe = WordBpe.load(packing.tokenizer_path())
    assert [ids.tolist() for ids in bpe.encode_all(some)] == [bpe.whole.encode(t, add_special_tokens=False).ids for t in some]


def test_characters_encoded_together_have_the_ids_of_the_library():
    bpe = WordBpe.load(packing.tokenizer_path())
    some = [a + chr(c) + b for c in range(0x260) for a, b in (("", ""), ("x", "'s"), ("'", "1"))]
    assert [ids.tolist() for ids in bpe.encode_all(some)] == [bpe.whole.encode(t, add_special_tokens=False).ids for t in some]


def test_each_distinct_word_of_a_portion_is_looked_up_once(monkeypatch):
    bpe, asked = WordBpe(packing.tokenizer_path()), []

    class Asked(dict):
        def __missing__(self, word):
            asked.append(word)  # kept nowhere: each further question would come here
            return bpe.words[word]

    monkeypatch.setattr(bpe, "words_all", Asked())
    some = ["One two, two three's 44", "", "three TWO one", "two"] * 50
    got = bpe.encode_all(some)
    assert sorted(asked) == sorted({"one", "two", ",", "three", "'s", "4"})
    assert [ids.tobytes() for ids in got] == [bpe.encode(t) for t in some]


@pytest.mark.parametrize("chars", [1, 5, 10_000])
def test_portions_hold_all_documents_in_order(chars):
    docs = [(1, "abc"), (1, None), (None, "a" * 30), (2, ""), (3, "de"), (4, "fgh")]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["doc_id", "text"])
    found = list(token_files.portions(batch, chars))
    assert [x for ids, own in found for x in zip(ids, own, strict=True)] == [(i, t or "") for i, t in docs]
    assert all(len(own) == 1 or sum(map(len, own)) <= chars for _, own in found) and all(ids for ids, _ in found)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 260)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_stretches_of_numbers_of_one_width(runs):
    ids = np.concatenate([np.full(n, (1 << bits) - 1, np.uint64) for bits, n in runs])
    words, escapes = simple8b.encode(ids)
    assert (words >> np.uint64(60)).tolist() == [s for s, _ in plain_words(ids.tolist())] and not len(escapes)
