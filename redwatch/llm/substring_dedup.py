"""Substring dedup: words under windows that also start in an earlier document are removed.

Level-wise doubling: the first level looks at windows of half the wanted length, one per window of full length (the one with
the smallest hash among those inside it, which equal windows choose alike). Only where that half repeats across
documents is the window of full length formed and compared; with 13 words the levels are 6 and 13. A longer repeat is a
union of repeated windows, so further levels would remove no other word.

The first level sends about two of nine positions, not every window; hot windows are reduced to their smallest document before
the shuffle. Windows are compared by 96 bits of hash of their words' 64-bit hashes. A
text that an earlier document has as well is marked by its digest and sends no windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stages
from .words import SEPARATOR, buffers, settle, window_starts, windows, words_of

#: Rows of one output batch: a very long text is sent in several.
BATCH = 1 << 16


def anchors(hashes: np.ndarray, half: int, length: int) -> np.ndarray:
    """For every window of ``length`` words the smallest hash of the ``half``-word windows inside it."""
    low = windows(hashes, half)
    width, have = length - half + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _pairs(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + BATCH]) for c in columns], names)


def _first_level(length: int):
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for low, _, hashes, bounds, _, _ in words_of(batch.column("text")):
                at, text = window_starts(bounds, length)
                if not len(at):
                    continue
                found = anchors(hashes, half, length)[at]
                # neighbours mostly choose the same half: drop runs, then repeats within a text
                new = np.ones(len(at), bool)
                new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
                text, found = _distinct(text[new], found[new])
                yield from _pairs(["anchor", "doc_id"], [found.view(np.int64), ids[low + text]])

    return run


def _distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _texts(column: pa.Array) -> pa.Array:
    """Texts from their compressed form, null kept."""
    engine = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else engine.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.large_binary())


def packed(docs: DataFrame) -> DataFrame:
    """The columns with the compressed text, ``packed``, for ``text``: what goes through a shuffle is less than half as large."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                text = batch.column("text").slice(i, 256)
                blobs = [None if t is None else engine.compress(t) for t in text.cast(pa.binary()).to_pylist()]
                own = [batch.column(c).slice(i, 256) for c in others]
                yield pa.RecordBatch.from_arrays([*own, pa.array(blobs, pa.binary())], [*others, "packed"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    return docs.mapInArrow(run, f"{kinds}packed binary")


def _parts(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges whose compressed texts have about ``size`` bytes."""
    _, at = buffers(batch.column("packed"))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield low, min(high, batch.num_rows)
        low = high


def _second_level(length: int):
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _parts(batch):
                part = batch.slice(low, high - low)
                ids, lists = part.column("doc_id").to_numpy(), part.column("anchors")
                for first, rows, hashes, bounds, _, _ in words_of(_texts(part.column("packed"))):
                    at, text = window_starts(bounds, length)
                    if not len(at):
                        continue
                    found = anchors(hashes, half, length)[at]
                    keep = np.zeros(len(at), bool)
                    cut = np.searchsorted(text, np.arange(rows + 1))
                    for r in range(rows):
                        wanted = lists[first + r].values.to_numpy().view(np.uint64)
                        keep[cut[r] : cut[r + 1]] = np.isin(found[cut[r] : cut[r + 1]], wanted)
                    at, text = at[keep], text[keep]
                    one, two = windows(hashes, length, 1)[at], windows(hashes, length, 2)[at]
                    text, one, two = _distinct_windows(text, one, two.astype(np.uint32))
                    yield from _pairs(["h1", "h2", "doc_id"], [one.view(np.int64), two.view(np.int32), ids[first + text]])
            settle()

    return run


def _distinct_windows(text: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, one, two)."""
    order = np.lexsort((two, one, text))
    text, one, two = text[order], one[order], two[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return text[new], one[new], two[new]


def _last_level(length: int, with_text: bool):
    """Removes the covered words: counts, digest and, if wanted, the text that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _parts(batch):
                yield from _removed(batch.slice(low, high - low), length, with_text)
            settle()

    return run


def _removed(part: pa.RecordBatch, length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    texts, lists, copies = _texts(part.column("packed")), part.column("hits"), part.column("copy").to_numpy(zero_copy_only=False)
    data, at = buffers(texts)
    for first, rows, hashes, bounds, starts, ends in words_of(texts):
        gone = np.zeros(len(hashes) + 1, np.int64)
        for r in range(rows):
            b, e = int(bounds[r]), int(bounds[r + 1])
            if e - b < length:
                continue
            if copies[first + r]:
                gone[b] += 1
                gone[e] -= 1
            elif lists[first + r].is_valid:
                own = windows(hashes[b:e], length, 1).view(np.int64)
                hit = b + np.flatnonzero(np.isin(own, lists[first + r].values.to_numpy()))
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + length, -1)
        covered = np.cumsum(gone[:-1]) > 0
        kept = ~covered
        begin, stop = int(at[first]), int(at[first + rows])
        # bytes of kept words, each with the byte after it in its text, which becomes one space
        last = np.repeat(at[first + 1 : first + rows + 1], np.diff(bounds))
        mark = np.zeros(stop - begin + 2, np.int8)
        np.add.at(mark, starts[kept] - begin, 1)
        np.add.at(mark, np.minimum(ends + 1, last)[kept] - begin, -1)
        inside = np.cumsum(mark[: stop - begin]) > 0
        piece = np.where(SEPARATOR[data[begin:stop]], np.uint8(32), data[begin:stop])
        digests, rest = [], []
        for r in range(rows):
            a, z = int(at[first + r]) - begin, int(at[first + r + 1]) - begin
            left = piece[a:z][inside[a:z]].tobytes().removesuffix(b" ")
            digests.append(hashlib.sha256(left).hexdigest())
            rest.append(left)
        sums = np.concatenate([[0], np.cumsum(covered)])
        n_removed = sums[bounds[1:]] - sums[bounds[:-1]]
        own = part.column("doc_id").slice(first, rows)
        columns = [own, pa.array(np.diff(bounds)), pa.array(n_removed), pa.array(digests)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            # untouched texts stay as they are
            whole = texts.slice(first, rows).to_pylist()
            out = [None if w is None else (w if not n else x).decode() for w, x, n in zip(whole, rest, n_removed, strict=True)]
            columns, names = [*columns, pa.array(out, pa.string()), part.column("rest").slice(first, rows)], [*names, "text", "rest"]
        yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per document; with ``with_text`` also the remaining text and, as the struct
    ``rest``, all columns but the text.

    A word goes if a window of ``length`` words over it has the same words as a window of a document with a smaller id. All
    windows are judged on the input. A null text counts as no words (digest of nothing; the text stays null); texts shorter than a
    window keep all words. Rows that repeat an id are one document: they are not compared with each other, and a window of either is
    removed from both. Rows without an id are returned whole and compared with nothing. Other columns are not read; an empty
    table gives no rows.
    """
    if length < 4:
        raise ValueError("a window has at least four words")
    stages = Stages(docs.sparkSession, "substring")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    named = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # a text that an earlier document has as well goes whole and is nobody's source: the earlier one is
    prints = named.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("print"))
    sources = prints.groupBy("print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("print", "low")
    later = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))
    copies = stages.put(prints.join(sources, "print", "left").groupBy("doc_id").agg(F.bool_and(later).alias("copy")).where("copy"))
    halves = named.mapInArrow(_first_level(length), "anchor long, doc_id long")
    often = halves.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    often = stages.put(often, release=True)
    lists = halves.join(often, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    lists = stages.put(lists, release=True)
    stages.drop(often)
    wide = packed(named).join(lists.join(copies, "doc_id", "left_anti"), "doc_id").mapInArrow(_second_level(length), "h1 long, h2 int, doc_id long")
    wide = stages.put(wide, release=True)
    stages.drop(lists)
    least = wide.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h1", "h2", "low")
    hits = wide.join(least, ["h1", "h2"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_set("h1").alias("hits"))
    hits = stages.put(hits, release=True)
    stages.drop(wide)
    marks = hits.join(copies, "doc_id", "full")
    if with_text:
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
        texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), rest.alias("rest"))
    marked = packed(texts).join(marks, "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" 
    if with_text:
        kinds += f", text string, rest {texts.schema['rest'].dataType.simpleString()}"
    return marked.mapInArrow(_last_level(length, with_text), kinds)
