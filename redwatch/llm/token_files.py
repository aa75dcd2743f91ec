"""Token ids of all documents as binary files, packed with Simple-8b, in ascending order of document ids.

Documents are sorted by range partitions of their id; each task tokenizes its documents and appends the ids to files of its own,
a new one after ``FILE_IDS`` ids, always between two documents. A file is::

    MAGIC | per block: its words, then its escaped numbers (64 bits each) | block table | document table | footer | MAGIC

    block table     4 x 8 bytes a block: where it starts (offset in the file), words, numbers, escapes
    document table  3 x 8 bytes a document: id, 1 if it has an id, number of ids
    footer          4 x 8 bytes: blocks, documents, ids, offset of the block table

All numbers are little-endian. Block offsets let a reader start at any block; many blocks are decoded at a time. Memory is
bounded by one document, or ``CHARS`` of smaller ones, and one group of blocks on both sides. A file counts only if the manifest (a table with one row per
file) names it: a repeated task writes under another name, so what a lost task left behind is never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import fresh_path
from . import simple8b
from .packing import tokenizer_path
from .shared import Stages
from .word_bpe import WordBpe

MAGIC = b"RWTOKS8B"
BLOCK = 1 << 14
#: Ids after which a file ends with its document; about two bytes an id.
FILE_IDS = 1 << 24
#: Blocks decoded at a time.
GROUP = 64
#: Characters of documents that are encoded together.
CHARS = 1 << 22
#: Reading tasks at most; each then reads several files.
READERS = 16_384
FILES = "part int, seq int, path string, n_docs long, n_ids long, n_blocks long, bytes long"


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; a path without a scheme is one that driver and executors share as it is."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --------------------------------------------------------------------------- one file


class TokenFile:
    """A file being written: documents are added one after the other."""

    def __init__(self, path: str, block: int = BLOCK):
        system, place = place_of(path)
        self.path, self.block, self.sink = path, block, system.open_output_stream(place)
        self.sink.write(MAGIC)
        self.at, self.pending, self.n_pending, self.blocks, self.docs, self.n_ids = len(MAGIC), [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids)))
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block:
            self._flush(self.n_pending // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        for low in range(0, n, self.block):
            own = ids[low : min(low + self.block, n)]
            words, escapes = simple8b.encode(own)
            self.blocks.append((self.at, len(words), len(own), len(escapes)))
            self._write(words)
            self._write(escapes)
        self.pending, self.n_pending = [ids[n:]], len(ids) - n

    def _write(self, numbers: np.ndarray) -> None:
        data = numbers.astype("<u8").tobytes()
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> tuple[str, int, int, int, int]:
        """path, documents, ids, blocks, bytes."""
        self._flush(self.n_pending)
        table = self.at
        self._write(np.array(self.blocks, np.uint64).reshape(-1, 4))
        self._write(np.array(self.docs, np.int64).reshape(-1, 3).view(np.uint64))
        self.sink.write(struct.pack("<4Q", len(self.blocks), len(self.docs), self.n_ids, table) + MAGIC)
        self.sink.close()
        return self.path, len(self.docs), self.n_ids, len(self.blocks), self.at + 32 + len(MAGIC)


class TokenReader:
    """A written file: ``docs`` (id, has an id, ids) and ``blocks`` (offset, words, ids, escapes) tables, and the ids by block."""

    def __init__(self, path: str):
        system, place = place_of(path)
        self.source = system.open_input_file(place)
        size = self.source.size()
        tail = self._read(size - 32 - len(MAGIC), 32 + len(MAGIC))
        if tail[32:] != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        n_blocks, n_docs, self.n_ids, table = struct.unpack("<4Q", tail[:32])
        index = np.frombuffer(self._read(table, size - 32 - len(MAGIC) - table), "<u8")
        self.blocks = index[: 4 * n_blocks].reshape(-1, 4).astype(np.int64)
        self.docs = index[4 * n_blocks :].view("<i8").reshape(n_docs, 3)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from ``first`` up to ``last`` (not included)."""
        own = self.blocks[first:last]
        if not len(own):
            return np.zeros(0, np.uint64)
        begin, end = own[0, 0], own[-1, 0] + 8 * (own[-1, 1] + own[-1, 3])
        data = np.frombuffer(self._read(int(begin), int(end - begin)), "<u8")
        # words and escapes of a block follow each other
        word = np.repeat(np.tile([True, False], len(own)), own[:, [1, 3]].ravel())
        return simple8b.decode(data[word], own[:, 1], own[:, 2], data[~word], own[:, 3])

    def groups(self, size: int = GROUP) -> Iterator[np.ndarray]:
        for first in range(0, len(self.blocks), size):
            yield self.ids(first, first + size)

    def close(self) -> None:
        self.source.close()


def documents_of(reader: TokenReader, with_ids: bool) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """(number of ids, their crc32, ids or None) of each document of a file, in order."""
    lengths, k, left, crc, parts = reader.docs[:, 2].tolist(), 0, None, 0, []
    for ids in reader.groups():
        own, at = ids.astype("<u4"), 0
        data = memoryview(own).cast("B")
        while k < len(lengths):
            left = lengths[k] if left is None else left
            take = min(left, len(own) - at)
            crc = zlib.crc32(data[4 * at : 4 * (at + take)], crc)
            if with_ids:
                parts.append(own[at : at + take])
            at, left = at + take, left - take
            if left:
                break
            yield lengths[k], crc, np.concatenate(parts) if with_ids else None
            k, left, crc, parts = k + 1, None, 0, []


# --------------------------------------------------------------------------- all documents


def portions(batch: pa.RecordBatch, chars: int = CHARS) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of neighbouring documents of about ``chars`` characters together, or of one larger document."""
    ids, texts, n = [], [], 0
    for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        text = value.as_py() or ""
        if texts and n + len(text) > chars:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(doc_id)
        texts.append(text)
        n += len(text)
    if texts:
        yield ids, texts


def write(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, block: int = BLOCK, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents below ``path`` and returns the manifest: part, seq, path, n_docs, n_ids, n_blocks, bytes.

    The files in the order of (part, seq) hold the documents in ascending order of id, those without an id first; rows that repeat
    an id, also whole rows, are documents of their own in the order of the table. A null text counts as empty; every document ends
    with ``end_id``. Other columns are not read. An empty table gives no files and no rows. ``path`` is in a file system that
    all executors share and that pyarrow can open.
    """
    file = tokenizer or tokenizer_path()
    end = np.array([end_id], np.uint32)

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = WordBpe.load(file), TaskContext.get()
        part, out, seq = task.partitionId(), None, 0

        def closed() -> pa.RecordBatch:
            name, *counts = out.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), *(pa.array([n], pa.int64()) for n in counts)], ["part", "seq", "path", "n_docs", "n_ids", "n_blocks", "bytes"])

        for doc_ids, texts in chain.from_iterable(map(portions, batches)):
            for doc_id, ids in zip(doc_ids, bpe.encode_all(texts), strict=True):
                if out is None:
                    out = TokenFile(f"{path}/part-{part:06d}-{seq:06d}-{task.taskAttemptId()}.s8b", block)
                out.add(doc_id, np.concatenate([ids, end]))
                if out.n_ids >= file_ids:
                    yield closed()
                    out, seq = None, seq + 1
        if out is not None:
            yield closed()

    system, place = place_of(path)
    system.create_dir(place, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    # the place in the table tells equal ids apart: even one id of a third of all rows is cut into several partitions
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(append, FILES)
    return Stages(docs.sparkSession, "token-manifest").put(files)


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, if wanted): one row per document of the files."""
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    parts = sorted(totals)
    before = dict(zip(parts, accumulate((totals[p] for p in parts), initial=0), strict=False))
    base = F.element_at(F.create_map(*[F.lit(x) for p in parts for x in (p, before[p])]), F.col("part")) if parts else F.lit(0)
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    files = manifest.select("part", "seq", "path", (base + own).cast("long").alias("base"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader = TokenReader(path)
                ids, has = reader.docs[:, 0], reader.docs[:, 1] == 1
                begin, done, rows = np.cumsum(reader.docs[:, 2]) - reader.docs[:, 2] + start, 0, []
                for row in documents_of(reader, with_ids):
                    rows.append(row)
                    if len(rows) == (256 if with_ids else 1 << 14):
                        yield table(ids, has, begin, done, rows)
                        done, rows = done + len(rows), []
                yield table(ids, has, begin, done, rows)
                reader.close()

    def table(ids: np.ndarray, has: np.ndarray, begin: np.ndarray, done: int, rows: list) -> pa.RecordBatch:
        own = slice(done, done + len(rows))
        columns = [pa.array(ids[own], pa.int64(), mask=~has[own]), pa.array(begin[own], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
        more = [pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))] if with_ids else []
        return pa.RecordBatch.from_arrays([*columns, *more], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    # a file a task: rows of the manifest are few and small, Spark would gather them in one
    readers = min(READERS, max(1, manifest.count()))
    spread = files.repartitionByRange(readers, "part", "seq")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def stored_ids(docs: DataFrame, end_id: int = 2) -> DataFrame:
    """Writes the token files of ``docs`` to a new folder below ``spark.checkpoint.dir`` and reads the documents back from them."""
    return read(write(docs, fresh_path(docs.sparkSession, "tokens"), end_id))
