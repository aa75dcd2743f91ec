"""Best-fit packing of token pieces by minimum bin slack.

Documents become tokens and are cut into pieces of at most ``capacity`` tokens. What is packed is the histogram of piece lengths,
at most ``capacity`` counts whatever the input: bin after bin, a subset-sum table over the available lengths (one bitset
per item) finds the fullest feasible combination around the longest piece left, and the combination is repeated as often as
the counts allow, so the number of different bins is at most the number of lengths. The pieces then find their places in
parallel: each is numbered among the pieces of its length and looks its number up in the table of bins.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stages
from .word_bpe import WordBpe

CAPACITY = 4096
#: A length is numbered in so many parts, so that no task numbers a hot length alone.
PARTS = 64


# --------------------------------------------------------------------------- tokens


def tokenizer_path() -> str:
    """File of the public tokenizer; ``WORD_BPE_PATH`` overrides it."""
    given = os.environ.get("WORD_BPE_PATH")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if wanted): every document's ids, ended by ``end_id``, in pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                owner, piece, start, length, crc, tokens = [], [], [], [], [], []
                for i, text in enumerate(part.column("text")):
                    ids = bpe.encode(text.as_py() or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        owner.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            tokens.append(np.frombuffer(own, "<u4").astype(np.int32))
                columns = [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(cut, kind)


# --------------------------------------------------------------------------- bins


def fullest(available: dict[int, int], capacity: int) -> dict[int, int]:
    """Combination of the available lengths (length to count) that fills ``capacity`` best and holds the longest of them.

    Subset sums as bits of one integer per item; a length that may be used several times is split into items of 1, 2, 4 ...
    copies. Longer lengths come first, so among equally full combinations those with long pieces win.
    """
    longest = max(available)
    room = capacity - longest
    items = []
    for length in sorted((x for x in available if x <= room), reverse=True):
        most = min(available[length] - (length == longest), room // length)
        size = 1
        while most > 0:
            take = min(size, most)
            items.append((length, take))
            most -= take
            size *= 2
    mask = (1 << (room + 1)) - 1
    sums, history = 1, []
    for length, take in items:
        history.append(sums)
        sums |= (sums << (length * take)) & mask
        if sums >> room:
            break
    at = sums.bit_length() - 1
    chosen = {longest: 1}
    for (length, take), before in zip(reversed(items[: len(history)]), reversed(history), strict=True):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


@dataclass(frozen=True)
class Bin:
    """``times`` sequences of the same make: which lengths, how often each."""

    content: dict[int, int]
    times: int


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bin]:
    """Bins for all pieces of a histogram (length to count)."""
    left = {x: n for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("a piece has between 1 and capacity tokens")
    out = []
    while left:
        content = fullest(left, capacity)
        times = min(left[x] // n for x, n in content.items())
        out.append(Bin(content, times))
        for x, n in content.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def places(bins: list[Bin]) -> dict[str, np.ndarray]:
    """Per bin and length: first rank (among the pieces of that length), ranks per sequence, first sequence, first offset."""
    rows, used, sequence = [], {}, 0
    for b in bins:
        offset = 0
        for length in sorted(b.content, reverse=True):
            n = b.content[length]
            first = used.get(length, 0)
            rows.append((length, first, n, sequence, offset))
            used[length] = first + n * b.times
            offset += n * length
        sequence += b.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T.copy(), strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with ``length``) with sequence_id and offset.

    Every task numbers the pieces of one (length, part) cell; a length that a third of all pieces have is numbered by
    ``PARTS`` tasks. Ties are broken by the other columns, so repeated rows get places of their own.
    """
    if {"sequence_id", "offset", "__rank", "__part"} & set(pieces.columns):
        raise ValueError("the names sequence_id, offset, __rank and __part are needed for the result")
    stages = Stages(pieces.sparkSession, "packing")
    rows = stages.put(pieces.withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns]), F.lit(PARTS)).cast("int")))
    cells = rows.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n"))
    # at most capacity counts reach the driver
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.name not in ("length", "__part")]
    own = Window.partitionBy("length", "__part").orderBy(*plain)
    ranked = rows.withColumn("__rank", F.row_number().over(own) - 1).join(cells, ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    ranked = ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], F.col("__rank").cast("long").alias("__rank"))
    # rank and length in one number, so that one sorted search finds the bin
    wide = max(histogram.values(), default=0) + 1
    if capacity * wide >= 1 << 62:
        raise ValueError("too many pieces of one length for 64-bit places")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table["length"] * wide + table["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            row = np.searchsorted(keys, length * wide + rank, "right") - 1
            within = rank - table["first"][row]
            each = table["each"][row]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            sequence, offset = table["sequence"][row] + within // each, table["offset"][row] + within % each * length
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(put, f"{kinds}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row per piece.

    A null text counts as empty: one piece that holds only the end id. Texts longer than a sequence are cut into full pieces
    and a rest. Repeated rows (also rows without an id) are packed one by one. Other columns are not read; an empty table gives no
    rows.
    """
    return pack(token_pieces(docs, path or tokenizer_path(), capacity, end_id, id_col, text_col, with_ids), capacity)
