"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A sequence of BPE pieces is the encoding of a text exactly if every two neighbours are the encoding of their own
concatenation. So encoding is a best path over (position, last piece) with weight 0 for such neighbours and minus infinity for
others; as a further weight every id counts -1, which also gives the number of ids before each place.

A giant document is cut into chunks. What a piece that crosses a cut may look like is a boundary state: how many characters lie
before and behind the cut. Every chunk yields, by itself, a transfer matrix of path weights from entering to leaving
states; matrices of neighbours are combined by max-plus products, level by level; on the way back down each chunk learns its
two states and its first id's number, and is traced back by itself. Where no piece can span a place (before a space, at a
line end) all paths meet, so matrices have few entries and words can be kept in a table.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stages

#: Characters per chunk; documents of at most this length are one chunk.
CHUNK = 65_536
KEPT_WORDS = 500_000
KEPT_PAIRS = 300_000
LONGEST_WORD = 48
SPACE = "▁"
#: State of a boundary that no piece crosses.
SAFE = 0


def model_path() -> str:
    """File of the public model; ``PIECE_BPE_PATH`` overrides it."""
    given = os.environ.get("PIECE_BPE_PATH")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class PieceModel:
    """Pieces of a BPE model with byte fallback, identity normalization and a leading space."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.bytes_of = [b""] * size
        for piece, i in self.ids.items():
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        inner = [p for p in self.ids if SPACE in p.lstrip(SPACE) or "\n" in p]
        probes = (" a  b ", "a\nb", "▁x", "ﬁ é")
        if inner or len(self.byte_ids) != 256 or any(sp.encode(p) != np.frombuffer(self._probe(p), "<u4").tolist() for p in probes):
            raise ValueError("the model is not a BPE model with byte fallback, identity normalization and whole words")
        self.words = _Words(self.word)

    def _probe(self, text: str) -> bytes:
        self.words, self.pairs = _Words(self.word), {}
        return b"".join(map(self.words.__getitem__, self.split(normalized(text))))

    split = staticmethod(re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+").findall)

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> PieceModel:
        return PieceModel(path)

    # ------------------------------------------------------------------ the lattice

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours are merged, the left one of equals, until none are left."""
        parts, none, score = list(text), float("-inf"), self.score.get
        gains = [score(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while gains:
            best = max(gains)
            if best == none:
                break
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def follows(self, left: str | None, right: str) -> bool:
        """Whether ``right`` may stand after ``left`` (after a safe boundary, if None)."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if left is None:
                known = self.merged(right) == [right]
            else:
                known = self.merged(left + right) == [left, right]
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def width(self, piece: str) -> int:
        """Ids of a piece: one, or one per byte of a character that is no piece."""
        return 1 if piece in self.ids else len(piece.encode())

    def paths(self, text: str, start: int, before: str | None, stop: int, end: int) -> dict[int, tuple[int, str | None, int]]:
        """position: (where its last piece starts, that piece, ids so far) for the places a valid path from ``start`` reaches.

        Pieces start before ``stop`` and end at ``end`` at most. Every prefix has one encoding, so one entry per place is enough.
        """
        out: dict[int, tuple[int, str | None, int]] = {start: (start, before, 0)}
        ids, longest = self.ids, self.longest
        for to in range(start + 1, end + 1):
            for at in range(min(to, stop) - 1, max(start, to - longest) - 1, -1):
                back = out.get(at)
                if back is None:
                    continue
                piece = text[at:to]
                if (piece in ids or to - at == 1) and self.follows(back[1], piece):
                    out[to] = (at, piece, back[2] + self.width(piece))
                    break
        return out

    def trace(self, paths: dict[int, tuple[int, str | None, int]], start: int, end: int) -> bytes:
        """Ids of the path that ends at ``end``."""
        pieces = []
        while end > start:
            end, piece, _ = paths[end]
            pieces.append(piece)
        return self.packed(reversed(pieces))

    def packed(self, pieces: Iterable[str]) -> bytes:
        """Ids of pieces; a character that is no piece becomes its bytes."""
        out = []
        for piece in pieces:
            known = self.ids.get(piece)
            if known is None:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(known)
        return array("I", out).tobytes()

    def word(self, word: str) -> bytes:
        """Ids between two safe boundaries: one path leads there, and merging finds it without the other places."""
        if len(word) <= LONGEST_WORD:
            return self.packed(self.merged(word))
        return self.trace(self.paths(word, 0, None, len(word), len(word)), 0, len(word))

    # ------------------------------------------------------------------ chunks

    def _frame(self, left: str, own: str, right: str) -> tuple[str, int, int, list[int], bool, bool]:
        text, c, d = left + own + right, len(left), len(left) + len(own)

        def safe(i: int) -> bool:
            return i in (0, len(text)) or text[i] == "\n" or text[i - 1] == "\n" or (text[i] == SPACE and text[i - 1] != SPACE)

        places = [i for i in (c, d) if safe(i)]
        first = next((i for i in range(c, d + 1) if safe(i)), None)
        if first is not None:
            places = [first, next(i for i in range(d, c - 1, -1) if safe(i))]
        return text, c, d, places, safe(c), safe(d)

    def _entries(self, text: str, c: int, whole: bool) -> list[tuple[int, int, str | None]]:
        """Possible states at a cut: (code, where the crossing piece ends, the piece)."""
        if whole:
            return [(SAFE, c, None)]
        out = []
        for a in range(1, min(c, self.longest) + 1):
            for b in range(min(self.longest - a, len(text) - c) + 1):
                piece = text[c - a : c + b]
                if a + b == 1 or piece in self.ids:
                    out.append((a * 256 + b, c + b, piece))
        return out

    def _exits(self, text: str, start: int, before: str | None, d: int, whole: bool) -> dict[int, tuple[int, dict]]:
        """code of the leaving state: (where its piece ends, paths)."""
        if whole:
            paths = self.paths(text, start, before, d, d)
            return {SAFE: (d, paths)} if d in paths else {}
        paths = self.paths(text, start, before, d, min(len(text), d + self.longest - 1))
        return {(d - p[0]) * 256 + (e - d): (e, paths) for e, p in paths.items() if e >= d and e > start}

    def transfer(self, left: str, own: str, right: str) -> list[tuple[int, int, int]]:
        """(entering state, leaving state, minus the ids between) of a chunk with its surroundings."""
        text, c, d, places, whole_c, whole_d = self._frame(left, own, right)
        out = []
        if not places:
            for code, at, piece in self._entries(text, c, whole_c):
                if at >= d:
                    # the piece reaches over the whole chunk: the state is passed on as it is
                    a, b = divmod(code, 256)
                    out.append((code, (a + d - c) * 256 + (b - (d - c)), 0))
                    continue
                out += [(code, leave, -paths[e][2]) for leave, (e, paths) in self._exits(text, at, piece, d, whole_d).items()]
            return out
        first, last = places
        middle = sum(len(self.words[w]) for w in self.split(text[first:last])) // 4
        tails = [(leave, paths[e][2]) for leave, (e, paths) in self._exits(text, last, None, d, whole_d).items()]
        for code, at, piece in self._entries(text, c, whole_c):
            if at > first:
                continue
            heads = self.paths(text, at, piece, first, first)
            if first in heads:
                out += [(code, leave, -(heads[first][2] + middle + n)) for leave, n in tails]
        return out

    def backtrace(self, left: str, own: str, right: str, entering: int, leaving: int) -> bytes:
        """Ids of a chunk between two known states: the piece that enters belongs to the chunk before, the one that leaves to this."""
        text, c, d, places, whole_c, whole_d = self._frame(left, own, right)
        a, b = divmod(entering, 256)
        at, piece = c + b, text[c - a : c + b] if a else None
        if not places:
            if at >= d:
                return b""
            e, paths = self._exits(text, at, piece, d, whole_d)[leaving]
            return self.trace(paths, at, e)
        first, last = places
        head = self.trace(self.paths(text, at, piece, first, first), at, first)
        e, paths = self._exits(text, last, None, d, whole_d)[leaving]
        return head + b"".join(map(self.words.__getitem__, self.split(text[first:last]))) + self.trace(paths, last, e)

    def text_of(self, ids: bytes, first: bool = True) -> bytes:
        """UTF-8 bytes that ids stand for, without the leading space of a text's first chunk."""
        out = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.removeprefix(b" ") if first else out


def normalized(text: str) -> str:
    """Spaces as visible marks and one in front; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


# --------------------------------------------------------------------------- jobs


def _rows(path: str, keep: str, with_ids: bool, owner: list, chunk: list, start: list, ids: list) -> pa.RecordBatch:
    model = PieceModel.load(path)
    texts = [model.text_of(x, c == 0) for x, c in zip(ids, chunk, strict=True)]
    columns = [
        owner,
        pa.array(chunk, pa.int32()),
        pa.array(start, pa.int64()),
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array([zlib.crc32(x) for x in texts], pa.int64()),
    ]
    names = [keep, "chunk", "start", "length", "ids_crc32", "decoded_bytes", "decoded_crc32"]
    if with_ids:
        columns, names = [*columns, pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)


def _short(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                # one chunk with a safe boundary on either side
                ids = [model.backtrace("", normalized(t or ""), "", SAFE, SAFE) if t else b"" for t in part.column("text").to_pylist()]
                n = len(ids)
                yield _rows(path, "doc_id", with_ids, part.column("doc_id"), [0] * n, [0] * n, ids)

    return run


def _cut(longest: int, chunk: int):
    schema = ["doc_id", "key", "chunks", "chunk", "left", "own", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = normalized(batch.column("text")[i].as_py())
                cuts = range(0, len(text), chunk)
                n = len(cuts)
                for block in range(0, n, 64):
                    own = cuts[block : block + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("doc_id")[i].as_py()] * len(own), pa.int64()),
                            pa.array([batch.column("key")[i].as_py()] * len(own), pa.string()),
                            pa.array([n] * len(own), pa.int64()),
                            pa.array(range(block, block + len(own)), pa.int64()),
                            pa.array([text[max(0, c - longest) : c] for c in own], pa.string()),
                            pa.array([text[c : c + chunk] for c in own], pa.string()),
                            pa.array([text[c + chunk : c + chunk + longest] for c in own], pa.string()),
                        ],
                        schema,
                    )

    return run


def _transfers(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(path)
        for batch in batches:
            for i in range(batch.num_rows):
                left, own, right = (batch.column(c)[i].as_py() for c in ("left", "own", "right"))
                entries = model.transfer(left, own, right)
                n = len(entries)
                fixed = [pa.array([batch.column(c)[i].as_py()] * n, kind) for c, kind in (("key", pa.string()), ("chunks", pa.int64()), ("chunk", pa.int64()))]
                moves = np.array(entries, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(moves[:, k]) for k in range(3))], ["key", "nodes", "node", "enter", "leave", "weight"])

    return run


def _traced(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                left, own, right, enter, leave = (part.column(c).to_pylist() for c in ("left", "own", "right", "enter", "leave"))
                ids = [model.backtrace(*x) for x in zip(left, own, right, enter, leave, strict=True)]
                yield _rows(path, "doc_id", with_ids, part.column("doc_id"), part.column("chunk").to_pylist(), part.column("start").to_pylist(), ids)

    return run


def combined(matrices: DataFrame) -> DataFrame:
    """Matrices of two neighbours as one: the largest sum over the state between them; a node without a neighbour stays."""
    pair = F.floor(F.col("node") / 2).alias("node")
    left = matrices.where("node % 2 = 0")
    alone = left.where("node + 1 = nodes").select("key", F.ceil(F.col("nodes") / 2).alias("nodes"), pair, "enter", "leave", "weight")
    x = left.select("key", "nodes", pair, "enter", F.col("leave").alias("between"), F.col("weight").alias("wx"))
    y = matrices.where("node % 2 = 1").select("key", pair, F.col("enter").alias("between"), "leave", F.col("weight").alias("wy"))
    both = x.join(y, ["key", "node", "between"]).groupBy("key", F.ceil(F.col("nodes") / 2).alias("nodes"), "node", "enter", "leave").agg(F.max(F.col("wx") + F.col("wy")).alias("weight"))
    return alone.unionByName(both)


def descended(states: DataFrame, matrices: DataFrame) -> DataFrame:
    """States (key, node, enter, leave, start) of a level from those above it and the level's matrices."""
    up = states.withColumnRenamed("node", "above")
    above = F.floor(F.col("node") / 2).alias("above")
    left = matrices.where("node % 2 = 0").select("key", "nodes", "node", above, "enter", F.col("leave").alias("between"), F.col("weight").alias("wx"))
    right = matrices.where("node % 2 = 1").select("key", above, F.col("enter").alias("between"), "leave", F.col("weight").alias("wy"))
    found = up.join(left, ["key", "above", "enter"])
    alone = found.where("node + 1 = nodes AND between = leave").select("key", "node", "enter", "leave", "start")
    best = found.join(right, ["key", "above", "between", "leave"]).groupBy("key", "node", "enter", "leave", "start").agg(F.max_by(F.struct("between", "wx"), F.col("wx") + F.col("wy")).alias("m"))
    first = F.struct(F.col("node").alias("node"), F.col("enter").alias("enter"), F.col("m.between").alias("leave"), F.col("start").alias("start"))
    second = F.struct((F.col("node") + 1).alias("node"), F.col("m.between").alias("enter"), F.col("leave").alias("leave"), (F.col("start") - F.col("m.wx")).alias("start"))
    return alone.unionByName(best.select("key", F.inline(F.array(first, second))))


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk, start, length, ids_crc32, decoded_bytes, decoded_crc32 (and ids): one row per chunk.

    ``start`` is the number of ids in earlier chunks; the ids of a document are those of its chunks in order and equal the
    library's. The decoded columns describe the text that the chunk's ids stand for. A null or empty text is one chunk without
    ids. Repeated rows (also rows without an id) are encoded one by one. Other columns are not read; an empty table gives
    no rows.
    """
    path = path or model_path()
    longest = PieceModel.load(path).longest
    if chunk < longest:
        raise ValueError("a chunk is at least as long as the longest piece")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = "doc_id long, chunk int, start long, length long, ids_crc32 long, decoded_bytes long, decoded_crc32 long" + (", ids array<int>" if with_ids else "")
    fits = F.coalesce(F.char_length("text"), F.lit(0)) < chunk
    short = rows.where(fits).mapInArrow(_short(path, with_ids), kind)
    stages = Stages(docs.sparkSession, "pieces")
    keyed = rows.where(~fits).withColumn("key", F.sha2(F.encode("text", "UTF-8"), 256))
    cut = keyed.mapInArrow(_cut(longest, chunk), "doc_id long, key string, chunks long, chunk long, left string, own string, right string")
    giant = stages.put(cut.repartition("key", "chunk"))
    most = giant.agg(F.max("chunks").alias("n")).first()["n"]
    if most is None:
        return short
    first = giant.mapInArrow(_transfers(path), "key string, nodes long, node long, enter long, leave long, weight long")
    # copies of a giant text have equal matrices: one is enough
    levels = [stages.put(first.groupBy("key", "nodes", "node", "enter", "leave").agg(F.max("weight").alias("weight")))]
    while most > 1:
        levels.append(stages.put(combined(levels[-1])))
        most = -(-most // 2)
    states = levels[-1].where((F.col("enter") == SAFE) & (F.col("leave") == SAFE)).select("key", "node", "enter", "leave", F.lit(0).cast("long").alias("start"))
    for matrices in reversed(levels[:-1]):
        states = stages.put(descended(states, matrices))
    traced = giant.join(states.withColumnRenamed("node", "chunk"), ["key", "chunk"]).mapInArrow(_traced(path, with_ids), kind)
    return short.unionByName(traced)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, chunk, text of encoded chunks (with ``ids``); the texts of a document's chunks in order make up its text.

    Chunks without ids have an empty text; null ids give a null text.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = []
                for ids, chunk in zip(part.column("ids"), part.column("chunk").to_pylist(), strict=True):
                    known = ids.values.to_numpy().astype("<u4").tobytes() if ids.is_valid else None
                    texts.append(None if known is None else model.text_of(known, chunk == 0).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("chunk"), pa.array(texts, pa.string())], ["doc_id", "chunk", "text"])

    return encoded.select("doc_id", "chunk", "ids").mapInArrow(run, "doc_id long, chunk int, text string")
