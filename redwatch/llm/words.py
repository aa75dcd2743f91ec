"""Words of whole texts as numpy arrays: boundaries and 64-bit hashes from the bytes of an Arrow column.

A word is a longest run of bytes outside ``0x20`` and ``0x09``-``0x0D``. Those bytes never occur inside a longer UTF-8
sequence, so bytes and code points agree on the boundaries. Work goes in slices of about ``SLICE`` bytes; a longer text
is cut at separators, so memory does not grow with the text (only its word hashes do, 8 bytes per word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# random 64-bit values per byte from a fixed seed; any change makes other hashes, never other results
_BYTE = np.random.default_rng(20240101).integers(1, _MASK, 256, dtype=np.uint64)
_STEP = np.random.default_rng(20240102).integers(1, _MASK, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def settle() -> None:
    """Give freed Arrow memory back to the system: workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _slice_words(data: np.ndarray, first: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``; ``first`` marks bytes that begin a text."""
    word = ~SEPARATOR[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    closes = word.copy()
    closes[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(closes) + 1
    up, down = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[LOWER[data] if lower else data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy; a null text has no bytes."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        # what lies below a null is undefined: give it the length zero
        length = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        if (length != np.diff(at)).any():
            return buffers(pa.array(column.fill_null("").to_pylist(), column.type))
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each; a longer text is a range of its own."""
    _, at = buffers(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield low, min(high, len(column))
        low = high


def words_of(column: pa.Array, lower: bool = False, size: int = SLICE) -> Iterator[tuple]:
    """(first row, rows, word hashes, first word of each row and the end, starts, ends) per slice of rows.

    ``starts`` and ``ends`` are byte positions in the column's data buffer. ``lower`` folds A-Z before hashing.
    """
    data, at = buffers(column)
    for low, high in slices(column, size):
        begin, end = int(at[low]), int(at[high])
        parts = []
        cut = begin
        while cut < end:
            to = min(end, cut + 2 * size)
            if to < end:
                # back to just after a separator, or on to the next one when there is none
                back = np.flatnonzero(SEPARATOR[data[cut:to]])
                if len(back):
                    to = cut + int(back[-1]) + 1
                else:
                    on = np.flatnonzero(SEPARATOR[data[to:end]])
                    to = to + int(on[0]) + 1 if len(on) else end
            first = np.zeros(to - cut, bool)
            inside = at[low:high]
            inside = inside[(inside >= cut) & (inside < to)]
            first[inside - cut] = True
            s, e, h = _slice_words(data[cut:to], first, lower)
            parts.append((s + cut, e + cut, h))
            cut = to
        if parts:
            starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            starts = ends = np.zeros(0, np.int64)
            hashes = np.zeros(0, np.uint64)
        bounds = np.searchsorted(starts, at[low : high + 1])
        yield low, high - low, hashes, bounds, starts, ends


def windows(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``length`` consecutive hashes (order counts); empty when there are fewer.

    The caller drops windows that reach over the end of a text.
    """
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    steps = np.random.default_rng(seed * 1000 + length).integers(1, _MASK, length, dtype=np.uint64) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out += hashes[j : j + n] * steps[j]
    return mix(out + np.uint64(seed))


def window_starts(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that start a whole window within their text, and the text of each."""
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return bounds[:-1][text] + offset, text
