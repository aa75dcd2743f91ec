"""CRC-32 of many spans of a byte array at once.

CRC-32 is linear up to a constant that depends on the length only. What a byte adds to the result depends on its value and on
its distance from the end of the span, so those contributions are looked up in a table and combined by exclusive or over each
span. The table reaches ``DEPTH`` bytes back; a longer span is folded block by block: the result so far is moved on by
``DEPTH`` bytes, a linear map looked up by its four bytes, and the block's contributions are added.
"""

from __future__ import annotations

import zlib

import numpy as np

DEPTH = 128
_ONES = np.uint32(0xFFFFFFFF)
_POLYNOMIAL = np.uint32(0xEDB88320)


def _byte_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & np.uint32(1), state >> np.uint32(1) ^ _POLYNOMIAL, state >> np.uint32(1))
    return state


_BYTE = _byte_table()


def _moved(state: np.ndarray, n: int) -> np.ndarray:
    """States after ``n`` bytes of zero."""
    for _ in range(n):
        state = _BYTE[state & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


def _contributions() -> np.ndarray:
    rows = [_BYTE]
    while len(rows) < DEPTH:
        rows.append(_moved(rows[-1], 1))
    return np.concatenate(rows)


#: Contribution of byte b at d bytes from the end, at 256 * d + b.
_TABLE = _contributions()
#: CRC-32 of n bytes of zero: the constant of the length n.
_LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], np.uint32)
#: What each byte of a state becomes ``DEPTH`` bytes later.
_FOLD = [_moved(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), DEPTH) for k in range(4)]


def _combined(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Contributions of spans of 1 to ``DEPTH`` bytes, without the constant."""
    close = np.cumsum(lengths)
    first = close - lengths
    place = np.arange(int(close[-1]) if len(close) else 0)
    own = data[place + np.repeat(starts - first, lengths)]
    index = (np.repeat(close - 1, lengths) - place << 8) + own
    return np.bitwise_xor.reduceat(_TABLE[index], first) if len(first) else np.zeros(0, np.uint32)


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 (as zlib's) of every ``data[start:end]``; spans may overlap, come in any order, and be empty."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)
    short = (lengths > 0) & (lengths <= DEPTH)
    if short.all():
        return _combined(data, starts, lengths) ^ _LENGTH[lengths]
    out[short] = _combined(data, starts[short], lengths[short]) ^ _LENGTH[lengths[short]]
    long = np.flatnonzero(lengths > DEPTH)
    if len(long):
        rest = lengths[long] % DEPTH
        state = _LENGTH[rest] ^ _ONES
        some = rest > 0
        state[some] ^= _combined(data, starts[long][some], rest[some])
        at, blocks = starts[long] + rest, lengths[long] // DEPTH
        for step in range(int(blocks.max())):
            on = np.flatnonzero(blocks > step)
            old = state[on]
            moved = _FOLD[0][old & np.uint32(255)] ^ _FOLD[1][old >> np.uint32(8) & np.uint32(255)] ^ _FOLD[2][old >> np.uint32(16) & np.uint32(255)] ^ _FOLD[3][old >> np.uint32(24)]
            state[on] = moved ^ _combined(data, at[on] + step * DEPTH, np.full(len(on), DEPTH))
        out[long] = state ^ _ONES
    return out
