"""Simple-8b: unsigned integers packed into 64-bit words, a selector of four bits and 60 bits of equally wide numbers.

Blocks are coded apart from each other, so every block can be decoded by itself, and any number of neighbouring blocks at once:
words with the same selector are unpacked together. Numbers of more than 60 bits are escapes: their word holds the number's place
in the block's list of raw 64-bit numbers.
"""

from __future__ import annotations

import numpy as np

#: Bits per number of the selectors 1 to 14; selector 0 is a run of zeros, 15 an escape.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ZEROS, ESCAPE = 0, 15
COUNTS = np.array([240, *[60 // w for w in WIDTHS], 1])
BITS = np.array([0, *WIDTHS, 60])
_PAYLOAD = np.uint64((1 << 60) - 1)


#: Smallest selector that holds a number below 2^16.
_SMALL = np.searchsorted(BITS[: len(WIDTHS) + 1], np.frexp(np.arange(1 << 16, dtype=np.float64))[1]).astype(np.int8)


def _classes(ids: np.ndarray) -> np.ndarray:
    """Smallest selector that holds each number."""
    out = _SMALL[(ids & np.uint64(0xFFFF)).astype(np.int64)]
    large = np.flatnonzero(ids >> np.uint64(16))
    if len(large):
        # compared as whole numbers: the limits 2^bits are exact
        out[large] = np.searchsorted((np.uint64(1) << BITS[1 : len(WIDTHS) + 1].astype(np.uint64)) - np.uint64(1), ids[large]) + 1
    return out


def _selectors(ids: np.ndarray) -> np.ndarray:
    """Per position the selector with most numbers that can start there; behind the end there is room for anything."""
    n = len(ids)
    own = _classes(ids)
    best = np.where(own == ESCAPE, ESCAPE, len(WIDTHS)).astype(np.int8)
    for s in range(len(WIDTHS) - 1, -1, -1):
        # stretches between numbers that do not fit
        stops = np.concatenate([np.flatnonzero(own > s), [n]])
        begins = np.concatenate([[0], stops[:-1] + 1])
        stretch = np.flatnonzero(stops - begins >= COUNTS[s])
        if not len(stretch):
            # smaller selectors need longer stretches and find shorter ones: only the end, shorter than a word, has room for them
            tail = np.maximum.accumulate(own[: -COUNTS[s] - 1 : -1])[::-1]
            best[n - len(tail) :] = np.where(tail <= s, tail, best[n - len(tail) :])
            break
        ends = stops[stretch] - COUNTS[s] + 1
        begins = begins[stretch]
        if len(stretch) > n // 64:
            mark = np.zeros(n + 1, np.int8)
            mark[begins] = 1
            mark[ends] -= 1
            best[np.cumsum(mark[:n], dtype=np.int8).view(bool)] = s
        else:
            for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
                best[begin:end] = s
        best[stops[-2] + 1 if len(stops) > 1 else 0 :] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped numbers) of one block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    selector = _selectors(ids)
    jump = COUNTS[selector].tolist()
    starts, at, n = [], 0, len(ids)
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(int(COUNTS.max()), np.uint64)])
    for s in range(1, ESCAPE):
        row = np.flatnonzero(chosen == s)
        if len(row):
            places = np.arange(COUNTS[s])
            numbers = padded[starts[row][:, None] + places]
            words[row] |= np.bitwise_or.reduce(numbers << (places * BITS[s]).astype(np.uint64), axis=1)
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, ids[starts[escaped]]


def decode(words: np.ndarray, n_words: np.ndarray, n_ids: np.ndarray, escapes: np.ndarray, n_escapes: np.ndarray) -> np.ndarray:
    """Numbers of neighbouring blocks, given per block how many words, numbers and escapes it has."""
    out = np.zeros(int(n_ids.sum()), np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(len(n_words)), n_words)
    have = COUNTS[selector]
    before = np.cumsum(have) - have
    first = np.cumsum(n_words) - n_words
    # places within the block, then the block's own start: its last word may be filled in part only
    within = before - before[first[block]] if len(words) else before
    start = within + (np.cumsum(n_ids) - n_ids)[block]
    end = np.cumsum(n_ids)[block]
    for s in range(1, ESCAPE):
        row = np.flatnonzero(selector == s)
        if len(row):
            places = np.arange(COUNTS[s])
            numbers = words[row][:, None] >> (places * BITS[s]).astype(np.uint64) & np.uint64((1 << int(BITS[s])) - 1)
            at = start[row][:, None] + places
            inside = at < end[row][:, None]
            out[at[inside]] = numbers[inside]
    row = np.flatnonzero(selector == ESCAPE)
    if len(row):
        base = (np.cumsum(n_escapes) - n_escapes)[block[row]]
        out[start[row]] = escapes[base + (words[row] & _PAYLOAD).astype(np.int64)]
    return out
