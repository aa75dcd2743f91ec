"""Importance resampling towards a target: documents whose word n-grams are likelier in the target than in the whole table.

N-grams are counted in buckets of their CRC-32 over all documents and over the target. A bucket's gain is the scaled logarithm of
the ratio of both shares, a document's weight the sum of the gains of its n-grams. A Gumbel number from the hash of the id is
added, and the documents of highest score are drawn: a sample without replacement with probabilities by weight, and the same one at
each run. Two passes read the texts; between them ``buckets`` counts reach the driver, afterwards one count per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .shared import Stages
from .span_crc import crc32
from .words import LOWER, SLICE, buffers, settle, slices

BUCKETS = 10_000
ORDERS = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42

#: Bytes of words once A-Z is folded: digits, a-z, and all bytes of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _pieces(data: np.ndarray, begin: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end between two words."""
    while begin < end:
        to = min(end, begin + size)
        if to < end:
            gaps = np.flatnonzero(~_WORD[LOWER[data[begin:to]]])
            if len(gaps):
                to = begin + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(~_WORD[LOWER[data[to:end]]])
                to = to + int(more[0]) + 1 if len(more) else end
        yield begin, to
        begin = to


def _joined(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words, each followed by one space, the length of each, and the place of each in ``data``; ``first`` marks bytes that begin a text."""
    low = LOWER[data]
    word = _WORD[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    number = np.cumsum(begins)[word] - 1
    lengths = np.bincount(number, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    out = np.full(len(number) + len(starts), 32, np.uint8)
    out[np.arange(len(number)) + number] = low[word]
    return out, lengths, starts


def features(column: pa.Array, orders: int = ORDERS, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, words per row, row of each n-gram, CRC-32 of each n-gram), piece by piece.

    Short texts come many at a time. A long one comes in pieces; its last words are carried to the next piece, so that n-grams
    across the cut are counted, once.
    """
    data, at = buffers(column)
    for low, high in slices(column, size):
        kept, kept_lengths = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        begin, end = int(at[low]), int(at[high])
        for cut, to in _pieces(data, begin, end, size if high == low + 1 else end - begin):
            first = np.zeros(to - cut, bool)
            inside = at[low:high]
            first[inside[(inside >= cut) & (inside < to)] - cut] = True
            text, lengths, starts = _joined(data[cut:to], first)
            rows = np.searchsorted(at[low : high + 1], starts + cut, "right") - 1
            n_words = np.bincount(rows, minlength=high - low)
            # only a text of its own is cut, so words carried on are of row 0
            old = len(kept_lengths)
            text, lengths, rows = np.concatenate([kept, text]), np.concatenate([kept_lengths, lengths]), np.concatenate([np.zeros(old, np.int64), rows])
            close = np.cumsum(lengths + 1) - 1
            opened = close - lengths
            owner, value = [], []
            for k in range(1, orders + 1):
                i = np.arange(max(0, old - k + 1), len(rows) - k + 1)
                i = i[rows[i] == rows[i + k - 1]]
                owner.append(rows[i])
                value.append(crc32(text, opened[i], close[i + k - 1]))
            yield low, high - low, n_words, np.concatenate(owner), np.concatenate(value)
            last = max(0, len(lengths) - orders + 1)
            kept, kept_lengths = text[opened[last] :] if last < len(lengths) else text[:0], lengths[last:]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """N-grams per bucket over all texts; at most ``buckets`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, value in features(batch.column("text"), orders):
                total += np.bincount(value % buckets, minlength=buckets)
            settle()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the logarithm of target share over source share, in thousandths, each count raised by one."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """doc_id, n_words, n_features, weight: one row per document."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for low, n, n_words, row, value in features(batch.column("text"), orders):
                own = slice(low, low + n)
                out[0, own] += n_words
                out[1, own] += np.bincount(row, minlength=n)
                # sums of whole numbers, exact below 2^53
                out[2, own] += np.bincount(row, weights=gain[value % buckets], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])
            settle()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel number of a document in thousandths, from the first 32 bits of the hash of seed and id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    orders: int = ORDERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per document; rank is 1, 2, 3 ... for those drawn, else null.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred are drawn, rounded down: those of highest score,
    ties to the smaller id. Null and empty texts have no features and weight 0. A document without an id counts in the statistics,
    but has no score and is never drawn. Rows that repeat an id are documents of their own and get ranks next to each other
    when their weights are equal. Other columns are not read. An empty target makes all counts of the target zero; an empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "resampling")
    gain = gains(bucket_counts(docs, text_col, buckets, orders), bucket_counts(target, target_col, buckets, orders))
    scored = stages.put(weights(docs, gain, id_col, text_col, orders).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    drawn = percent * scored.where(able).count() // 100
    parts = ranks.sorted_parts(scored, [F.when(able, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc()], stages)
    stages.drop(scored)
    rank = ranks.global_rank(parts)
    return parts.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank < drawn, rank + 1).cast("long").alias("rank"))
