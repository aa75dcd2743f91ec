"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded, hash-chosen sample of labelled documents (``SAMPLE`` per language in expectation; fewer
labelled documents are all used). The log-probability matrix goes to the tasks in blocks of ``BLOCK`` languages x ``BUCKETS`` floats;
every whole text is scored there in slices, so memory grows neither with a text nor with the number of languages. The driver holds the
whole matrix, 128 KB a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .words import buffers, mix, settle, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE = 4_000
#: Languages counted or scored in one pass; further ones take further passes.
BLOCK = 256
UNDETERMINED = "und"
#: A text is judged against its language by its log-probability per n-gram: this much below the middle (or ``SPREADS`` times the
#: spread of the language's documents, if more) is allowed, and ``NOISE`` standard errors of its own length.
MARGIN = 0.8
SPREADS = 6.0
NOISE = 3.0
#: Bytes scored at a time; n-grams take about a hundred bytes of memory per byte of text.
SLICE = 1 << 18

_TABLE = 0x3000
_lower: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Lower-case code point of each letter, a space for all else, for the code points below ``_TABLE``."""
    global _lower
    if _lower is None:
        _lower = np.array([_fold(c) for c in range(_TABLE)], np.uint32)
    return _lower


def _fold(c: int) -> int:
    char = chr(c)
    if not char.isalpha():
        return 32
    low = char.lower()
    return ord(low) if len(low) == 1 else c


def _folded(codes: np.ndarray) -> np.ndarray:
    table = _letters()
    out = table[np.minimum(codes, _TABLE - 1)]
    high = np.flatnonzero(codes >= _TABLE)
    if len(high):
        seen, place = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_fold(int(c)) for c in seen], np.uint32)[place]
    return out


def grams(column: pa.Array, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of rows ``low`` to ``high`` and, per row, whether it has a letter; piece by piece."""
    data, at = buffers(column)
    begin, end = int(at[low]), int(at[high])
    kept_codes, kept_rows = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    longest = max(ORDERS) - 1
    while begin < end:
        to = min(end, begin + SLICE)
        while to < end and data[to] & 0xC0 == 0x80:
            to += 1
        piece = data[begin:to]
        codes = np.frombuffer(piece.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((piece & 0xC0) != 0x80)
        if len(lead) != len(codes):
            raise ValueError("text is not UTF-8")
        rows = np.searchsorted(at, lead + begin, "right") - 1
        codes = _folded(codes)
        has = np.unique(rows[codes != 32])
        old = len(kept_codes)
        codes, rows = np.concatenate([kept_codes, codes]), np.concatenate([kept_rows, rows])
        found_rows, found = [], []
        wide = codes.astype(np.uint64)
        for n in ORDERS:
            start = max(0, old - n + 1)
            m = len(codes) - n + 1 - start
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x110000) + wide[start + j : start + j + m]
            whole = rows[start : start + m] == rows[start + n - 1 : start + n - 1 + m]
            found_rows.append(rows[start : start + m][whole])
            found.append((mix(h[whole]) % np.uint64(BUCKETS)).astype(np.int64))
        yield np.concatenate(found_rows) - low, np.concatenate(found), has - low
        kept_codes, kept_rows = codes[-longest:], rows[-longest:]
        begin = to


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray  # (languages)
    log_prob: np.ndarray  # (languages, BUCKETS) float32

    def gram_deviation(self) -> dict[str, float]:
        """Standard deviation of the log-probability of one n-gram drawn from each language."""
        out = {}
        for lang, row in zip(self.languages, self.log_prob, strict=True):
            wide = row.astype(float)
            share = np.exp(wide)
            out[lang] = float(np.sqrt((share * (wide - (share * wide).sum()) ** 2).sum()))
        return out


def held_out(id_col: Column) -> Column:
    """Documents kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Model from labelled rows; rows without text, language or id do not count.

    Priors come from all labelled rows, n-gram counts from about ``sample`` of them per language. Any number of languages; every
    ``BLOCK`` of them take one pass.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros(0), np.zeros((0, BUCKETS), np.float32))
    counts = np.concatenate([
        _counts(rows, {x: sizes[x] for x in languages[i : i + BLOCK]}, sample) for i in range(0, len(languages), BLOCK)
    ])
    total = sum(sizes.values())
    prior = np.log(np.array([sizes[x] for x in languages], float) / total)
    return Model(languages, prior, counts)


def _counts(rows: DataFrame, sizes: dict[str, int], sample: int) -> np.ndarray:
    """Log-probabilities of one block of languages."""
    share = F.create_map(*[F.lit(x) for lang in sizes for x in (lang, min(1.0, sample / sizes[lang]))])
    chance = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    # null, so not chosen, for the languages of other blocks
    chosen = rows.where(chance < F.try_element_at(share, F.col("lang"))).select("text", "lang")
    place = {lang: i for i, lang in enumerate(sizes)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(place) * BUCKETS, np.int64)
        for batch in batches:
            text, lang = batch.column("text"), np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for low, high in slices(text, SLICE):
                for row, bucket, _ in grams(text, low, high):
                    total += np.bincount(lang[low + row] * BUCKETS + bucket, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    # at most languages of the block x BUCKETS cells, whatever the input
    counts = np.zeros(len(place) * BUCKETS)
    for r in chosen.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(len(place), BUCKETS) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), detail: bool = False) -> DataFrame:
    """Columns ``keep`` with lang_pred and score, one row per document; ``text_col`` may be a field of a kept struct.

    ``detail`` adds n_grams and gram_log_prob, the mean log-probability of the text's n-grams in that language: the score says
    which of the known languages is likeliest, this one how well the text fits it (see ``typical`` and ``misfit``).

    ``und`` with score 0 where the text is null or has no letter (an empty text has none), or where the model knows no
    language. Otherwise the language of largest posterior probability, ties by name, and that probability. Repeated rows are
    scored one by one; other columns are not read; an empty table gives no rows.
    """
    struct, _, field = text_col.partition(".")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    # a text inside a kept struct is read from there and not sent twice
    inputs = kept if field else docs.select(*kept.columns, F.col(f"`{text_col}`").cast("string").alias("__text"))
    # each n-gram order is weighted alike: the score of a text is the sum over all its n-grams
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields)
    blocks = range(0, max(len(model.languages), 1), BLOCK)
    for start in blocks:
        # written between passes, so that no task holds the matrices of two blocks
        inputs = inputs if start == 0 else stored(inputs, "languages")
        inputs = inputs.mapInArrow(_scorer(model, start, struct, field), f"{kinds}, {STATE}")
    # a join-free end: the name of the best language by its place
    names = F.array(*[F.lit(x) for x in model.languages]) if model.languages else F.array(F.lit(UNDETERMINED))
    known = F.col("__best") >= 0
    more = [F.col("__grams").alias("n_grams"), F.when(known, F.col("__own") / F.greatest("__grams", F.lit(1))).otherwise(0.0).alias("gram_log_prob")]
    return inputs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.when(known, F.get(names, F.col("__best").cast("int"))).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, 1.0 / F.col("__rest")).otherwise(0.0).alias("score"),
        *(more if detail else []),
    )


#: Carried from block to block: the best language so far, its score, all probability in units of the best one's, the number of
#: n-grams and the best one's sum over them.
STATE = "__best long, __top double, __rest double, __grams long, __own double"


def _scorer(model: Model, start: int, struct: str, field: str):
    """Pass over the texts for the languages from ``start`` on; later passes go on from the columns of ``STATE``."""
    prior, table = model.prior[start : start + BLOCK], model.log_prob[start : start + BLOCK]
    state = [c.split()[0] for c in STATE.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.struct_field(batch.column(struct), field) if field else batch.column("__text")
            n = len(text)
            if start:
                best, top, rest, seen, own = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in state)
            else:
                best, top, rest = np.full(n, -1, np.int64), np.full(n, -np.inf), np.zeros(n)
                seen, own = np.zeros(n, np.int64), np.zeros(n)
            for low, high in slices(text, SLICE):
                total = np.tile(prior, (high - low, 1))
                letters = np.zeros(high - low, bool)
                for row, bucket, has in grams(text, low, high):
                    letters[has] = True
                    if not start:
                        seen[low:high] += np.bincount(row, minlength=high - low)
                    for k in range(len(prior)):
                        total[:, k] += np.bincount(row, weights=table[k][bucket], minlength=high - low)
                if not len(prior):
                    continue
                at = np.flatnonzero(letters)
                total, at = total[at], at + low
                winner = total.argmax(axis=1)
                high_mark = total.max(axis=1)
                mass = np.exp(total - high_mark[:, None]).sum(axis=1)
                # ties go to the earlier name, so only a larger score replaces
                better = high_mark > top[at]
                both = np.maximum(high_mark, top[at])
                rest[at] = rest[at] * np.exp(top[at] - both) + mass * np.exp(high_mark - both)
                top[at] = both
                best[at[better]] = start + winner[better]
                own[at[better]] = (high_mark - prior[winner])[better]
            settle()
            arrays = [batch.column(i) for i in range(batch.num_columns - (len(state) if start else 0))]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(x) for x in (best, top, rest, seen, own)]], [*batch.schema.names[: len(arrays)], *state])

    return score


def typical(judged: DataFrame, label: Column) -> dict[str, tuple[float, float]]:
    """Middle and spread of gram_log_prob per language, over all rows of ``predict(detail=True)`` whose label is the prediction.

    Rows of other or no label do not count, so that texts in an unknown language do not widen the language they fall to; one row
    per language reaches the driver.
    """
    low, middle = (F.percentile_approx("gram_log_prob", p, 10_000) for p in (0.25, 0.5))
    rows = judged.where((F.col("lang_pred") == label) & (F.col("lang_pred") != UNDETERMINED)).groupBy("lang_pred").agg(low.alias("low"), middle.alias("middle"))
    return {r["lang_pred"]: (r["middle"], (r["middle"] - r["low"]) / 0.6745) for r in rows.collect()}


def misfit(model: Model, usual: dict[str, tuple[float, float]]) -> Column:
    """Whether a row's gram_log_prob is too low for its language, whatever its length; false where ``usual`` lacks the language.

    The standard error takes the n-grams of one place (one per order) as one draw.
    """
    # one flat list of cases: hundreds of languages must not nest
    deviation, out = model.gram_deviation(), F.when(F.lit(False), F.lit(False))
    for lang, (middle, spread) in sorted(usual.items()):
        error = deviation[lang] * F.sqrt(len(ORDERS) / F.greatest(F.col("n_grams"), F.lit(1)))
        out = out.when(F.col("lang_pred") == lang, F.col("gram_log_prob") < middle - max(MARGIN, SPREADS * spread) - NOISE * error)
    return out.otherwise(False)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learned from those that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), sample)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
