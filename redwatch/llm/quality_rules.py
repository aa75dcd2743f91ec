"""Quality rules by distribution divergence, in DataFrame expressions only.

Each document has two histograms: its character classes and the common words of its language. They are compared with the
histograms of that language, summed over all documents that look ordinary, by the Jensen-Shannon distance (base 2, 0 to 1).
Short documents are guarded: their histograms are noisy, so the allowed distance shrinks with the square root of the word
count and below a minimum length no distance is judged. The factor for the common words is that of ordinary documents of the
language and about that length, and never reaches the distance of a text without any common word, where such a text is no accident.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stages

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# fixed values: ten common words per language
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "por"),
    "fr": ("de", "la", "le", "et", "les", "en", "des", "un", "du", "une"),
}
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")


@dataclass(frozen=True)
class Limits:
    min_words: int = 10  # fewer: failed
    repeat_percent: int = 20  # more words in repeated windows: failed
    window: int = 5
    judged_words: int = 20  # fewer: no distance is judged
    char_distance: float = 0.17
    char_slack: float = 0.5  # divided by the square root of the words
    word_spreads: float = 4.0  # above the middle of ordinary documents
    word_sample: int = 30  # fewer ordinary documents of a language and length: all lengths of the language count
    word_reach: float = 0.95  # of the distance without a common word: no higher limit from the length on where
    word_accident: float = 1e-4  # an ordinary text lacks all common words with at most this chance
    ordinary_symbols: float = 0.005  # share of symbols up to which a document counts as ordinary


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def words_of(text: Column) -> Column:
    """Words of a text: runs of characters outside the separators."""
    return F.filter(F.split(F.translate(text, SEPARATORS[1:], " " * (len(SEPARATORS) - 1)), " ", -1), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SEPARATORS, "") != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def window_hashes(words: Column, window: int) -> Column:
    """Hashes of all windows of ``window`` words, from hashes of half the length joined in pairs."""

    def joined(left: Column, right: Column, shift: int, count: Column) -> Column:
        return F.zip_with(F.slice(left, F.lit(1), count), F.slice(right, F.lit(shift + 1), count), lambda a, b: F.xxhash64(a, b))

    def build(ones: Column, length: int, then: Callable[[Column], Column]) -> Column:
        if length == 1:
            return then(ones)
        count = F.greatest(F.size(ones) - (length - 1), F.lit(0))
        if length % 2:
            return build(ones, length - 1, lambda h: let(joined(h, ones, length - 1, count), then))
        return build(ones, length // 2, lambda h: let(joined(h, h, length // 2, count), then))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda ones: build(ones, window, lambda h: h))


def repeated_words(words: Column, window: int) -> Column:
    """Words inside a window of ``window`` words that occurs twice or more among ``words``."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            return F.filter(s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"])))

        places = F.array_sort(F.transform(let(ordered, repeated), lambda x: x["i"]))
        reach = let(places, lambda p: F.transform(p, lambda i, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - i, F.lit(window))).cast("long")))
        return total(reach)

    return let(
        window_hashes(words, window),
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")),
    )


def class_counts(text: Column) -> list[Column]:
    """Characters per class of ``CLASSES``; together all characters."""
    everything = F.char_length(text).cast("long")
    lower, upper, digit = (F.char_length(F.regexp_replace(text, pattern, "")).cast("long") for pattern in (r"\P{Ll}+", r"\P{Lu}+", r"\P{Nd}+"))
    space = everything - F.char_length(F.translate(text, SEPARATORS, ""))
    symbol = everything - F.char_length(F.translate(text, SYMBOLS, ""))
    return [lower, upper, digit, space, symbol, everything - lower - upper - digit - space - symbol]


def _forms(language: str) -> list[str]:
    """Common words as they are written, lower case or with a capital."""
    return [f for w in COMMON_WORDS[language] for f in (w, w.capitalize())]


def common_counts(words: Column, language: Column) -> Column:
    """Occurrences of each common word of the language, as an array in the order of ``COMMON_WORDS``."""
    every = sorted({f for lang in COMMON_WORDS for f in _forms(lang)})
    lists = F.lit(None).cast("array<string>")
    for lang, own in COMMON_WORDS.items():
        lists = F.when(language == lang, F.array(*[F.lit(w) for w in own])).otherwise(lists)
    few = F.transform(F.filter(words, lambda w: w.isin(every)), F.lower)
    return let(few, lambda f: F.transform(lists, lambda c: F.size(F.filter(f, lambda w: w == c)).cast("long")))


def most_likely(words: Column) -> Column:
    """The reference language with most common words in the text; ties by name."""
    def hits(lang: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(_forms(lang))))

    ranked = [F.struct(hits(lang).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, lang in enumerate(sorted(COMMON_WORDS))]
    return F.greatest(*ranked)["lang"]


def measures(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts per document; a null text counts like the empty one. The language is the declared one if there is a reference for it."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    declared = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.when(declared.isin(*COMMON_WORDS), declared).alias("declared"), F.coalesce(~declared.isin(*COMMON_WORDS), F.lit(False)).alias("foreign"))

    def counted(w: Column) -> Column:
        language = F.coalesce(F.col("declared"), most_likely(w))
        return let(
            language,
            lambda lang: F.struct(
                F.size(w).cast("long").alias("n_words"),
                repeated_words(w, limits.window).alias("n_repeat_words"),
                lang.alias("language"),
                common_counts(w, lang).alias("common"),
            ),
        )

    return rows.select(
        "doc_id",
        "foreign",
        let(words_of(F.col("text")), counted).alias("c"),
        F.char_length(F.translate("text", SEPARATORS, "")).cast("long").alias("word_chars"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        F.array(*class_counts(F.col("text"))).alias("classes"),
    ).select(
        "doc_id",
        "foreign",
        F.col("c.n_words").alias("n_words"),
        "word_chars",
        F.get("classes", F.lit(CLASSES.index("symbol"))).alias("n_symbols"),
        "n_dup_lines",
        F.col("c.n_repeat_words").alias("n_repeat_words"),
        F.col("c.language").alias("language"),
        F.col("c.common").alias("common"),
        "classes",
    )


def failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))


def references(measured: DataFrame, limits: Limits = Limits()) -> dict[str, tuple[list[float], list[float]]]:
    """Class and common-word shares per language over all ordinary documents: one row per reference language reaches the driver."""
    ordinary = measured.where(~failed(limits) & (F.col("n_symbols") <= limits.ordinary_symbols * F.col("word_chars")))
    width = len(next(iter(COMMON_WORDS.values())))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(width)] + [F.sum("n_words").alias("n")]
    out = {}
    for r in ordinary.groupBy("language").agg(*sums).collect():
        classes = [r[f"c{i}"] for i in range(len(CLASSES))]
        words = [r[f"w{i}"] for i in range(width)]
        words.append(r["n"] - sum(words))
        out[r["language"]] = ([c / max(1, sum(classes)) for c in classes], [w / max(1, r["n"]) for w in words])
    return out


def distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts and shares that add up to one; null if either is empty."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        own = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
        other = F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
        return (own + other) / 2

    def of(c: Column) -> Column:
        n = total(c)
        parts = F.zip_with(F.transform(c, lambda x: x / n), shares, term)
        value = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), value)))

    return let(counts, of)


def length_class(n: Column) -> Column:
    """Lengths between two powers of two."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def word_limits(rows: DataFrame, found: dict[str, tuple[list[float], list[float]]], limits: Limits = Limits()) -> Column:
    """Largest allowed word distance of a row, from the distances of all judged ordinary documents by language and length.

    A histogram of n words lies about 1 / sqrt(n) from its source, so middle and spread are taken of distance x sqrt(n); one row
    per language and length class (or all lengths) reaches the driver.
    """
    ordinary = rows.where(~failed(limits) & (F.col("n_symbols") <= limits.ordinary_symbols * F.col("word_chars")) & (F.col("n_words") >= limits.judged_words))
    scaled = ordinary.where("word_distance IS NOT NULL AND NOT foreign").select("language", length_class(F.col("n_words")).alias("class"), (F.col("word_distance") * F.sqrt("n_words")).alias("u"))
    middle, high = (F.percentile_approx("u", p, 10_000) for p in (0.5, 0.75))
    laws = scaled.rollup("language", "class").agg(middle.alias("middle"), high.alias("high"), F.count(F.lit(1)).alias("n")).where("language IS NOT NULL").collect()
    allowed = {(r["language"], r["class"]): r["middle"] + limits.word_spreads * (r["high"] - r["middle"]) / 0.6745 for r in laws if r["class"] is None or r["n"] >= limits.word_sample}
    n, out = F.col("n_words"), F.lit(None).cast("double")
    for lang, (_, shares) in sorted(found.items()):
        factor = F.lit(allowed.get((lang, None))).cast("double")
        for (_, size), value in sorted((k, v) for k, v in allowed.items() if k[0] == lang and k[1] is not None):
            factor = F.when(length_class(n) == size, value).otherwise(factor)
        rest = shares[-1]  # words that are not common
        without = math.sqrt(max(0.0, (math.log2(2 / (1 + rest)) + (1 - rest) + (rest * math.log2(2 * rest / (1 + rest)) if rest else 0.0)) / 2))
        least = math.log(limits.word_accident) / math.log(rest) if 0 < rest < 1 else math.inf
        limit = factor / F.sqrt(n)
        out = F.when(F.col("language") == lang, F.when(n >= least, F.least(limit, F.lit(limits.word_reach * without))).otherwise(limit)).otherwise(out)
    return out


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts, both distances and the verdict, one row per document.

    A null or empty text has no words and fails the base rules. A language without a reference counts as the one with most common
    words in the text; where no ordinary document exists for it, no distance is judged, and where it was declared, only the
    characters are: its common words are not known. Repeated rows are judged one by one.
    Other columns are not read; an empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "quality")
    measured = stages.put(measures(docs, limits, id_col, text_col, lang_col))
    classes, words = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
    found = references(measured, limits)
    for lang, (c, w) in sorted(found.items()):
        here = F.col("language") == lang
        classes = F.when(here, F.array(*[F.lit(x) for x in c])).otherwise(classes)
        words = F.when(here, F.array(*[F.lit(x) for x in w])).otherwise(words)
    all_words = F.concat("common", F.array(F.col("n_words") - total(F.col("common"))))
    rows = measured.withColumn("char_distance", distance(F.col("classes"), classes)).withColumn("word_distance", distance(all_words, words))
    noise = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    odd_words = ~F.col("foreign") & (F.col("word_distance") > word_limits(rows, found, limits))
    far = (F.col("char_distance") > limits.char_distance + limits.char_slack * noise) | F.coalesce(odd_words, F.lit(False))
    judged = F.coalesce(far, F.lit(False)) & (F.col("n_words") >= limits.judged_words)
    return rows.withColumn("base_failed", failed(limits)).withColumn("kept", ~failed(limits) & ~judged).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language", "char_distance", "word_distance"
    )
