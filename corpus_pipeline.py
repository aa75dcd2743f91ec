"""From raw documents to packed training sequences: five stages, each an operator of ``redwatch.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents that the stage before kept. All but the last return the
columns of ``docs``, in their order, whatever further columns there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redwatch.llm import language_id, line_dedup, minhash_dedup, packing, substring_dedup
from redwatch.llm.shared import Stages

#: Documents whose best language is less likely than this are rejected.
MIN_SCORE = 0.5


def _as_documents(columns: list[str], row: str, text: str = "text") -> list:
    """Columns of a document from the struct ``row`` and a new text; ``n_chars`` follows the text."""
    fresh = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return [(fresh[c] if c in fresh else F.col(f"{row}.`{c}`")).alias(c) for c in columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose language is uncertain.

    Uncertain is a document with no likely language among the known ones, and one whose n-grams are too rare in its likeliest
    language, compared with all documents of that language: a text in an unknown language, or in none.
    """
    model = language_id.fit(docs)
    rows = language_id.predict(docs.select(F.struct("*").alias("row")), model, text_col="row.text", keep=("row",), detail=True)
    judged = Stages(spark, "language").put(rows, release=True)
    usual = language_id.typical(judged, F.col("row.lang").cast("string"))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE)
    return judged.where(known & ~language_id.misfit(model, usual)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; a document of which nothing is left goes, untouched ones stay as they are."""
    rows = line_dedup.dedup_lines(docs)
    left = rows.where((F.col("n_deleted") == 0) | (F.col("text") != ""))
    return left.select(*_as_documents(docs.columns, "row"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near duplicates (five words, 0.8), that of smallest id; one without an id stays only
    where the group has none with an id. Rows are compared by a number of their own, so copies that share an id, or have none, are
    copies like others; a text without words is in no group.
    """
    tables = Stages(spark, "near")
    rows = tables.put(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")))
    texts = rows.select("key", F.col("row.text").alias("text"))
    found = minhash_dedup.near_duplicates(texts, id_col="key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    found = tables.put(found)
    copies = found.where("key <> group").select("group").distinct()
    members = found.join(tables.put(copies), "group").join(rows.select("key", F.col("row.doc_id").alias("id")), "key")
    members = tables.put(members.select("group", "key", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("place")))
    # one row per group, written before the join with the members, of which one group may have most
    first = tables.put(members.groupBy("group").agg(F.min("place").alias("place")))
    dropped = members.join(first.select("group", F.col("place.key").alias("kept")), "group").where("key <> kept").select("key")
    return rows.join(dropped, "key", "left_anti").select("row.*")


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words under 13-word windows of earlier documents; a document of which no word is left goes."""
    rows = substring_dedup.remove_repeats(docs, 13, with_text=True)
    left = rows.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select(*_as_documents(docs.columns, "rest"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    return packing.pack_documents(docs, 4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_near),
    ("substring_dedup", dedup_substrings),
    ("best_fit_packing", pack),
]

#: The learned and iterative stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again, and goes when the next one is written."""
    tables = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        read, docs = docs, tables.put(stage(spark, docs, sf_dir), release=True)
        tables.drop(read)
    return STAGES[-1][1](spark, docs, sf_dir)
