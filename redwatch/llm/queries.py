"""Registered queries of the dealt operators, on the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _line_oracle() -> str:
    from . import line_dedup

    return line_dedup.oracle()


def _manifest_oracle() -> str:
    from . import merkle_manifest

    return merkle_manifest.ORACLE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    rows = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    return language_id.identify(table(spark, sf_dir, "documents"))


@register
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filters

    return url_filters.judge(table(spark, sf_dir, "pages"))


@register
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash_dedup

    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@register
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 13)


@register
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("language", "char_distance", "word_distance")


@register
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


@register
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), 4096)


@register
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentencepiece_codec

    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), with_ids=False)


@register
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_deleted", F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle_manifest

    return merkle_manifest.audited(table(spark, sf_dir, "documents"))


@register
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import importance_resampling

    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


@register
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.stored_ids(table(spark, sf_dir, "documents"))


ORACLES["op1_line_dedup"] = _line_oracle()
ORACLES["op11_merkle_manifest"] = _manifest_oracle()
