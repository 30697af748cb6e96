"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, licenses, line_dedup, mixing, near_dup, phrases, pii, quality, token_alignment, token_count, token_store, url_filter
from .shared import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"])


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir)).select("doc_id", "class_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digest(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), ["doc_id"])


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir), ["doc_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), ["doc_id"])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_url_filter": op3_url_filter,
    "op4_near_dup": op4_near_dup,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_store": op6_token_store,
    "op7_quality": op7_quality,
    "op8_token_count": op8_token_count,
    "op9_licenses": op9_licenses,
    "op10_mixing": op10_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op7_quality": quality.oracle_sql(),
    "op9_licenses": licenses.oracle_sql(),
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_line_dedup": line_dedup.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
