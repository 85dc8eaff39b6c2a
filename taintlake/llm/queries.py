"""The registered queries ``opN_<name>``: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import digest, langid, licenses, mixing, packing, quality, simhash, tokenbin, tokencount, warc
from .common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), with_text=False).drop("clean_text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_next(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_simhash_near_dedup,
        op3_language_id,
        op4_warc,
        op5_token_files,
        op6_quality_rules,
        op7_license_scan,
        op8_token_counts,
        op9_fingerprints,
        op10_best_fit_packing,
    )
}

ORACLE_SQL: dict[str, str] = {}
