"""The corpus pipeline: five stages, each reading what the one before wrote.

Defined results, of every stage: an empty table gives none; repeated rows, and rows with equal ``doc_id``, are judged each by itself until near
duplicates are taken out, where rows of one ``doc_id`` are one document; a very long text is taken whole; columns other than those that
a stage decides on, of whatever name, come through as they are (``n_chars`` follows the text). Nulls: a null text is of no
known language and goes in the first stage; a document without ``doc_id`` stays only if nothing like it has one; a null
``source`` is a source of its own, the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from taintlake.llm import langid, mixing, packing, quality, simhash
from taintlake.llm.common import documents, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of 0.4 or more; ties go by the name of the language."""
    return langid.keep_known(docs, langid.fit(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; one that keeps no word is gone."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest ``doc_id``; texts of equal shingles are ties."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares; a document comes once for each pass that takes some of it."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences; empty text is the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("quality", rules),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Fingerprints, permutations and tokenizers are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        place = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
