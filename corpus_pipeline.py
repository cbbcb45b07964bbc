"""From raw documents to token ids: five stages, each a table for the next.

Defined results: null and empty texts, and texts without a recognised language, go at the first stage; a
null id is kept as long as its text is; rows of one id are one document for near-dedup, and stand or fall
there with it, and are judged one by one elsewhere; extra columns are carried up to the last stage; an
empty table gives an empty result.  A stage's table is dropped when the next one is written; the one
that the last stage reads stays for the caller in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm import bpe, language, near_dedup, tiling, toxicity
from codeatlas.llm.common import Stored, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language."""
    return language.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of a median severity above 0, by a model of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest id."""
    return near_dedup.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover at least half of a benchmark item."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and proves the round trip."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxic),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("BPE", byte_bpe),
]

#: No stage but near-dedup can be said in SQL; tests/llm holds the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            kept = Stored(stage(spark, docs, sf_dir), "stage").keep()
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
