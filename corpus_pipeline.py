"""From raw documents to packed sequences: five stages, each one of the operators of glyphward.llm.

All but the last return the columns of documents, as do tables with further columns, which are carried along. In each stage
null and empty texts, repeated rows, rows without a doc_id and empty tables have the results that its operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphward.llm import langid, minhash, packing, pii, quality
from glyphward.llm.runtime import stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; narrow margins go."""
    return langid.accepted(docs, langid.learn(langid.training(docs)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry score puts above its quantile cut, learned from labels of these documents."""
    model = quality.learn(docs, quality.training(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, similarity 0.8."""
    return minhash.one_of_each(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it generalised."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all tokens in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, added=True)


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", pack)]

#: SQL can express none of the first two stages, on which all others depend; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
