"""The queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, fingerprint, langid, minhash, mixing, packing, pii, quality, sharding, topk, warc, whiten


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), k=4, percent=80)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.resolve(warc.crawl(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2048, added=True)


def _held(parts: int, which: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == which, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    out = langid.identify(docs, langid.learn(langid.training(docs)))
    return out.select("doc_id", _held(4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_docs(spark, sf_dir), 16)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_fingerprints(_docs(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(_docs(spark, sf_dir)))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0", 5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = quality.learn(docs, quality.training(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score_documents(docs, model).select("doc_id", _held(5, 0).alias("held_out"), "score", "predicted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(align.align(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _docs(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    return mixing.digest(mixing.mix(sizes, F.col("words")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_warc, op3_packing, op4_language, op5_sharding, op6_bpe, op7_pii, op8_topk, op9_fingerprints, op10_quality, op11_alignment, op12_mixing, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op2_warc": warc.SQL, "op12_mixing": mixing.SQL}
