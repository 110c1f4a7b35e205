"""The queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galenic.llm import bpe, embeddings, importance, licenses, lines, minhash, mixing, periodic, pii, quality, sharding, syncmers, toxicity
from galenic.llm.common import load


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(load(spark, sf_dir, "embeddings"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.cleaned(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(load(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(load(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(load(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic(load(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), most=1)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detect(load(spark, sf_dir, "documents"), rewritten=True)


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_lines": op2_lines,
    "op3_toxicity": op3_toxicity,
    "op4_syncmers": op4_syncmers,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_minhash": op9_minhash,
    "op10_bpe": op10_bpe,
    "op11_importance": op11_importance,
    "op12_licenses": op12_licenses,
    "op13_periodic": op13_periodic,
}

ORACLE_SQL = {
    "op1_embeddings": embeddings.SQL,
    "op2_lines": lines.SQL,
    "op5_sharding": sharding.SQL,
    "op8_mixing": mixing.SQL,
    "op9_minhash": minhash.SQL,
    "op11_importance": importance.SQL,
    "op12_licenses": licenses.SQL,
    "op13_periodic": periodic.SQL,
}
