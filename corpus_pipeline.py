"""A training corpus from raw documents: five stages, each one operator, each written and read again.

quality classifier -> line dedup -> MinHash near-dedup -> mixing -> byte-level BPE.
Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galenic.llm import bpe, lines, minhash, mixing, quality
from galenic.llm.common import load, small_batches, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    A null or empty text gets the score of the curve at 0; without labels of both classes
    nothing goes; rows that repeat a doc_id are judged by their own texts; all columns stay as they are.
    """
    return quality.accepted(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that stand earlier in the corpus.

    A document that loses lines and has no word left goes: all it held stands
    elsewhere.  Null texts and texts that were empty before stay, lines of under 20
    characters too; a document of which some lines are left stays with those.
    """
    small_batches(spark)
    found = lines.cleaned(docs.withColumnsRenamed({c: f"own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}))
    bare = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(" \t\n\x0b\f\r")) == "")
    found = found.where(~F.coalesce(bare, F.lit(False))).drop("n_lines", "n_dropped")
    return found.withColumnsRenamed({f"own_{c}": c for c in ("n_lines", "n_dropped") if c in docs.columns}).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 80 % of the shingles of five words shared.

    The smallest doc_id stays; of rows that share it, other texts are judged for themselves;
    texts without words and rows without a doc_id stay.
    """
    small_batches(spark)
    return minhash.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is one of its own; null and empty texts count 0 words and are placed all
    the same; equal rows are one place for each.
    """
    small_batches(spark)
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each row, and of the bytes they decode to; null and empty texts have none."""
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The classifier and the encoder are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
