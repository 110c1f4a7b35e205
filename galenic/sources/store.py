"""A store of fetched entries: what is there is not asked for again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galenic.sources.flatfile import missing
from galenic.sources.shared import staged

ENTRY = "entry_id string, text string"


def _all(spark: SparkSession, path: str) -> DataFrame:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{ENTRY}, batch int")
    return spark.read.schema(f"{ENTRY}, batch int").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, text: of entries saved more than once the last; an absent store is empty."""
    return _all(spark, path).groupBy("entry_id").agg(F.max_by("text", "batch").alias("text"))


def save(entries: DataFrame, path: str) -> None:
    """Adds entries (entry_id, text) as a batch of their own; those with an id that is there replace it."""
    spark = entries.sparkSession
    last = _all(spark, path).agg(F.max("batch")).first()[0]
    rows = entries.where(F.col("entry_id").isNotNull()).select("entry_id", "text", F.lit(0 if last is None else last + 1).alias("batch"))
    rows.write.mode("append").partitionBy("batch").parquet(path)


def completed(spark: SparkSession, path: str, ids: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The entries of ``ids`` (entry_id), of which those not in the store are fetched, and saved, first.

    ``fetch`` gives entry_id and text of the ids it is handed; ids that it does not find are asked for again next time.
    """
    wanted = staged(missing(ids.where(F.col("entry_id").isNotNull()), load(spark, path)), "missing")
    if not wanted.isEmpty():
        save(fetch(wanted), path)
    return load(spark, path).join(ids.select("entry_id").distinct(), "entry_id", "left_semi")
