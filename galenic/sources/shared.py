"""Tables written once and read back: where lineage ends and several readers start."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that
    is unset (tests, a local session), one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as written to the shared folder, in folders by the columns ``by``: every
    reader sees the same rows, and a lost executor costs only its own tasks."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def ranged(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` dealt out by range of ``order`` and written, with _part, the number of the range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)


def numbered(df: DataFrame, order: list, out: str, by: str | None = None, name: str = "ranged") -> DataFrame:
    """``out``: the place (long, from 1) of each row in ``order``, or among the rows with the same ``by``.

    Dealt out by range, counted by range and numbered within, so no task sorts
    everything, nor all rows of one value of ``by``.  Rows alike in ``order`` are
    numbered in any order, once for all readers.
    """
    keys = [F.col(by)] if by else []
    dealt = ranged(df, [*keys, *order], name)
    group = ["_part", *([by] if by else [])]
    counts = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    if by:  # only values that reach over more than one range have a start; a row for each range they reach
        several = counts.groupBy(by).agg(F.count(F.lit(1)).alias("_ranges")).where("_ranges > 1").drop("_ranges")
        counts = counts.join(several, counts[by].eqNullSafe(several[by]), "left_semi")
    before = Window.partitionBy(*([by] if by else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_at"), *(F.col(c).alias("_of") for c in [by] if by), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    met = F.col("_part") == F.col("_at")
    if by:
        met = met & F.col(by).eqNullSafe(F.col("_of"))
    found = dealt.withColumn("_row", inside).join(starts, met, "left")
    return found.withColumn(out, F.coalesce("_start", F.lit(0)) + F.col("_row")).select(*df.columns, out)
