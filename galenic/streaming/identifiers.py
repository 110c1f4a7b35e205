"""Unique identifiers on a stream: rows get their names as their files arrive, for good.

Each micro-batch goes through the batch's fixpoint (``operators.ids``) with the names given
so far as taken, and is written as one folder of the table of names.  A batch that is
run again after a failure overwrites its own folder and looks only at earlier ones, so
a restart from the checkpoint neither loses nor doubles a name.  No task holds a base
or the state: names given so far are a table, read by name.

Rows that come in their source order get the names that the batch gives them all
together.  A row behind one that was named before is late: it gets a free name, and
is counted; nothing is renamed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galenic.operators.ids import unique_ids


def names(spark: SparkSession, path: str) -> DataFrame:
    """All rows named so far, with base, unique_id, late and batch."""
    return spark.read.parquet(f"{path}/names")


def _before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    try:
        return names(spark, path).where(F.col("batch") < batch)
    except AnalysisException:  # the first batch
        return None


def named(stream: DataFrame, base: str, parts: list[Column], order: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query that names the rows of ``stream`` into ``path``/names."""

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = _before(spark, path, batch)
        taken = before.select(F.col(base).alias("base"), "unique_id") if before is not None else None
        last = before.agg(F.max(order)).first()[0] if before is not None else None
        found = unique_ids(rows, base, parts, order, taken)
        late = F.coalesce(F.col(order) < F.lit(last), F.lit(False)) if last is not None else F.lit(False)
        found.withColumn("late", late).write.mode("overwrite").parquet(f"{path}/names/batch={batch}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """batch, n of late rows."""
    return names(spark, path).where("late").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
