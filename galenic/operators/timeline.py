"""As-of joins: to each row, the latest earlier row of another table with the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galenic.sources.shared import ranged


def as_of(left: DataFrame, right: DataFrame, key: tuple[str, str], time: tuple[str, str], columns: list[str], tie: str) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` that has its key and stands at or before its time.

    Of rows of ``right`` at one time the one with the largest ``tie`` counts; columns are
    null where there is none, and for a null key or time.  Rows of both tables go by range of
    key and time, so a key of very many rows reaches over several ranges; what a range ends
    with is carried on to the next ones, a row for each range and the keys at its border.
    """
    said = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(columns)))
    row = F.struct(*(F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns)))
    ours = left.select(F.col(key[0]).alias("_key"), F.col(time[0]).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), row.alias("_left"))
    theirs = right.where(F.col(key[1]).isNotNull() & F.col(time[1]).isNotNull())
    theirs = theirs.select(F.col(key[1]).alias("_key"), F.col(time[1]).alias("_time"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), said.alias("_said"))
    order = ["_time", "_side", "_tie"]
    both = ranged(ours.unionByName(theirs, allowMissingColumns=True), ["_key", *order], "timeline")

    before = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_last", F.last("_said", ignorenulls=True).over(before)).where("_side = 1")
    ends = both.groupBy("_key", "_part").agg(F.max_by("_said", F.when(F.col("_side") == 0, F.struct("_time", "_tie"))).alias("_end"))
    several = ends.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_key").alias("_of"))
    ends = ends.join(several, F.col("_key") == F.col("_of"), "left_semi")  # keys that reach over a border
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_key").alias("_of"), F.col("_part").alias("_at"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).where("_carried is not null")
    found = inside.join(carried, (F.col("_key") == F.col("_of")) & (F.col("_part") == F.col("_at")), "left").where("_left is not null")
    value = F.when(F.col("_time").isNotNull(), F.coalesce("_last", "_carried"))
    return found.select(*(F.col(f"_left.l{i}").alias(c) for i, c in enumerate(left.columns)), *(value[f"v{i}"].alias(c) for i, c in enumerate(columns)))
