"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Documents of a source are laid on a line, each as long as its expected number
of copies; one random offset shifts a ruler with a mark at every integer, and
a document is taken once per mark that falls on it.  The line is ordered by
size, so the words taken come near the target and not only the documents.

No task holds a source: positions come from counts of (source, size),
counts of hash cells inside those, and a rank inside one cell.

Edge cases: a null text has size 0 and is placed like any other; a null source
is a source of its own and the last one; documents of a source without words
have target 0 and are not taken; an empty table gives an empty result; rows
that repeat a doc_id are placed row by row; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galenic.llm.common import WORD, staged

#: Rows that a hash cell of one (source, size) holds at most, if all rows had one source and size.
CELL_ROWS = 2048


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(key, source_size) -> with target: ``share`` of all sizes by weight, none above ``cap`` times its size.

    Sources with the least room for their weight are filled first; what they
    leave goes to the others by weight.  One row per source, so the windows
    run over the few sources.
    """
    in_order = Window.orderBy("key")
    cycle = F.array(*map(F.lit, weights))
    w = sources.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))).cast("long"))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.orderBy(F.col("most") / F.col("weight"), "key").rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    w = w.withColumn("level", (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(here))
    w = w.withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    w = w.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    return w.select("key", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def systematic(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    marked: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of ``docs``; with ``marked`` source and a hash of the text as well."""
    own = ["source", "mark"] if marked else []
    marks = [F.xxhash64("text").alias("mark")] if marked else []
    base = docs.select("doc_id", *own[:1], source_key(F.col("source")).alias("key"), words(F.col("text")).alias("size"), *marks)
    base = staged(base.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "sizes")
    digits = max(1, min(8, math.ceil(math.log(max(1, base.count() / CELL_ROWS), 16))))
    base = base.withColumn("cell", F.substring("hash", 1, digits))

    cells = staged(base.groupBy("key", "size", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = cells.groupBy("key", "size").agg(F.sum("n").alias("n"))
    below = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "size", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("size_start"))
    left = Window.partitionBy("key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("key", "size", "cell", F.coalesce(F.sum("n").over(left), F.lit(0)).alias("cell_start")).join(sizes, ["key", "size"])
    starts = starts.select("key", "size", "cell", (F.col("size_start") + F.col("cell_start")).alias("start"))

    sources = targets(cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    inside = Window.partitionBy("key", "size", "cell").orderBy("hash", "doc_id")
    placed = base.withColumn("rank", F.row_number().over(inside)).join(starts, ["key", "size", "cell"]).join(sources, "key")
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("key")).cast("binary")), 1, 4), 16, 10).cast("long") + 0.5) / 65536
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("start") + F.col("rank")
    placed = placed.withColumn("copies", F.floor(at * expected + offset) - F.floor((at - 1) * expected + offset))
    return placed.select("doc_id", *own, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken.  Rows of one
    doc_id, source and text share what their places are given: the first of them
    comes as often as all are taken together."""
    key = F.struct("doc_id", "source", F.xxhash64("text").alias("mark"))
    placed = systematic(docs.select("doc_id", "source", "text"), **options, marked=True)
    copies = placed.groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("copies")).where("copies > 0")
    copies = copies.select(F.struct("doc_id", "source", "mark").alias("k"), "copies")
    out = docs.select(key.alias("k"), F.struct(*docs.columns).alias("row")).dropDuplicates(["k"]).alias("d").join(copies.alias("c"), F.col("d.k").eqNullSafe(F.col("c.k")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY key),
weighted AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY key) - 1) % 3 AS INT) + 1] AS weight, source_size * 2.0::DOUBLE AS most,
    CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS goal
  FROM sources),
levels AS (
  SELECT *, (goal - coalesce(sum(most) OVER (ORDER BY most / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY most / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted),
opened AS (SELECT *, max(CASE WHEN level * weight < most THEN level END) OVER () AS final FROM levels),
goals AS (SELECT key, source_size, least(most, coalesce(final * weight, most)) AS target FROM opened),
placed AS (
  SELECT doc_id, key, size, row_number() OVER (PARTITION BY key ORDER BY size, md5(CAST(doc_id AS VARCHAR)), doc_id) AS pos FROM base),
ruled AS (
  SELECT doc_id, size, source_size, target, pos,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
    (CAST('0x' || substr(md5('mix' || key), 1, 4) AS BIGINT) + 0.5::DOUBLE) / 65536 AS u
  FROM placed JOIN goals USING (key))
SELECT doc_id, size, source_size, target,
  CAST(floor(pos * e + u) - floor((pos - 1) * e + u) AS BIGINT) AS copies,
  CAST((floor(pos * e + u) - floor((pos - 1) * e + u)) * size AS BIGINT) AS taken
FROM ruled
"""
