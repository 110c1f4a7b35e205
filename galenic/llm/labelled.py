"""What the two text classifiers share: a bounded sample of labelled rows, and scoring in Arrow batches.

A sample takes, of each class, up to a stated number of labelled documents, and
of characters in them, outside the held-out fold, in the order of a hash of
their id; so what is trained on is bounded in rows and in bytes.  Nulls in the
label leave a row unlabelled; a doc_id labelled twice counts with its larger
label; labels of absent documents and documents without labels do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galenic.llm.common import crc_fold

#: Rows turned into Python objects at once.
SLICE = 256


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars_per_class: int) -> DataFrame:
    """doc_id, text, label of at most ``per_class`` labelled rows of either class,
    whole texts, up to the one with which they reach ``chars_per_class`` characters."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).where(crc_fold(F.col("doc_id")) != 0)
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = [rows.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    ids = picked[0].union(picked[1])  # at most 2 * per_class rows
    sizes = docs.select("doc_id", F.length("text").alias("n")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("label").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ids = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < chars_per_class).select("doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def scored(docs: DataFrame, score: Callable[[], Callable[[str], float]], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; ``score()``
    makes, in the worker, the function from a whole text to its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values = [of(text or "") for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select(
        "doc_id",
        (F.coalesce(crc_fold(F.col("doc_id")), F.lit(-1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def passing(docs: DataFrame, score: Callable[[], Callable[[str], float]], threshold: float) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield part.filter(pa.array([of(text or "") >= threshold for text in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
