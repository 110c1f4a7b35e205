"""Compound tables as they arrive: the row-wise part of the batch on a stream.

Classification needs one row only, so it runs unchanged on a stream.  Unique
identifiers depend on all rows before, so they stay with the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galenic.functions import arrays, classify
from galenic.functions.vocab import FALLBACK_CODE
from galenic.operators.filters import approved
from galenic.operators.regions import body_regions
from galenic.sources.tables import COMPOUND_COLUMNS, conformed


def compounds(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of tab-separated files that appear in ``folder``; all have the full header."""
    schema = ", ".join(f"{c} string" for c in COMPOUND_COLUMNS)
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).csv(folder, sep="\t", header=True)
    return conformed(found, COMPOUND_COLUMNS)


def classified(rows: DataFrame) -> DataFrame:
    """inchikey, atc_code, atc_category, regions, phase of approved rows, batch or stream."""
    outcomes = F.col("trialbench_outcomes")
    code = F.coalesce(classify.code_of_category(classify.category_of_indication(outcomes)), classify.code_of_category(classify.category_of_tissue(F.col("tissues_union"))), F.lit(FALLBACK_CODE))
    found = approved(rows).withColumn("atc_code", code).withColumn("atc_category", F.left("atc_code", F.lit(1)))
    places = body_regions(F.col("tissue_scores"), F.col("tissues_union"), outcomes, F.col("atc_category"))
    return found.select("inchikey", "atc_code", "atc_category", places.alias("regions"), classify.phase(arrays.listed(F.col("trialbench_phases"))).alias("phase"))


def category_counts(rows: DataFrame) -> DataFrame:
    """Running counts by category: one number of state for each of the letters."""
    return classified(rows).groupBy("atc_category").agg(F.count(F.lit(1)).alias("n"))
