"""A bundle in parts: sorted pieces of JSON lines, a manifest of where each begins, and the metadata.

The parts hold the records by lower-case name and source order, each with its
position; no row, task or file holds the catalogue.  The manifest has one row for
each part, so that a page is read from the parts it lies in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galenic.operators.filters import check_page
from galenic.sources.shared import ranged, staged
from galenic.sources.tables import DRUG, usable

MANIFEST = "part int, first bigint, n bigint"
METADATA = "total_drugs bigint, atc_categories map<string, bigint>, source string, kegg_enriched boolean, local_name_enriched boolean"


def write_parts(drugs: DataFrame, path: str, source: str, kegg_enriched: bool = False, local_names: bool = False) -> None:
    """``path``/drugs (a folder for each part), ``path``/manifest and ``path``/metadata."""
    order = [F.lower("name"), F.col("ord")]
    dealt = ranged(drugs, order, "bundle")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    manifest = staged(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n"), "manifest")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    starts = manifest.select("part", "first")
    placed = dealt.withColumn("_row", inside).join(F.broadcast(starts), F.col("_part") == F.col("part")).withColumn("ord", F.col("first") + F.col("_row") - 1)
    placed.select("part", *drugs.columns).write.mode("overwrite").partitionBy("part").json(f"{path}/drugs")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    counts = dealt.groupBy("atc_category").agg(F.count(F.lit(1)).alias("n"))
    by_category = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("atc_category").isNotNull(), F.struct("atc_category", "n")))))  # a row for each category
    flags = [F.lit(source).alias("source"), F.lit(kegg_enriched).alias("kegg_enriched"), F.lit(local_names).alias("local_name_enriched")]
    counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_drugs"), by_category.alias("atc_categories"), *flags).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).json(f"{path}/metadata")


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"ord bigint, {DRUG}, part int").json(f"{path}/drugs").withColumn("class", F.coalesce("class", "class_name")).drop("class_name")


def read_parts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records with ``ord``, their position from 0; as ``tables.drugs_of`` has them of one value."""
    return usable(_records(spark, path).drop("part"), strict)


def read_page(spark: SparkSession, path: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the records in order, from the parts it lies in."""
    check_page(limit, offset)
    found = read_manifest(spark, path).where((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset)).select("part").collect()  # a row for each part at most
    near = _records(spark, path).where(F.col("part").isin([r["part"] for r in found])) if found else _records(spark, path).limit(0)
    return near.where(F.col("ord").between(offset, offset + limit - 1)).drop("part").orderBy("ord")
