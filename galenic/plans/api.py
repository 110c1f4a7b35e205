"""The catalogue's routes as functions: each gives the rows of an answer, and their total where it is paged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galenic.functions.text import present
from galenic.operators import facets, filters
from galenic.sources.shared import staged
from galenic.sources.tables import BUNDLE

VERSION = "1.0.0"


@dataclass(frozen=True)
class Answer:
    """``total`` (one row: total) counts what was found, ``drugs`` holds the page."""

    total: DataFrame
    drugs: DataFrame


def _counted(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


def list_drugs(drugs: DataFrame, category: str | None = None, search: str | None = None, phase: str | None = None, limit: int = 100, offset: int = 0) -> Answer:
    """By category, phase and search over name, targets, class and synonyms; a page in source order."""
    found = filters.search(filters.by_phase(filters.by_category(drugs, category), phase), search)
    return Answer(_counted(found), filters.page(found, limit, offset))


def get_drug(drugs: DataFrame, drug_id: str) -> DataFrame:
    """The first record of that id; no row if there is none."""
    return filters.lookup(drugs, "id", drug_id)


def drugs_of_category(drugs: DataFrame, category: str) -> Answer:
    found = drugs.where(F.col("atc_category") == F.upper(F.lit(category)))
    return Answer(_counted(found), found.orderBy("ord"))


def search_drugs(drugs: DataFrame, query: str) -> Answer:
    """As the search of ``list_drugs``, in the indication as well."""
    found = filters.search(drugs, query, with_indication=True)
    return Answer(_counted(found), found.orderBy("ord"))


def categories(drugs: DataFrame) -> DataFrame:
    """code, count by letter."""
    return facets.category_counts(drugs).select(F.col("atc_category").alias("code"), F.col("n").alias("count")).orderBy("code")


def stats(drugs: DataFrame) -> DataFrame:
    """statistic, value, n: total_drugs, unique_companies, unique_targets (null value), and counts by category and phase."""
    one = facets.statistics(drugs)
    whole = one.select(F.explode(F.create_map(F.lit("total_drugs"), "total", F.lit("unique_companies"), "companies", F.lit("unique_targets"), "targets")).alias("statistic", "n"))
    each = [drugs.where(present(F.col(c))).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("statistic"), "value", "n") for name, c in (("categories", "atc_category"), ("phases", "phase"))]
    return whole.select("statistic", F.lit(None).cast("string").alias("value"), "n").union(each[0]).union(each[1])


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The records of a bundle as they are, unchecked, written once and kept: later changes of the file do not show."""
    bundle = spark.read.schema(BUNDLE).json(path, multiLine=True)
    return staged(bundle.select(F.posexplode("drugs").alias("ord", "d")).select(F.col("ord").cast("long").alias("ord"), "d.*"), "snapshot")


def health(kept: DataFrame) -> DataFrame:
    """status, version, drugs_count of a snapshot."""
    return kept.agg(F.lit("ok").alias("status"), F.lit(VERSION).alias("version"), F.count(F.lit(1)).alias("drugs_count"))
