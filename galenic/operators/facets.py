"""Counts: by category, phase and region, and one-row statistics.

Each facet is one partial aggregation; dimensions are small fixed tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.functions.text import empty_as_null, present
from galenic.functions.vocab import CATEGORIES, PHASES, REGIONS, regions


def counts(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def category_counts(df: DataFrame) -> DataFrame:
    """Non-empty categories and their counts, by letter."""
    return counts(df.where(present(F.col("atc_category"))), F.col("atc_category"), "atc_category").orderBy("atc_category")


def statistics(df: DataFrame) -> DataFrame:
    """total, companies (distinct, non-empty) and targets (distinct; empty ones count)."""
    targets = df.select(F.explode("targets").alias("t")).agg(F.count_distinct("t").alias("targets"))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(empty_as_null(F.col("company"))).alias("companies")).crossJoin(F.broadcast(targets))


def region_facet(df: DataFrame, resolved: Column) -> DataFrame:
    """Every region with its number of medicines, zeros included."""
    found = counts(df.select(F.explode(resolved).alias("r")), F.col("r"), "region")
    dim = regions(df.sparkSession)
    return F.broadcast(dim).join(found, "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"))


def region_category_facet(df: DataFrame, resolved: Column, category: Column) -> DataFrame:
    """All facets and previews at once: medicines by region and category."""
    each = df.select(F.explode(resolved).alias("region"), category.alias("category"))
    return each.groupBy("region", "category").agg(F.count(F.lit(1)).alias("n"))


#: Facets of the cube, in the order of the bits of ``gid``.
FACETS = ("category", "region", "phase")


def facet_cube(df: DataFrame, resolved: Column, category: Column, phase: Column) -> DataFrame:
    """category, region, phase, gid, n: medicines by every combination of facets, all at once.

    A facet that a row does not look at is null and has its bit in ``gid`` (category 4,
    region 2, phase 1); a medicine of several regions counts once where region is not
    looked at.  Every known value is there, zeros included: rows of the dimensions
    take part with a count of 0, so one Expand and one shuffle make the whole cube.
    """
    spark = df.sparkSession
    known = [spark.createDataFrame([(v,) for v in values], f"{name} string") for name, values in zip(FACETS, ([c for c, *_ in CATEGORIES], [r for r, *_ in REGIONS], PHASES), strict=True)]
    zeros = known[0].crossJoin(F.broadcast(known[1])).crossJoin(F.broadcast(known[2])).select("category", F.array("region").alias("_regions"), "phase", F.lit(0).alias("_one"))
    held = df.select(category.alias("category"), F.array_distinct(resolved).alias("_regions"), phase.alias("phase"), F.lit(1).alias("_one"))
    each = held.unionByName(zeros)
    # one entry stands for all regions, so the region is no grouping set of its own
    place = lambda whole, r: F.struct(F.lit(whole).alias("whole"), r.cast("string").alias("region"))
    each = each.select("category", F.explode(F.concat(F.array(place(1, F.lit(None))), F.transform("_regions", lambda r: place(0, r)))).alias("place"), "phase", "_one")
    sets = [["place", *kept] for kept in (["category", "phase"], ["category"], ["phase"], [])]
    found = each.groupingSets(sets, "place", "category", "phase").agg(F.grouping("category").alias("_c"), F.grouping("phase").alias("_p"), F.sum("_one").alias("n"))
    return found.select("category", "place.region", "phase", (4 * F.col("_c") + 2 * F.col("place.whole") + F.col("_p")).cast("int").alias("gid"), "n")


def facet(cube: DataFrame, *names: str, **active: str) -> DataFrame:
    """One facet, or preview, of a cube: counts by ``names`` under the ``active`` values of others."""
    looked_at = {*names, *active}
    gid = sum(bit for bit, name in zip((4, 2, 1), FACETS, strict=True) if name not in looked_at)
    found = cube.where(F.col("gid") == gid)
    for name, value in active.items():
        found = found.where(F.col(name) == value)
    return found.select(*names, "n")


def summary(df: DataFrame, n_categories: int, n_regions: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("medicines"), F.lit(n_categories).cast("long").alias("categories"), F.lit(n_regions).cast("long").alias("regions"))


def report(df: DataFrame, names: DataFrame) -> DataFrame:
    """Lines of the progress report: category, name padded to 40, count padded to 4."""
    found = counts(df, F.col("atc_category"), "category").join(F.broadcast(names), "category", "left")
    return found.select("category", F.format_string("%s - %-40s %4d", "category", F.coalesce("long_name", F.lit("Unknown")), "n").alias("line"))
