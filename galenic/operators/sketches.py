"""Statistics that add up: sketches kept for each category, joined for any union of them.

A category keeps a HyperLogLog sketch of each set that is counted and a quantile
sketch of each number, of a fixed size each.  Tables of sketches from different
days or shards are united row by row; totals never go back to the records.
Distinct counts are within ``ERROR`` of the exact ones; a quantile is a value whose
rank is within ``RANK_ERROR`` of the one asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct count, size parameter of a quantile sketch.
LG_K, K = 14, 800
#: Bounds that are held with more than 99.9 %: four standard errors of 1.04 / sqrt(2**14), and twice the rank error of k = 800.
ERROR, RANK_ERROR = 0.033, 0.01


def sketched(df: DataFrame, by: Column, distinct: dict[str, Column], lists: dict[str, Column], numbers: dict[str, Column]) -> DataFrame:
    """One row of sketches for each value of ``by``: n, and a column for each name.

    ``distinct`` counts non-null values, ``lists`` the elements of arrays, ``numbers`` are for quantiles.
    """
    rows = df.select(by.alias("category"), *(c.alias(k) for k, c in {**distinct, **lists, **numbers}.items()))
    one = [F.count(F.lit(1)).alias("n")]
    one += [F.hll_sketch_agg(F.col(k), F.lit(LG_K)).alias(k) for k in distinct]
    one += [F.expr(f"kll_sketch_agg_double(cast(`{k}` as double), {K})").alias(k) for k in numbers]
    found = rows.groupBy("category").agg(*one)
    for k in lists:  # elements in an aggregate of their own, as they multiply rows
        each = rows.select("category", F.explode(k).alias("v")).groupBy(F.col("category").alias("_of")).agg(F.hll_sketch_agg("v", F.lit(LG_K)).alias(k))
        found = found.join(each, F.col("category").eqNullSafe(F.col("_of")), "left").drop("_of")
    return found.select("category", "n", *distinct, *lists, *numbers)


def united(sketches: DataFrame, sets: list[str], numbers: list[str], by: Column | None = None) -> DataFrame:
    """Rows of sketches added up by ``by``, or all to one row."""
    merged = [F.sum("n").alias("n"), *(F.hll_union_agg(k).alias(k) for k in sets), *(F.expr(f"kll_merge_agg_double(`{k}`, {K})").alias(k) for k in numbers)]
    if by is None:
        return sketches.agg(*merged)
    return sketches.groupBy(by.alias("category")).agg(*merged)


def distinct_count(sketch: str) -> Column:
    """The number of distinct values, 0 without any."""
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def quantile(sketch: str, rank: float) -> Column:
    return F.expr(f"kll_sketch_get_quantile_double(`{sketch}`, {rank}D)")
