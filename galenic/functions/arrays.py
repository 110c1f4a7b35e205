"""Functions over array columns: ordered de-duplication, slices and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galenic.functions.text import bound, present, strip


def dedupe_caseless(values: Column) -> Column:
    """First spelling of each value whatever its case; empty and null elements go.

    Values are sorted by lower case and place, the first of each case stays, and what
    stays is sorted by place: n log n, for texts of any number of words.
    """
    full = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    keyed = F.sort_array(F.transform(full, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))))
    firsts = bound(keyed, lambda s: F.filter(s, lambda x, j: (j == 0) | (x["k"] != F.get(s, j - 1)["k"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])


def unique(values: Column) -> Column:
    """Distinct non-empty values in order."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def synonyms(names: Column, most: int = 5) -> Column:
    """The names after the first, distinct whatever their case, at most ``most``."""
    return F.slice(dedupe_caseless(F.slice(names, F.lit(2), F.lit(1 << 30))), 1, most)


def listed(text: Column) -> Column:
    """The non-empty pieces between commas."""
    return F.when(present(text), F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")).otherwise(F.expr("cast(array() as array<string>)"))


def ranks(values: Column) -> Column:
    """array<struct<value, rank>>: the first of n values has rank n."""
    return F.transform(values, lambda v, i: F.struct(v.alias("value"), (F.size(values) - i).alias("rank")))


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))
