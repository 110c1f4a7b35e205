"""Predicates, searches, paging and caps over a table of medicines.

Tables carry ``ord``, the order of their source; "first" means smallest ord.
An empty or null parameter switches a filter off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.functions.classify import category_regions
from galenic.functions.text import empty_as_null
from galenic.functions.arrays import unique
from galenic.functions.vocab import FALLBACK_CATEGORY
from galenic.sources.shared import numbered

#: Rows shown without and with a filter.
STARTER_CAP, FILTERED_CAP = 72, 120
#: Largest page.
LARGEST_PAGE = 10_000


def approved(df: DataFrame, column: str = "approval_status") -> DataFrame:
    return df.where(F.col(column) == "approved")


def by_category(df: DataFrame, category: str | None) -> DataFrame:
    """Equal to the parameter in upper case."""
    return df.where(F.col("atc_category") == F.upper(F.lit(category))) if category else df


def by_phase(df: DataFrame, phase: str | None) -> DataFrame:
    return df.where(F.col("phase") == phase) if phase else df


def by_category_or_default(df: DataFrame, category: str = "all") -> DataFrame:
    """A missing category counts as the fallback; ``all`` is off; case counts."""
    return df if category == "all" else df.where(F.coalesce(empty_as_null(F.col("atc_category")), F.lit(FALLBACK_CATEGORY)) == category)


def resolved_regions(body_region: Column, secondary: Column, category: Column) -> Column:
    """A medicine's own regions, or else those of its category."""
    own = unique(F.concat(F.array(body_region), F.coalesce(secondary, F.expr("cast(array() as array<string>)"))))
    return F.when(F.size(own) > 0, own).otherwise(category_regions(category))


def by_region(df: DataFrame, region: str | None, regions: Column) -> DataFrame:
    return df.where(F.array_contains(regions, region)) if region else df


def _holds(column: Column, query: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(query.lower())), F.lit(False))


def _any_holds(column: Column, query: str) -> Column:
    return F.coalesce(F.exists(column, lambda v: _holds(v, query)), F.lit(False))


def in_fields(query: str, texts: tuple[str, ...] = ("name", "class"), lists: tuple[str, ...] = ("targets", "synonyms")) -> Column:
    """Any field on its own holds the query, whatever the case; null fields hold nothing."""
    return reduce(lambda a, b: a | b, [*(_holds(F.col(f"`{c}`"), query) for c in texts), *(_any_holds(F.col(c), query) for c in lists)])


def search(df: DataFrame, query: str | None, with_indication: bool = False, **fields) -> DataFrame:
    """Field by field; ``with_indication`` looks at the indication as well."""
    if not query:
        return df
    found = in_fields(query, **fields)
    return df.where(found | _holds(F.col("indication"), query) if with_indication else found)


def haystack_of(*columns: Column) -> Column:
    """All non-empty fields, joined by blanks: a query may match across them."""
    return F.concat_ws(" ", *(empty_as_null(c) for c in columns))


def haystack(*columns: Column) -> Column:
    """The joined fields in lower case."""
    return F.lower(haystack_of(*columns))


def search_haystack(df: DataFrame, query: str | None, hay: Column) -> DataFrame:
    query = (query or "").strip().lower()
    return df.where(F.contains(hay, F.lit(query))) if query else df


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The first row of that id; no row if there is none."""
    return df.where(F.col(key) == value).orderBy("ord").limit(1)


def check_page(limit: int, offset: int) -> None:
    """Raises ValueError on a limit outside 1..10,000 or a negative offset."""
    if not 1 <= limit <= LARGEST_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {LARGEST_PAGE} and offset at least 0")


def page(df: DataFrame, limit: int = 100, offset: int = 0, order: str = "ord") -> DataFrame:
    """A page in source order. Raises ValueError on a limit outside 1..10,000 or a negative offset."""
    check_page(limit, offset)
    return df.orderBy(order).offset(offset).limit(limit)


def with_total(df: DataFrame) -> DataFrame:
    """``total``, the number of rows before paging: one small aggregate, joined on."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def capped(df: DataFrame, filtered: bool, order: str = "ord") -> DataFrame:
    return df.orderBy(order).limit(FILTERED_CAP if filtered else STARTER_CAP)


def cap_applies(category: str = "all", region: str | None = None, query: str = "") -> bool:
    """Whether any filter is on. A query of blanks counts here, though it filters nothing."""
    return category != "all" or bool(region) or bool(query)


def toggled(active: str | None, clicked: str, off: str | None = None) -> str | None:
    """Choosing the active value again clears it."""
    return off if active == clicked else clicked


def empty_message(category: str = "all", region: str | None = None, query: str = "") -> str:
    """What to say when nothing is found, by the filters that are on."""
    on = [name for name, used in (("search", query.strip()), ("body region", region), ("category", category != "all")) if used]
    return "No medicines are loaded." if not on else f"No medicines match this {' and '.join(on)}."


def sorted_by_name(df: DataFrame) -> DataFrame:
    """In the order of lower-case names, source order among equals."""
    return df.orderBy(F.lower("name"), "ord")


def numbered_by_name(df: DataFrame, name: str, key: str) -> DataFrame:
    """position, from 1, by lower-case name and then ``key``; no task sorts everything."""
    return numbered(df, [F.lower(name), F.col(key)], "position")
