"""Body regions of a compound, by the first source that yields any."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galenic.functions.arrays import listed, ranks
from galenic.functions.classify import category_regions, region_of_text
from galenic.functions.text import bound, present


def score_map(text: Column) -> Column:
    """A JSON object as map<string, string>; anything unreadable is empty."""
    parsed = F.when(present(text), F.from_json(text, "map<string,string>"))
    return F.coalesce(parsed, F.expr("cast(map() as map<string,string>)"))


def _hits(pairs: Column) -> Column:
    """array<struct<region, score>> of the pairs (value, score) whose value names a region."""
    found = F.transform(pairs, lambda p: F.struct(region_of_text(p["value"]).alias("region"), p["score"].alias("score")))
    return F.filter(found, lambda p: p["region"].isNotNull())


def _ordered(hits: Column) -> Column:
    """Regions by their largest score, which is at least 0; ties by name."""

    def by_score(hits: Column) -> Column:
        def best(region: Column) -> Column:
            scores = F.transform(F.filter(hits, lambda h: h["region"] == region), lambda h: h["score"])
            return F.struct((-F.greatest(F.lit(0.0), F.array_max(scores))).alias("less"), region.alias("region"))

        names = F.array_distinct(F.transform(hits, lambda h: h["region"]))
        return F.transform(F.array_sort(F.transform(names, best)), lambda b: b["region"])

    return bound(hits, by_score)


def body_regions(scores: Column, tissues: Column, outcomes: Column, category: Column) -> Column:
    """Regions, the primary one first: by scored tissues, else by the order of
    listed tissues, else by the outcomes' text, else by the category."""
    scored = F.transform(F.map_entries(score_map(scores)), lambda e: F.struct(e["key"].alias("value"), e["value"].try_cast("double").alias("score")))
    in_order = F.transform(ranks(listed(tissues)), lambda r: F.struct(r["value"].alias("value"), r["rank"].cast("double").alias("score")))
    tiers = [_ordered(_hits(scored)), _ordered(_hits(in_order))]
    whole = F.array_compact(F.array(region_of_text(outcomes)))
    # each tier is computed once, and only where those before it are empty
    return F.coalesce(*(bound(t, lambda found: F.when(F.size(found) > 0, found)) for t in (*tiers, whole)), category_regions(category))


def unreadable(scores: Column) -> Column:
    """Rows to reject: JSON that is no object, or a score that is no number for a tissue of some region."""
    head = F.left(F.ltrim(scores), F.lit(1))
    wrong_kind = F.try_parse_json(scores).isNotNull() & (head != "{")
    hits = F.filter(F.map_entries(score_map(scores)), lambda e: region_of_text(e["key"]).isNotNull())
    return F.coalesce(present(scores) & (wrong_kind | F.exists(hits, lambda e: e["value"].try_cast("double").isNull())), F.lit(False))
