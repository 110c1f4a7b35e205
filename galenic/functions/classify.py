"""Ordered rules as CASE expressions: one pass, generated code, first rule wins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from galenic.functions.text import bound
from galenic.functions.vocab import CATEGORY_REGIONS, CODE_SUFFIX, FALLBACK_REGION, INDICATION_RULES, REGION_RULES, TISSUE_RULES

#: Word boundaries for letters of every script, alike in all regular expression dialects.
BEFORE, AFTER = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def first_match(rules: Iterable[tuple[str, Column]]) -> Column:
    """The value of the first rule whose condition holds, else null."""
    return reduce(lambda out, rule: out.when(rule[1], F.lit(rule[0])), rules, F.when(F.lit(False), F.lit(None).cast("string")))


def holds_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def category_of_indication(text: Column) -> Column:
    lowered = F.lower(text)
    return first_match((cat, holds_any(lowered, words)) for cat, words in INDICATION_RULES)


def code_of_category(category: Column) -> Column:
    return F.concat(category, F.lit(CODE_SUFFIX))


def category_of_tissue(text: Column) -> Column:
    lowered = F.lower(text)
    return first_match((cat, F.contains(lowered, F.lit(word))) for word, cat in TISSUE_RULES)


def region_of_text(text: Column) -> Column:
    """Keywords with a blank anywhere, the others as whole words."""

    def rule(lowered: Column, words: tuple[str, ...]) -> Column:
        whole = [w for w in words if " " not in w]
        tests = [F.contains(lowered, F.lit(w)) for w in words if " " in w]
        # a plain search first: most texts hold none of the words, and need no regular expression
        return reduce(lambda a, b: a | b, [*tests, holds_any(lowered, whole) & lowered.rlike(f"{BEFORE}({'|'.join(whole)}){AFTER}")])

    return bound(F.lower(text), lambda lowered: first_match((region, rule(lowered, words)) for region, words in REGION_RULES))


def generation(year: Column) -> Column:
    """1 to 4 by decades; unknown and 0 count as the first."""
    return F.when(F.coalesce(year, F.lit(0)) < 1970, 1).when(year < 1990, 2).when(year < 2010, 3).otherwise(4)


def phase(phases: Column) -> Column:
    """Of a list of trial phases: III and IV count as IV, and so does nothing known."""

    def has(p: str) -> Column:
        return F.coalesce(F.array_contains(phases, p), F.lit(False))

    return F.when(has("Phase III") | has("Phase IV"), "IV").when(has("Phase II"), "II").when(has("Phase I"), "I").otherwise("IV")


def category_regions(category: Column) -> Column:
    """The regions of a category; those of an unknown one are the fallback's."""
    table = F.create_map(*(x for k, v in CATEGORY_REGIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, category), F.array(F.lit(FALLBACK_REGION)))
