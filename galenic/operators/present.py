"""What a reader is shown: summaries, cards, details and the two reading modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.functions.text import empty_as_null, preview, strip

EXPERT_ONLY = ("class", "molecular_weight", "targets", "inchikey", "parent_drugs", "smiles")


def public_summary(summary: Column, indication: Column, label: Column, category: Column) -> Column:
    """The given summary; else the indication with its region; else region and category."""
    told = strip(F.coalesce(indication, F.lit("")))
    by_indication = F.concat(told, F.lit(" with a primary "), label, F.lit(" context."))
    by_region = F.concat(F.lit("A "), label, F.lit(" therapy in ATC group "), F.coalesce(empty_as_null(category), F.lit("V")), F.lit("."))
    return F.coalesce(empty_as_null(summary), F.when((told != "") & (told != "approved"), by_indication).otherwise(by_region))


def for_mode(df: DataFrame, expert: bool) -> DataFrame:
    """The columns a reader sees; the public mode leaves out the expert's."""
    return df if expert else df.select(*(c for c in df.columns if c not in EXPERT_ONLY))


def weight(c: Column, places: int) -> Column:
    """As text with that many places; 0 counts as missing."""
    return F.when(F.coalesce(c, F.lit(0.0)) != 0, F.format_string(f"%.{places}f", c))


def card(df: DataFrame) -> DataFrame:
    """The short form of a medicine."""
    return df.select(
        "id",
        "name",
        F.coalesce(empty_as_null(F.col("atc_category")), F.lit("V")).alias("category"),
        F.array_join(F.slice(F.coalesce("targets", F.expr("cast(array() as array<string>)")), 1, 2), ", ").alias("targets"),
        weight(F.col("molecular_weight"), 0).alias("weight"),
        F.coalesce(F.nullif("year_approved", F.lit(0)).cast("string"), F.lit("Unknown year")).alias("year"),
        F.coalesce(empty_as_null(F.col("phase")), F.lit("N/A")).alias("phase"),
    )


def detail(df: DataFrame) -> DataFrame:
    """The long form of a medicine."""

    def told(c: str) -> Column:
        return F.coalesce(empty_as_null(F.col(f"`{c}`")), F.lit("N/A"))

    def listed(c: str) -> Column:
        return F.coalesce(empty_as_null(F.array_join(F.col(c), ", ")), F.lit("N/A"))

    return df.select(
        "id",
        "name",
        told("atc_code").alias("code"),
        F.coalesce(weight(F.col("molecular_weight"), 2), F.lit("N/A")).alias("weight"),
        told("phase").alias("phase"),
        F.coalesce(F.nullif("year_approved", F.lit(0)).cast("string"), F.lit("N/A")).alias("year"),
        told("indication").alias("indication"),
        listed("targets").alias("targets"),
        told("company").alias("company"),
        listed("synonyms").alias("synonyms"),
        told("class").alias("class"),
        F.concat(F.lit("Generation "), F.coalesce(F.nullif("generation", F.lit(0)), F.lit(1))).alias("generation"),
        preview(F.col("smiles")).alias("smiles"),
    )


def result_header(df: DataFrame, filtered: bool) -> DataFrame:
    """The line above a result."""
    ending = "matching drugs" if filtered else "drugs available"
    return df.agg(F.concat(F.format_number(F.count(F.lit(1)), 0), F.lit(f" {ending}")).alias("header"))
