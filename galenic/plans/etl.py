"""The batch: raw compounds, name tables and entries -> catalogue, rejects and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galenic.functions import arrays, classify, text
from galenic.functions.vocab import FALLBACK_CODE
from galenic.operators import filters, ids, lookups, regions
from galenic.sources import flatfile
from galenic.sources.shared import staged

NO_LIST = "cast(array() as array<string>)"


@dataclass(frozen=True)
class Catalogue:
    drugs: DataFrame
    rejects: DataFrame
    approved: DataFrame

    def counts(self) -> DataFrame:
        """approved, kept, skipped."""
        kept, all_rows = self.drugs.agg(F.count(F.lit(1)).alias("kept")), self.approved.agg(F.count(F.lit(1)).alias("approved"))
        return all_rows.crossJoin(kept).withColumn("skipped", F.col("approved") - F.col("kept"))


def named(df: DataFrame, drug_names: DataFrame | None, compound_names: DataFrame | None, entries: DataFrame | None) -> DataFrame:
    """Adds name and synonyms: trial names, else the name tables, else the entries."""
    trial = F.when(text.present(F.col("trialbench_drug_names")), arrays.dedupe_caseless(F.transform(text.split_names(F.col("trialbench_drug_names")), text.clean_name)))
    df = df.withColumn("_trial", trial)
    df = df.withColumn("_drug", text.empty_as_null(text.strip(F.col("kegg_drug_id")))).withColumn("_compound", text.empty_as_null(text.strip(F.col("kegg_compound_id")))).withColumn("_inchikey", text.empty_as_null(text.strip(F.col("inchikey"))))
    probes = []
    for ids_of, key, table in (("kegg_id", "_drug", drug_names), ("kegg_id", "_compound", compound_names), ("inchikey", "_inchikey", drug_names), ("inchikey", "_inchikey", compound_names)):
        if table is not None:
            trimmed = table.withColumn(ids_of, text.strip(F.col(ids_of)))
            probes.append((key, lookups.last_names(trimmed, ids_of)))
    if entries is not None:
        by_entry = entries.where(text.present(F.col("name"))).select(F.col("entry_id").alias("key"), "name")
        probes += [("_drug", by_entry), ("_compound", by_entry)]
    df = lookups.coalesced(df, probes, "_looked") if probes else df.withColumn("_looked", F.lit(None).cast("string"))
    df = df.withColumn("name", F.coalesce(F.get("_trial", F.lit(0)), "_looked"))
    return df.withColumn("synonyms", F.when(F.size("_trial") > 0, arrays.synonyms(F.col("_trial"))).otherwise(F.expr(NO_LIST))).drop("_trial", "_looked", "_drug", "_compound", "_inchikey")


def reject_reason(df: DataFrame) -> DataFrame:
    """Adds reason: why a row is skipped, null if it is kept."""
    weight = F.col("molecular_weight")
    reason = (
        F.when(~text.present(F.col("name")), "no name")
        .when(F.col("id") == "", "no id")
        .when(F.col("canonical_smiles").isNull(), "no structure")
        .when(F.col("inchikey").isNull(), "no structure key")
        .when(weight.isNotNull() & weight.try_cast("double").isNull(), "weight is no number")
        .when(regions.unreadable(F.col("tissue_scores")), "scores are unreadable")
    )
    return df.withColumn("reason", reason)


def build(
    compounds: DataFrame,
    drug_names: DataFrame | None = None,
    compound_names: DataFrame | None = None,
    entries: DataFrame | None = None,
    limit: int = 0,
    whole_years: bool = False,
) -> Catalogue:
    """The catalogue of approved compounds. ``limit`` takes the first rows before anything else."""
    approved = filters.approved(compounds)
    if limit:
        approved = approved.orderBy("ord").limit(limit)
    # read three times, for two kinds of names and for facts
    parsed = staged(flatfile.interpret(entries, whole_years), "entries") if entries is not None else None
    rows = named(approved, drug_names, compound_names, parsed).withColumn("id", text.slug(F.col("name")))
    if parsed is not None:
        facts = parsed.select(F.col("entry_id").alias("_entry"), "atc_codes", "year_approved", F.col("indication").alias("_told"))
        rows = rows.join(facts, F.col("kegg_drug_id") == F.col("_entry"), "left").drop("_entry")
    else:
        rows = rows.withColumns({"atc_codes": F.lit(None).cast("array<string>"), "year_approved": F.lit(None).cast("int"), "_told": F.lit(None).cast("string")})
    rows = reject_reason(rows)

    outcomes = F.when(text.present(F.col("trialbench_outcomes")), F.col("trialbench_outcomes"))
    by_text = classify.category_of_indication(outcomes)
    by_tissue = classify.category_of_tissue(F.col("tissues_union"))
    code = F.coalesce(F.get("atc_codes", F.lit(0)), classify.code_of_category(by_text), classify.code_of_category(by_tissue), F.lit(FALLBACK_CODE))
    rows = rows.withColumn("atc_code", code).withColumn("atc_category", F.left("atc_code", F.lit(1)))
    rows = rows.withColumn("_regions", regions.body_regions(F.col("tissue_scores"), F.col("tissues_union"), F.col("trialbench_outcomes"), F.col("atc_category")))
    first_outcome = F.left(text.strip(F.get(F.split(outcomes, ","), F.lit(0))), F.lit(200))
    rows = rows.select(
        "ord",
        "id",
        "name",
        F.col("canonical_smiles").alias("smiles"),
        "inchikey",
        "atc_code",
        "atc_category",
        F.coalesce(F.col("molecular_weight").try_cast("double"), F.lit(0.0)).alias("molecular_weight"),
        classify.phase(arrays.listed(F.col("trialbench_phases"))).alias("phase"),
        "year_approved",
        classify.generation(F.col("year_approved")).alias("generation"),
        F.coalesce(text.empty_as_null(F.col("_told")), first_outcome).alias("indication"),
        F.expr(NO_LIST).alias("targets"),
        F.lit(None).cast("string").alias("company"),
        "synonyms",
        F.lit(None).cast("string").alias("class"),
        arrays.listed(F.col("trialbench_nct_ids")).alias("clinical_trials"),
        F.get("_regions", F.lit(0)).alias("body_region"),
        F.slice("_regions", F.lit(2), F.size("_regions")).alias("secondary_body_regions"),
        text.empty_as_null(text.strip(F.col("kegg_drug_id"))).alias("kegg_id"),
        "atc_codes",
        "reason",
    )
    # written once: a range partitioning reads what it deals out twice, and a condition on reason would be worked out beside the columns it is made of
    rows = staged(rows, "compounds")
    kept = rows.where("reason is null").drop("reason")
    unique = ids.unique_ids(kept, "id", [F.col("kegg_id"), F.col("inchikey")])
    drugs = unique.withColumn("id", F.col("unique_id")).drop("unique_id")
    return Catalogue(drugs, rows.where("reason is not null").select("ord", "name", "reason"), approved)
