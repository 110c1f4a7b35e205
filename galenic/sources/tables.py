"""Reading and writing the catalogue: tab-separated tables, JSON bundles, Parquet.

Every table gets ``ord``, its source order.  Missing columns become null, so
the operators can rely on their inputs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galenic.functions.text import known

COMPOUND_COLUMNS = (
    "approval_status", "trialbench_drug_names", "kegg_drug_id", "kegg_compound_id", "inchikey", "canonical_smiles",
    "molecular_weight", "trialbench_outcomes", "tissues_union", "tissue_scores", "trialbench_phases", "trialbench_nct_ids",
)
NAME_COLUMNS = ("kegg_id", "inchikey", "name")
DRUG = (
    "id string, name string, smiles string, inchikey string, atc_code string, atc_category string, molecular_weight double, "
    "phase string, year_approved int, generation int, indication string, targets array<string>, company string, "
    "synonyms array<string>, `class` string, class_name string, parent_drugs array<string>, clinical_trials array<string>, "
    "body_region string, secondary_body_regions array<string>, public_summary string, kegg_id string, pubchem_cid int, "
    "drugbank_id string, atc_codes array<string>"
)
BUNDLE = (
    f"drugs array<struct<{DRUG.replace(' string', ': string').replace(' double', ': double').replace(' int', ': int').replace(' array', ': array')}>>, "
    "metadata struct<total_drugs: bigint, atc_categories: map<string, bigint>, source: string, kegg_enriched: boolean, local_name_enriched: boolean>"
)
REQUIRED = ("id", "name", "atc_code", "atc_category")
ONTOLOGY = (
    "version string, updated string, "
    "visible_regions array<struct<id: string, display_name: string, icon: string, description: string, internal_nodes: array<string>>>, "
    "internal_ontology map<string, map<string, struct<display_name: string, parent: string>>>, "
    "disease_to_anatomy map<string, struct<region: string, nodes: array<string>>>, placement_authority array<string>"
)


def in_order(df: DataFrame) -> DataFrame:
    """Adds ``ord``: increases along the files in the order they are read."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def conformed(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns as text, absent ones null, every spelling of a missing value null."""
    return df.select(*(known(F.col(f"`{c}`").cast("string")).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_tsv(spark: SparkSession, path: str, columns: Iterable[str] = COMPOUND_COLUMNS) -> DataFrame:
    """A tab-separated table with a header; only the named columns are parsed into the plan."""
    found = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', escape='"', multiLine=False)
    return in_order(conformed(found, columns))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A name table; an absent file is an empty table."""
    try:
        return read_tsv(spark, path, NAME_COLUMNS)
    except AnalysisException:
        schema = T.StructType([*(T.StructField(c, T.StringType()) for c in NAME_COLUMNS), T.StructField("ord", T.LongType())])
        return spark.createDataFrame([], schema)


def usable(each: DataFrame, strict: bool = True) -> DataFrame:
    """Records with all required fields. Strict: one without empties the list; else only such records go."""
    whole = F.lit(True)
    for c in REQUIRED:
        whole = whole & F.col(c).isNotNull()
    if not strict:
        return each.where(whole)
    broken = each.where(~whole).select(F.lit(1).alias("_broken")).limit(1)
    return each.join(F.broadcast(broken), how="left_anti", on=F.col("_broken") == F.lit(1))


def drugs_of(bundle: DataFrame, strict: bool = True) -> DataFrame:
    """The records of a bundle with ``ord``; of broken ones see ``usable``."""
    each = bundle.select(F.posexplode("drugs").alias("ord", "d")).select(F.col("ord").cast("long").alias("ord"), "d.*")
    return usable(each.withColumn("class", F.coalesce("class", "class_name")).drop("class_name"), strict)


def read_bundle(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of a JSON bundle; an absent or unreadable file is an empty list."""
    try:
        bundle = spark.read.schema(BUNDLE).json(path, multiLine=True)
    except AnalysisException:
        bundle = spark.createDataFrame([], BUNDLE)
    return drugs_of(bundle, strict)


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """The ontology as one nested row; none if the file is absent."""
    try:
        return spark.read.schema(ONTOLOGY).json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], ONTOLOGY)


def first_readable(spark: SparkSession, paths: Iterable[str], strict: bool = False) -> DataFrame:
    """The bundle at the first path that exists and has records; empty if none has."""
    last = None
    for path in paths:
        last = read_bundle(spark, path, strict)
        if not last.isEmpty():
            return last
    return last if last is not None else drugs_of(spark.createDataFrame([], BUNDLE))


def first_with_rows(sources: Iterable[Callable[[], DataFrame]]) -> DataFrame | None:
    """The first source that can be read and has rows: embedded records, an API's answer, paths, in the order
    given; None if there is none."""
    for source in sources:
        try:
            found = source()
            if not found.isEmpty():
                return found
        except AnalysisException:
            continue
    return None


def bundle_of(drugs: DataFrame, source: str, kegg_enriched: bool = False, local_names: bool = False, class_name: bool = False) -> DataFrame:
    """One JSON value: the records by lower-case name and source order, and their metadata.

    For hand-over to readers of single files; Parquet is the working format.
    """
    fields = [c for c in drugs.columns if c != "ord"]
    row = F.struct(*(F.col(f"`{c}`").alias("class_name" if class_name and c == "class" else c) for c in fields))
    keyed = drugs.select(F.struct(F.lower("name").alias("k"), F.col("ord").alias("o"), row.alias("d")).alias("r"), "atc_category")
    by_category = keyed.groupBy("atc_category").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("atc_category", "n")))).alias("atc_categories"))
    every = keyed.agg(F.sort_array(F.collect_list(F.struct("r.k", "r.o", "r.d"))).alias("rows"), F.count(F.lit(1)).alias("total_drugs"))
    both = every.crossJoin(F.broadcast(by_category))
    meta = F.struct("total_drugs", "atc_categories", F.lit(source).alias("source"), F.lit(kegg_enriched).alias("kegg_enriched"), F.lit(local_names).alias("local_name_enriched"))
    return both.select(F.to_json(F.struct(F.col("rows.d").alias("drugs"), meta.alias("metadata"))).alias("value"))


def write_bundle(drugs: DataFrame, path: str, *aliases: str, **options) -> None:
    """The bundle as text files in ``path`` and in every alias."""
    bundle = bundle_of(drugs, **options)
    for place in (path, *aliases):
        bundle.coalesce(1).write.mode("overwrite").text(place)


def write_table(drugs: DataFrame, path: str) -> None:
    """The working form: Parquet by category, so that category filters prune folders."""
    drugs.repartition("atc_category").write.mode("overwrite").partitionBy("atc_category").parquet(path)


def as_script(df: DataFrame, variable: str) -> DataFrame:
    """A one-value JSON table as a script that assigns it to a global variable."""
    return df.select(F.concat(F.lit(f"window.{variable} = "), "value", F.lit(";")).alias("value"))


def write_scripts(spark: SparkSession, out: str, drugs: str, ontology: str, drawing: str) -> None:
    """The bundle, the ontology and a drawing (paths) as scripts in ``out``, each one global variable."""
    whole = lambda path: spark.read.text(path, wholetext=True)
    text = F.to_json(F.array("value"))
    quoted = whole(drawing).select(F.substring(text, F.lit(2), F.length(text) - 2).alias("value"))
    for folder, variable, df in (("drugs", "GALENIC_DRUGS_DATA", whole(drugs)), ("body-ontology", "GALENIC_BODY_ONTOLOGY", whole(ontology)), ("human-body-svg", "GALENIC_HUMAN_BODY_SVG", quoted)):
        as_script(df, variable).coalesce(1).write.mode("overwrite").text(f"{out}/{folder}")


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)
