"""Queries of what is served from a catalogue: routes, bundles in parts, mergeable statistics,
as-of joins, and the batch with its look-up tables and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galenic.operators import sketches, timeline
from galenic.plans import api
from galenic.plans.catalogue import MEDICINES, medicines, query, table
from galenic.plans.etl import build
from galenic.sources import parts, tables
from galenic.sources.shared import new_path, staged

# -- as-of ---------------------------------------------------------------------------------

_ORDER_TIME = "o_orderdate + INTERVAL 27 YEAR"
_USER = "o_custkey % 150"


@query(
    f"""WITH e AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
    o AS (SELECT o_orderkey, {_USER} AS u, {_ORDER_TIME} AS t FROM orders)
    SELECT o_orderkey, event_id, event_type, value FROM o ASOF LEFT JOIN e ON o.u = e.user_id AND o.t >= e.ts"""
)
def as_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of a user at or before each of their orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_USER).alias("u"), F.expr(f"cast({_ORDER_TIME} as timestamp)").alias("t"))
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = timeline.as_of(o, e, ("u", "user_id"), ("t", "ts"), ["event_id", "event_type", "value"], tie="event_id")
    return found.select("o_orderkey", "event_id", "event_type", "value")


# -- statistics that add up ----------------------------------------------------------------------

_WORDS = "regexp_split_to_array(text, '[ \\n]+')"


@query(
    f"""WITH w AS (SELECT lang, unnest({_WORDS}) AS w FROM documents),
    d AS (SELECT lang AS category, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY GROUPING SETS ((lang), ())),
    v AS (SELECT lang AS category, count(DISTINCT w) AS words FROM w GROUP BY GROUPING SETS ((lang), ()))
    SELECT d.category, n, sources, words, true AS sources_within, true AS words_within, true AS median_within, true AS tail_within FROM d JOIN v ON d.category IS NOT DISTINCT FROM v.category"""
)
def mergeable_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of (language, source), added up by language and over all, held against exact counts and ranks."""
    d = table(spark, sf_dir, "documents").withColumn("words", F.split("text", "[ \\n]+"))
    kept = staged(sketches.sketched(d, F.struct("lang", "source"), {"sources": F.col("source")}, {"words": F.col("words")}, {"size": F.col("n_chars")}), "sketches")
    sets, numbers = ["sources", "words"], ["size"]
    rolled = sketches.united(kept, sets, numbers, F.col("category.lang"))
    rolled = rolled.union(sketches.united(kept, sets, numbers).select(F.lit(None).cast("string").alias("category"), "n", *sets, *numbers))
    told = rolled.select("category", "n", *(sketches.distinct_count(s).alias(f"about_{s}") for s in sets), *(sketches.quantile("size", q).alias(name) for name, q in (("median", 0.5), ("tail", 0.95))))

    sides = lambda df: df.groupingSets([["lang"], []], "lang")
    exact = sides(d.select("lang", "source")).agg(F.count_distinct("source").alias("sources")).withColumnRenamed("lang", "_a")
    words = sides(d.select("lang", F.explode("words").alias("w"))).agg(F.count_distinct("w").alias("words")).withColumnRenamed("lang", "_b")
    both = told.join(exact, F.col("category").eqNullSafe(F.col("_a"))).join(words, F.col("category").eqNullSafe(F.col("_b")))
    ranks = d.select("lang", "n_chars").join(F.broadcast(told.select("category", "median", "tail")), (F.col("category") == F.col("lang")) | F.col("category").isNull())  # a row for each language
    held = ranks.groupBy(F.col("category").alias("_c")).agg(*(F.avg((F.col("n_chars") <= F.col(q)).cast("double")).alias(f"{q}_to") for q in ("median", "tail")), *(F.avg((F.col("n_chars") < F.col(q)).cast("double")).alias(f"{q}_from") for q in ("median", "tail")))
    out = both.join(held, F.col("category").eqNullSafe(F.col("_c")))
    close = lambda s: F.abs(F.col(f"about_{s}") - F.col(s)) <= F.ceil(sketches.ERROR * F.col(s))
    at = lambda q, rank: (F.col(f"{q}_from") <= rank + sketches.RANK_ERROR) & (F.col(f"{q}_to") >= rank - sketches.RANK_ERROR)
    return out.select("category", "n", "sources", "words", close("sources").alias("sources_within"), close("words").alias("words_within"), at("median", 0.5).alias("median_within"), at("tail", 0.95).alias("tail_within"))


# -- bundles in parts --------------------------------------------------------------------------------

_PLACED = "row_number() OVER (ORDER BY lower(name), ord) - 1"


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Documents as records, written as a bundle in parts."""
    d = table(spark, sf_dir, "documents")
    records = d.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.lit("V99XX99").alias("atc_code"), F.upper("lang").alias("atc_category"), F.col("text").alias("indication"))
    path = new_path(spark, "bundle")
    parts.write_parts(records, path, "documents")
    return path


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY lower(source), doc_id) - 1 AS ord, source AS name, upper(lang) AS atc_category, sha256(text) AS digest FROM documents")
def bundle_parts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parts.read_parts(spark, _written(spark, sf_dir))
    return found.select(F.col("id").cast("long").alias("id"), "ord", "name", "atc_category", F.sha2(F.col("indication").cast("binary"), 256).alias("digest"))


@query("SELECT id, ord, total FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY lower(source), doc_id) - 1 AS ord, count(*) OVER () AS total FROM documents) WHERE ord BETWEEN 55 AND 154")
def bundle_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page out of the middle, from the parts it lies in, with the total of the metadata."""
    path = _written(spark, sf_dir)
    total = parts.read_metadata(spark, path).select(F.col("total_drugs").alias("total"))
    return parts.read_page(spark, path, limit=100, offset=55).crossJoin(F.broadcast(total)).select(F.col("id").cast("long").alias("id"), "ord", "total")


# -- routes ----------------------------------------------------------------------------------------------

_CATALOGUE = MEDICINES + ", c AS (SELECT *, CASE ord % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN '' ELSE 'IV' END AS phase FROM m) "


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.expr("CASE ord % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN '' ELSE 'IV' END")
    return medicines(spark, sf_dir).withColumn("phase", phase).withColumn("synonyms", F.array("class")).withColumn("id", F.col("ord").cast("string"))


@query(
    _CATALOGUE
    + """, f AS (SELECT * FROM c WHERE atc_category = 'S' AND phase = 'IV' AND (contains(lower(name), 'in') OR contains(lower(class), 'in')))
    SELECT ord, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY ord LIMIT 20 OFFSET 5"""
)
def api_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = api.list_drugs(catalogue(spark, sf_dir), "s", "IN", "IV", limit=20, offset=5)
    return answer.drugs.select("ord", "name").crossJoin(F.broadcast(answer.total))


@query(_CATALOGUE + ", f AS (SELECT * FROM c WHERE contains(lower(name), 'prom') OR contains(lower(class), 'prom') OR contains(lower(indication), 'prom')) SELECT ord, indication, (SELECT count(*) FROM f) AS total FROM f")
def api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = api.search_drugs(catalogue(spark, sf_dir), "PROM")
    return answer.drugs.select("ord", "indication").crossJoin(F.broadcast(answer.total))


@query(
    _CATALOGUE
    + """SELECT 'total_drugs' AS statistic, NULL AS value, count(*) AS n FROM c
    UNION ALL SELECT 'unique_companies', NULL, count(DISTINCT nullif(company, '')) FROM c
    UNION ALL SELECT 'unique_targets', NULL, count(DISTINCT t) FROM (SELECT unnest(targets) AS t FROM c)
    UNION ALL SELECT 'categories', atc_category, count(*) FROM c WHERE atc_category <> '' GROUP BY 2
    UNION ALL SELECT 'phases', phase, count(*) FROM c WHERE phase <> '' GROUP BY 2"""
)
def api_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.stats(catalogue(spark, sf_dir))


# -- the batch with look-ups and entries ----------------------------------------------------------------

_RAW = (
    "p_partkey as ord", "'approved' as approval_status", "case when p_partkey % 4 = 0 then concat(p_name, ', ', p_brand, ', ', upper(p_name), ', placebo, also ', p_brand) when p_partkey % 8 = 1 then 'placebo' end as trialbench_drug_names",
    "concat(' D', p_partkey) as kegg_drug_id", "concat('C', p_partkey) as kegg_compound_id", "concat('K', p_partkey) as inchikey", "'C' as canonical_smiles", "cast(p_retailprice as string) as molecular_weight",
    "case when p_partkey % 3 = 0 then 'asthma relief, x' end as trialbench_outcomes", "'Phase I' as trialbench_phases",
)
_ENTRY = (
    "concat('ENTRY       ', p_partkey, '  Drug\\nNAME        ', p_name, ' old\\nNAME        ', p_name, ' (JP); other\\n            more\\n', "
    "case when p_partkey % 5 = 0 then 'ATC         A10BA02 N02BE01\\n' else '' end, case when p_partkey % 7 = 0 then 'REMARK      Adopted 1987\\n' else '' end, case when p_partkey % 9 = 0 then 'COMMENT     for pain\\n' else '' end, '///\\n')"
)


@query(
    """WITH a AS (
      SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN 'Named ' || p_name WHEN p_partkey % 4 = 2 THEN 'Compound ' || p_partkey ELSE p_name || ' (JP)' END AS name,
        CASE WHEN p_partkey % 4 = 0 THEN p_brand || '|also ' || p_brand ELSE '' END AS synonyms
      FROM part),
    b AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 -]', '', 'g'), ' +', '-', 'g'), '-') AS base FROM a),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS n FROM b)
    SELECT k AS ord, CASE WHEN n = 1 THEN base ELSE base || '-d' || k END AS id, name, synonyms,
      CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'R99XX99' ELSE 'V99XX99' END WHEN k % 5 = 0 THEN 'A10BA02' WHEN k % 3 = 0 THEN 'R99XX99' ELSE 'V99XX99' END AS atc_code,
      CAST(CASE WHEN k % 2 = 1 AND k % 7 = 0 THEN 19 END AS INT) AS year_approved,
      CASE WHEN k % 2 = 1 AND k % 9 = 0 THEN 'for pain' WHEN k % 3 = 0 THEN 'asthma relief' END AS indication
    FROM n"""
)
def enriched_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial names, else the name tables, else the entries, of which the odd ones also give code and year."""
    p = table(spark, sf_dir, "part")
    raw = p.selectExpr(*_RAW)
    compounds = raw.withColumns({c: F.lit(None).cast("string") for c in tables.COMPOUND_COLUMNS if c not in raw.columns}).withColumn("kegg_drug_id", F.when(F.col("ord") % 2 == 1, F.trim("kegg_drug_id")).otherwise(F.col("kegg_drug_id")))
    drug_names = p.selectExpr("concat('D', p_partkey) as kegg_id", "cast(null as string) as inchikey", "case when p_partkey % 4 = 1 then concat('Named ', p_name) end as name", "p_partkey as ord")
    compound_names = p.selectExpr("cast(null as string) as kegg_id", "concat('K', p_partkey) as inchikey", "case when p_partkey % 4 = 2 then concat('Compound ', p_partkey) end as name", "p_partkey as ord")
    entries = p.select(F.concat(F.lit("D"), "p_partkey").alias("entry_id"), F.expr(_ENTRY).alias("text"))
    found = build(compounds, drug_names, compound_names, entries).drugs
    return found.select("ord", "id", "name", F.array_join("synonyms", "|").alias("synonyms"), "atc_code", "year_approved", "indication")
