"""Queries of the operators with a structure of their own: search index, rules as data,
identifiers as a fixpoint, the facet cube and paths through the ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galenic.functions import vocab
from galenic.operators import facets, filters, ids, lookups, rules, textindex
from galenic.plans.catalogue import MEDICINES, medicines, query, resolved, table

# -- search by index -------------------------------------------------------------------

#: name, query: across fields and words, inside a word, over a line break, too short for the index, nowhere.
SEARCHES = (
    ("two pieces", "rights reserved"),
    ("inside", "  ESERVe "),
    ("line break", ".\nlicensed under the apache"),
    ("one long piece", "of the li"),
    ("short", "ñj"),
    ("nowhere", "no such text"),
)
_HAY = "contains(lower(concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(text, ''))), '{q}')"
_ANY = "contains(lower(source), '{q}') OR contains(lower(lang), '{q}')"


@query(
    " UNION ALL ".join(f"SELECT '{name}' AS query, doc_id FROM documents WHERE " + _HAY.format(q=q.strip().lower()) for name, q in SEARCHES)
    + f" UNION ALL SELECT 'fields' AS query, doc_id FROM documents WHERE {_ANY.format(q='src1')}"
    + f" UNION ALL SELECT 'indication' AS query, doc_id FROM documents WHERE {_ANY.format(q='@mail1')} OR contains(lower(text), '@mail1')"
)
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three searches, each answered by the index over the documents."""
    d = table(spark, sf_dir, "documents")
    hay = filters.haystack_of(F.col("source"), F.col("lang"), F.col("text"))
    index = textindex.build(d.select("doc_id", "source", "lang", "text"), "doc_id", hay)
    found = []
    for name, q in SEARCHES:
        q = q.strip().lower()
        found.append((name, textindex.search_indexed(index, q, F.contains(F.lower(hay), F.lit(q)))))
    fields = filters.in_fields("SRC1", texts=("source", "lang"), lists=())
    found.append(("fields", textindex.search_indexed(index, "SRC1", fields)))
    more = filters.in_fields("@mail1", texts=("source", "lang", "text"), lists=())
    found.append(("indication", textindex.search_indexed(index, "@mail1", more)))
    out = None
    for name, rows in found:
        rows = rows.select(F.lit(name).alias("query"), "doc_id")
        out = rows if out is None else out.union(rows)
    return out


# -- rules as data ------------------------------------------------------------------------

#: Parts of words that generated keywords are made of, and how many rules there are.
SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as")
N_RULES = 20_000
_K = len(SYLLABLES)


def generated_rules(spark: SparkSession) -> DataFrame:
    """20,000 rules by formula: three syllables in a row; every tenth with a blank, every hundredth a whole word of two."""
    s = F.array(*map(F.lit, SYLLABLES))
    i = F.col("id")
    at = lambda k: F.get(s, (F.floor(i / _K**k) % _K).cast("int"))
    keyword = F.when(i % 10 == 0, F.concat(at(0), at(1), F.lit(" "), at(2))).when(i % 100 == 1, F.concat(at(0), at(1))).otherwise(F.concat(at(0), at(1), at(2)))
    return spark.range(N_RULES).select((i + 1).cast("int").alias("rank"), keyword.alias("keyword"), F.concat(F.lit("v"), (i % 14).cast("string")).alias("value"), (i % 100 == 1).alias("whole"))


@query(
    f"""WITH s AS (SELECT {list(SYLLABLES)} AS s),
    p AS (SELECT i, s[i % {_K} + 1] AS a, s[i // {_K} % {_K} + 1] AS b, s[i // {_K * _K} % {_K} + 1] AS c FROM range({N_RULES}) AS r(i), s),
    rules AS (SELECT i + 1 AS rank, CASE WHEN i % 10 = 0 THEN a || b || ' ' || c WHEN i % 100 = 1 THEN a || b ELSE a || b || c END AS keyword, 'v' || i % 14 AS value, i % 100 = 1 AS whole FROM p),
    texts AS (SELECT doc_id, lower(text) AS t FROM documents),
    met AS (
      SELECT doc_id, rank, value FROM texts, rules WHERE NOT whole AND contains(t, keyword)
      UNION ALL SELECT doc_id, rank, value FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+'))) AS w FROM texts) JOIN rules ON whole AND w = keyword),
    best AS (SELECT doc_id, arg_min(value, rank) AS value FROM met GROUP BY doc_id)
    SELECT d.doc_id, value FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id"""
)
def rules_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_rule(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), generated_rules(spark))


def vocabulary_rules(spark: SparkSession, name: str) -> DataFrame:
    """The fixed rules of indications, tissues or regions as a table."""
    if name == "tissue":
        found = [(word, value, False) for word, value in vocab.TISSUE_RULES]
    else:
        source = vocab.INDICATION_RULES if name == "indication" else vocab.REGION_RULES
        found = [(word, value, name == "region") for value, words in source for word in words]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found)], rules.RULES)


# -- identifiers that meet ---------------------------------------------------------------------

#: Documents as rows with names: most are called after their source, some as the names made for others are.
_NAMED = (
    "CASE WHEN doc_id % 11 = 0 THEN concat(source, '-', lang) WHEN doc_id % 13 = 0 THEN concat(source, '-2') "
    "WHEN doc_id % 17 = 0 THEN concat(source, '-', lang, '-3') WHEN doc_id % 19 = 0 THEN concat(source, '-3-3') ELSE source END"
)
_PARTS = ("CASE WHEN doc_id % 3 = 0 THEN '' ELSE upper(lang) END", "CASE WHEN doc_id % 7 < 4 THEN NULL ELSE concat('K', n_chars % 5) END")


@query(
    f"""WITH RECURSIVE o AS MATERIALIZED (
      SELECT doc_id AS ord, source AS fam, {_NAMED} AS base, nullif(lower({_PARTS[0]}), '') AS p, nullif(lower({_PARTS[1]}), '') AS q FROM documents),
    placed AS MATERIALIZED (
      SELECT ord, fam, row_number() OVER (PARTITION BY fam ORDER BY ord) AS pos, row_number() OVER (PARTITION BY base ORDER BY ord) AS n, base, list_filter([p, q], lambda x: x IS NOT NULL) AS parts FROM o),
    listed AS MATERIALIZED (
      SELECT ord, fam, pos, CASE WHEN n = 1 THEN [base] ELSE [] END || list_transform(range(1, len(parts) + 12), lambda k:
        array_to_string([base] || parts[1:k], '-') || CASE WHEN k > len(parts) THEN repeat('-' || n, k - len(parts)) ELSE '' END) AS names
      FROM placed),
    walk AS (
      SELECT DISTINCT fam, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS unique_id FROM placed
      UNION ALL
      SELECT fam, pos, list_append(used, pick), ord, pick FROM (
        SELECT w.fam, l.pos, w.used, l.ord, list_filter(l.names, lambda x: NOT list_contains(w.used, x))[1] AS pick FROM walk w JOIN listed l ON l.fam = w.fam AND l.pos = w.pos + 1))
    SELECT ord AS doc_id, unique_id FROM walk WHERE ord IS NOT NULL"""
)
def unique_ids_colliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that meet those made for others; one source in three rows is one family."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_NAMED).alias("base"), *(F.expr(p).alias(f"p{i}") for i, p in enumerate(_PARTS)))
    return ids.unique_ids(d, "base", [F.col("p0"), F.col("p1")], order="doc_id").select("doc_id", "unique_id")


# -- all facets at once --------------------------------------------------------------------------

_PHASE = "CASE ord % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'IV' WHEN 3 THEN 'IV' END"
_DIMENSIONS = "(SELECT category, region, phase FROM (SELECT category FROM groups), (SELECT region FROM names), (VALUES {}) AS p(phase))".format(", ".join(f"('{p}')" for p in vocab.PHASES))


def _cube_sql(where: str) -> str:
    return (
        MEDICINES
        + f"""SELECT category, region, phase, CAST(grouping(category, region, phase) AS INT) AS gid, count(DISTINCT ord) AS n FROM (
        SELECT atc_category AS category, region, {_PHASE} AS phase, ord FROM resolved WHERE {where} UNION ALL SELECT category, region, phase, NULL FROM {_DIMENSIONS}) GROUP BY CUBE (category, region, phase)"""
    )


@query(_cube_sql("true"))
def facet_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_cube(medicines(spark, sf_dir), resolved(), F.col("atc_category"), F.expr(_PHASE))


@query(_cube_sql("contains(lower(concat_ws(' ', nullif(name, ''), nullif(class, ''))), 'ring brand#1')"))
def facet_cube_under_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.search_haystack(medicines(spark, sf_dir), " Ring brand#1", filters.haystack(F.col("name"), F.col("class")))
    return facets.facet_cube(found, resolved(), F.col("atc_category"), F.expr(_PHASE))


# -- paths through the ontology ---------------------------------------------------------------------

_TYPE = "concat(p_type, ' ', p_brand, ' ', p_name)"


@query(
    f"""WITH RECURSIVE w AS (SELECT DISTINCT string_split({_TYPE}, ' ') AS w FROM part),
    nodes AS MATERIALIZED (SELECT DISTINCT w[1] AS region, array_to_string(w[1:k], ' ') AS node, CASE WHEN k > 1 THEN array_to_string(w[1:k - 1], ' ') END AS parent FROM w, unnest(range(1, len(w) + 1)) AS r(k)),
    down AS (SELECT region, node, 0 AS depth, node AS root, node AS path FROM nodes WHERE parent IS NULL
      UNION ALL SELECT n.region, n.node, depth + 1, root, path || ' > ' || n.node FROM down d JOIN nodes n ON n.region = d.region AND n.parent = d.node)
    SELECT p_partkey, CAST(depth AS INT) AS depth, root, path FROM part LEFT JOIN down ON node = {_TYPE}"""
)
def ontology_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of each part through the hierarchy of its type, brand and name."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TYPE).alias("kind"))
    w = p.select(F.split("kind", " ").alias("w")).distinct()
    each = w.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k"))
    cut = lambda k: F.array_join(F.slice("w", F.lit(1), k), " ")
    nodes = each.select(F.get("w", F.lit(0)).alias("region"), cut(F.col("k")).alias("node"), F.when(F.col("k") > 1, cut(F.col("k") - 1)).alias("parent"))
    paths = lookups.anatomy_paths(nodes)
    return p.join(paths, F.col("kind") == F.col("node"), "left").select("p_partkey", "depth", "root", "path")
