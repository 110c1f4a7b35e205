"""The catalogue's operators as queries over the star-schema tables.

``part`` plays the medicines (brand: class and company, words of the name:
targets, first letter of the type: category), ``orders`` the phases, ``events``
the scored tissues, ``documents`` the free texts, ``region`` and ``nation`` the
anatomy, ``conversations`` the genealogy.  Edge cases the tables lack come as
authored rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galenic.functions import arrays, classify, text, vocab
from galenic.operators import facets, filters, ids, lookups, present, regions
from galenic.sources import flatfile, tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}

MEDICINES = """
WITH m AS (
  SELECT p_partkey AS ord, p_name AS name, p_brand AS class, p_brand AS company, substr(p_type, 1, 1) AS atc_category,
    string_split(p_name, ' ') AS targets, 1950 + 2 * p_size AS year_approved, p_retailprice AS molecular_weight, p_type AS indication
  FROM part),
r(category, region, pos) AS (VALUES {rows}),
resolved AS (SELECT m.*, coalesce(r.region, 'systemic_multiorgan') AS region, coalesce(pos, 0) AS pos FROM m LEFT JOIN r ON r.category = m.atc_category),
names(region, display_name, o) AS (VALUES {names}),
groups(category, long_name) AS (VALUES {groups})
""".format(
    rows=", ".join(f"('{c}', '{r}', {i})" for c, rs in vocab.CATEGORY_REGIONS.items() for i, r in enumerate(rs)),
    names=", ".join(f"('{r}', '{n}', {i})" for i, (r, n) in enumerate(vocab.REGIONS)),
    groups=", ".join(f"('{c}', '{n}')" for c, n, _ in vocab.CATEGORIES),
)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def medicines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("class"),
        F.col("p_brand").alias("company"),
        F.left("p_type", F.lit(1)).alias("atc_category"),
        F.split("p_name", " ").alias("targets"),
        (1950 + 2 * F.col("p_size")).alias("year_approved"),
        F.col("p_retailprice").alias("molecular_weight"),
        F.col("p_type").alias("indication"),
    )


def resolved() -> Column:
    return filters.resolved_regions(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.col("atc_category"))


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


SHOWN = ("ord", "name", "class", "atc_category")


# -- counts --------------------------------------------------------------------


@query(MEDICINES + "SELECT atc_category, count(*) AS n FROM m WHERE atc_category <> '' GROUP BY 1")
def category_counts(spark, sf_dir):
    return facets.category_counts(medicines(spark, sf_dir))


@query(MEDICINES + "SELECT count(*) AS total, count(DISTINCT nullif(company, '')) AS companies, (SELECT count(DISTINCT t) FROM (SELECT unnest(targets) AS t FROM m)) AS targets FROM m")
def catalog_stats(spark, sf_dir):
    return facets.statistics(medicines(spark, sf_dir))


@query("SELECT o_orderstatus AS phase, count(*) AS n FROM orders GROUP BY 1")
def phase_counts(spark, sf_dir):
    return facets.counts(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), "phase")


@query(MEDICINES + "SELECT count(*) AS medicines, CAST(14 AS BIGINT) AS categories, CAST(14 AS BIGINT) AS regions FROM m")
def atlas_summary(spark, sf_dir):
    return facets.summary(medicines(spark, sf_dir), len(vocab.CATEGORIES), len(vocab.REGIONS))


@query(MEDICINES + "SELECT n.region, count(resolved.ord) AS n FROM names n LEFT JOIN resolved ON resolved.region = n.region AND atc_category = 'S' GROUP BY 1")
def region_facet(spark, sf_dir):
    return facets.region_facet(filters.by_category_or_default(medicines(spark, sf_dir), "S"), resolved())


@query(MEDICINES + "SELECT region, atc_category AS category, count(*) AS n FROM resolved GROUP BY 1, 2")
def region_category_facet(spark, sf_dir):
    return facets.region_category_facet(medicines(spark, sf_dir), resolved(), F.col("atc_category"))


# -- filters and searches --------------------------------------------------------


@query(MEDICINES + "SELECT ord, name, class, atc_category FROM m WHERE atc_category = upper('s')")
def filter_category(spark, sf_dir):
    return filters.by_category(medicines(spark, sf_dir), "s").select(*SHOWN)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def filter_phase(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("phase", F.col("o_orderstatus"))
    return filters.by_phase(df, "P").select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey FROM part WHERE coalesce(nullif(CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 7 = 0 THEN NULL ELSE substr(p_type, 1, 1) END, ''), 'V') = 'V'")
def filter_category_default(spark, sf_dir):
    cat = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 7 == 0, None).otherwise(F.left("p_type", F.lit(1)))
    return filters.by_category_or_default(table(spark, sf_dir, "part").withColumn("atc_category", cat), "V").select("p_partkey")


@query(MEDICINES + "SELECT ord, name, class, atc_category FROM m WHERE contains(lower(name), 'rown') OR contains(lower(class), 'rown') OR len(list_filter(targets, lambda t: contains(lower(t), 'rown'))) > 0 OR contains(lower(class), '#3')")
def search_fields(spark, sf_dir):
    m = medicines(spark, sf_dir)
    one = filters.search(m, "ROWN", lists=("targets",))
    two = filters.search(m, "#3", texts=("class",), lists=())
    return one.union(two).select(*SHOWN).distinct()


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE contains(lower(source), '@mail1') OR contains(lower(lang), '@mail1') OR contains(lower(text), '@mail1')")
def search_with_indication(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.select("doc_id", F.col("source").alias("name"), F.col("lang").alias("class"), F.col("text").alias("indication"))
    return filters.search(d, "@MAIL1", with_indication=True, lists=()).select("doc_id")


@query(MEDICINES + "SELECT ord, name, class, atc_category FROM m WHERE contains(lower(concat_ws(' ', nullif(name, ''), nullif(class, ''), nullif(indication, ''))), lower(trim('  brand#1 ')))")
def search_haystack(spark, sf_dir):
    hay = filters.haystack(F.col("name"), F.col("class"), F.col("indication"))
    return filters.search_haystack(medicines(spark, sf_dir), "  BRAND#1 ", hay).select(*SHOWN)


@query(MEDICINES + "SELECT ord, name, class, atc_category FROM m WHERE atc_category = 'P' AND EXISTS (SELECT 1 FROM resolved s WHERE s.ord = m.ord AND s.region = 'intestine_colorectal') AND contains(lower(concat_ws(' ', name, class)), 'a')")
def combined_filter(spark, sf_dir):
    m = filters.by_category_or_default(medicines(spark, sf_dir), "P")
    m = filters.by_region(m, "intestine_colorectal", resolved())
    return filters.search_haystack(m, "a", filters.haystack(F.col("name"), F.col("class"))).select(*SHOWN)


@query(MEDICINES + "SELECT ord, name, class, atc_category FROM m WHERE company = 'Brand#13' ORDER BY ord LIMIT 1")
def point_lookup(spark, sf_dir):
    return filters.lookup(medicines(spark, sf_dir), "company", "Brand#13").select(*SHOWN)


@query(MEDICINES + "SELECT ord, name, count(*) OVER () AS total FROM m WHERE atc_category = 'M' ORDER BY ord LIMIT 25 OFFSET 50")
def page_with_total(spark, sf_dir):
    m = filters.by_category(medicines(spark, sf_dir), "m")
    return filters.page(filters.with_total(m), limit=25, offset=50).select("ord", "name", "total")


@query(MEDICINES + "SELECT ord, name FROM m WHERE atc_category = 'S' ORDER BY ord LIMIT 120")
def result_cap_filtered(spark, sf_dir):
    m = filters.by_category_or_default(medicines(spark, sf_dir), "S")
    return filters.capped(m, filters.cap_applies("S")).select("ord", "name")


@query(MEDICINES + "SELECT ord, name FROM m ORDER BY ord LIMIT 72")
def result_cap_starter(spark, sf_dir):
    return filters.capped(medicines(spark, sf_dir), filters.cap_applies()).select("ord", "name")


@query(MEDICINES + "SELECT ord, name, row_number() OVER (ORDER BY lower(name), ord) AS position FROM m")
def sort_by_lower_name(spark, sf_dir):
    return filters.numbered_by_name(medicines(spark, sf_dir).select("ord", "name"), "name", "ord")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def approved_only_head(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    done = filters.approved(df.withColumn("approval_status", F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open")))
    return done.orderBy("o_orderkey").limit(500).select("o_orderkey", "o_orderstatus")


# -- texts -------------------------------------------------------------------------

SQL_WHITE = r"\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{SQL_WHITE}]+|[{SQL_WHITE}]+$', '', 'g')"


def sql_values(data: list[tuple], names: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in data)}) AS v({names})"


EDGE_NAMES = [
    (1, "A, b"), (2, "1,3-x"), (3, "-Alpha  beta-"), (4, " a / b "), (5, "a/placebo"), (6, "placebo/placebo"), (7, "1/2"), (8, "3.5"),
    (9, "treatment approach"), (10, " ,;"), (11, None), (12, "x/12/Placebo arm"), (13, "\tTab name\n"), (14, "plain"), (15, ""), (16, "nan"), (17, "7"),
]
SLUG_SQL = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-zA-Z0-9{1}-]', '', 'g'), '[{1}]+', '-', 'g'), '-')"


@query(f"SELECT k, name, {SLUG_SQL.format(sql_strip('string_split(name, chr(44))[1]'), SQL_WHITE)} AS slug FROM (SELECT p_partkey AS k, p_name || ' ' || p_brand AS name FROM part UNION ALL SELECT c_custkey, c_name FROM customer UNION ALL SELECT -k, name FROM {sql_values(EDGE_NAMES, 'k, name')})")
def slugify(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    edge = rows(spark, [(-k, n) for k, n in EDGE_NAMES], "k bigint, name string")
    every = part.union(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).union(edge)
    return every.select("k", "name", text.slug(F.col("name")).alias("slug"))


_TWICE = "regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\\1~#~\\2', 'g'), '([0-9]),([0-9])', '\\1~#~\\2', 'g')"


@query(f"SELECT doc_id, len(l) AS n, sha256(array_to_string(l, '|')) AS names_sha FROM (SELECT doc_id, list_filter(list_transform(string_split({_TWICE}, ','), lambda p: {sql_strip("replace(p, '~#~', ',')")}), lambda p: p <> '') AS l FROM documents)")
def split_names(spark, sf_dir):
    names = text.split_names(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", names.alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n"), F.sha2(joined(F.col("l")).cast("binary"), 256).alias("names_sha"))


_BLOCK = "regexp_matches(lower({0}), '" + "|".join(vocab.BLOCKED) + "')"
_NUMBER = "regexp_full_match({0}, '[0-9]+([.][0-9]+)?')"


@query(
    f"""WITH raw AS (SELECT k, name AS raw FROM {sql_values(EDGE_NAMES, 'k, name')} UNION ALL SELECT 100 + p_partkey, p_name || ' / ' || p_brand FROM part),
    c AS (SELECT k, raw, trim(regexp_replace(raw, '[{SQL_WHITE}]+', ' ', 'g'), ' ,;') AS n FROM raw WHERE raw IS NOT NULL AND raw NOT IN ('', 'nan')),
    p AS (SELECT *, list_filter(list_transform(string_split(n, '/'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS parts FROM c),
    q AS (SELECT *, list_filter(parts, lambda x: NOT {_BLOCK.format('x')} AND NOT {_NUMBER.format('x')}) AS kept FROM p),
    z AS (SELECT k, CASE WHEN contains(n, '/') AND len(kept) > 0 THEN CASE WHEN len(kept) = len(parts) THEN n ELSE array_to_string(kept, '/') END
      WHEN n <> '' AND NOT {_BLOCK.format('n')} AND NOT {_NUMBER.format('n')} THEN n END AS cleaned FROM q)
    SELECT raw.k, cleaned FROM raw LEFT JOIN z ON raw.k = z.k"""
)
def clean_names(spark, sf_dir):
    part = table(spark, sf_dir, "part").select((100 + F.col("p_partkey")).alias("k"), F.concat_ws(" / ", "p_name", "p_brand").alias("name"))
    every = rows(spark, EDGE_NAMES, "k bigint, name string").union(part)
    return every.select("k", text.clean_name(F.col("name")).alias("cleaned"))


@query(
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
    f AS (SELECT doc_id, min(i) AS i, arg_min(w, i) AS w FROM w WHERE w <> '' GROUP BY doc_id, lower(w))
    SELECT doc_id, coalesce(n, 0) AS n, sha256(coalesce(words, '')) AS words_sha FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(w, '|' ORDER BY i) AS words FROM f GROUP BY 1) USING (doc_id)"""
)
def dedupe_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", arrays.dedupe_caseless(F.split("text", " ")).alias("l"))
    words = F.coalesce("l", F.expr("cast(array() as array<string>)"))  # a null text has none
    return d.select("doc_id", F.size(words).cast("long").alias("n"), F.sha2(joined(words).cast("binary"), 256).alias("words_sha"))


EDGE_CODES = [(-1, "A10BA02; N02BE01"), (-2, "a10ba02"), (-3, "Adopted 1987, 2003"), (-4, "in 20031 or x1999"), (-5, "")]


@query(f"SELECT k, array_to_string(regexp_extract_all(t, '{text.CODE}'), '|') AS codes FROM (SELECT page_id AS k, html AS t FROM pages UNION ALL SELECT k, t FROM {sql_values(EDGE_CODES, 'k, t')})")
def extract_codes(spark, sf_dir):
    every = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.col("html").alias("t")).union(rows(spark, EDGE_CODES, "k bigint, t string"))
    return every.select("k", joined(text.codes(F.col("t"))).alias("codes"))


_YEAR = r"CAST(regexp_extract_all(t, '\b((19|20)[0-9]{{2}})\b', {0})[-1] AS INT)"
EDGE_YEARS = [*EDGE_CODES, (-6, "approved 1999"), (-7, "1950 and 2010."), (-8, "1950 2010 1999x")]


@query(f"SELECT k, {_YEAR.format(2)} AS century, {_YEAR.format(1)} AS whole_year FROM (SELECT page_id AS k, html AS t FROM pages UNION ALL SELECT k, t FROM {sql_values(EDGE_YEARS, 'k, t')})")
def extract_years(spark, sf_dir):
    every = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.col("html").alias("t")).union(rows(spark, EDGE_YEARS, "k bigint, t string"))
    return every.select("k", text.year(F.col("t")).alias("century"), text.year(F.col("t"), whole=True).alias("whole_year"))


def sql_case(column: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{cat}'" for cat, words in rules) + " END"


_INDICATION = sql_case("lower(text)", vocab.INDICATION_RULES)
EDGE_TEXTS = [(-1, "heart and brain"), (-2, "bronchus"), (-3, "bone_marrow"), (-4, "bone marrow"), (-5, "éear"), (-6, "Ear."), (-7, "acid, diabetes"), (-8, "psychotic"), (-9, None), (-10, "vitamin for the thyroid")]
_TEXTS = f"(SELECT doc_id AS k, text FROM documents UNION ALL SELECT k, text FROM {sql_values(EDGE_TEXTS, 'k, text')})"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text").union(rows(spark, EDGE_TEXTS, "k bigint, text string"))


@query(f"SELECT k, {_INDICATION} AS category FROM {_TEXTS}")
def classify_substring(spark, sf_dir):
    return texts(spark, sf_dir).select("k", classify.category_of_indication(F.col("text")).alias("category"))


@query(f"SELECT k, {sql_case('lower(text)', [(c, (w,)) for w, c in vocab.TISSUE_RULES])} AS category FROM {_TEXTS}")
def classify_ordered_pairs(spark, sf_dir):
    return texts(spark, sf_dir).select("k", classify.category_of_tissue(F.col("text")).alias("category"))


def sql_region(column: str) -> str:
    def rule(words) -> str:
        whole = "|".join(w for w in words if " " not in w)
        tests = [f"contains({column}, '{w}')" for w in words if " " in w]
        return " OR ".join([*tests, rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}_])({whole})([^\p{{L}}\p{{N}}_]|$)')"])

    return "CASE " + " ".join(f"WHEN {rule(words)} THEN '{region}'" for region, words in vocab.REGION_RULES) + " END"


@query(f"SELECT k, {sql_region('lower(text)')} AS region FROM {_TEXTS}")
def classify_whole_word(spark, sf_dir):
    return texts(spark, sf_dir).select("k", classify.region_of_text(F.col("text")).alias("region"))


@query(f"SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'L01XX01' END, {_INDICATION} || '99XX99', CASE WHEN lang = 'de' THEN 'N99XX99' END, 'V99XX99') AS atc_code FROM documents LEFT JOIN labels USING (doc_id)")
def cascade_category(spark, sf_dir):
    by_text = classify.code_of_category(classify.category_of_indication(F.col("text")))
    # the texts stay below the join: rows that meet are short, and each is classified once
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", by_text.alias("by_text")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    known = F.when(F.col("quality") == 0, "L01XX01")
    by_tissue = classify.code_of_category(classify.category_of_tissue(F.when(F.col("lang") == "de", "brain")))
    return d.select("doc_id", F.coalesce(known, "by_text", by_tissue, F.lit(vocab.FALLBACK_CODE)).alias("atc_code"))


@query(MEDICINES + "SELECT ord, CAST(CASE WHEN coalesce(y, 0) < 1970 THEN 1 WHEN y < 1990 THEN 2 WHEN y < 2010 THEN 3 ELSE 4 END AS INT) AS generation FROM (SELECT ord, CASE WHEN ord % 50 = 0 THEN NULL ELSE year_approved END AS y FROM m)")
def generation_bucket(spark, sf_dir):
    year = F.when(F.col("ord") % 50 != 0, F.col("year_approved"))
    return medicines(spark, sf_dir).select("ord", classify.generation(year).alias("generation"))


EDGE_PHASES = [(-1, "Phase I"), (-2, "Phase II, Phase I"), (-3, "Phase III,Phase I"), (-4, "Phase IV"), (-5, "Phase V"), (-6, None), (-7, "Phase II/III"), (-8, "")]
#: Phases that users reached, by the kind of their events.
EVENT_PHASES = {"view": "Phase I", "click": "Phase II", "purchase": "Phase III"}
_REACHED = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{p}'" for e, p in EVENT_PHASES.items()) + " END"


@query(
    f"""WITH v AS (SELECT k, t FROM {sql_values(EDGE_PHASES, 'k, t')} UNION ALL SELECT user_id * 1000 + day(ts), string_agg(DISTINCT {_REACHED}, ', ') FROM events GROUP BY user_id, day(ts))
    SELECT k, CASE WHEN list_contains(l, 'Phase III') OR list_contains(l, 'Phase IV') THEN 'IV' WHEN list_contains(l, 'Phase II') THEN 'II' WHEN list_contains(l, 'Phase I') THEN 'I' ELSE 'IV' END AS phase FROM (SELECT k, list_transform(string_split(coalesce(t, ''), ','), lambda x: trim(x)) AS l FROM v)"""
)
def phase_from_list(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.collect_set(F.expr(_REACHED)).alias("l"))
    each = e.select((F.col("user_id") * 1000 + F.col("day")).cast("long").alias("k"), F.array_join("l", ", ").alias("t"))
    every = each.union(rows(spark, EDGE_PHASES, "k bigint, t string"))
    return every.select("k", classify.phase(arrays.listed(F.col("t"))).alias("phase"))


@query(f"SELECT doc_id, len(l) AS n, sha256(array_to_string(l, '|')) AS trials_sha FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM documents)")
def trial_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", arrays.listed(F.col("text")).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n"), F.sha2(joined(F.col("l")).cast("binary"), 256).alias("trials_sha"))


@query(f"SELECT doc_id, substr({sql_strip('string_split(text, chr(44))[1]')}, 1, 200) AS indication FROM documents")
def indication_text(spark, sf_dir):
    head = text.strip(F.get(F.split("text", ","), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", F.left(head, F.lit(200)).alias("indication"))


# -- regions, labels, presentation ---------------------------------------------------


@query(MEDICINES + "SELECT ord, array_to_string(list(region ORDER BY pos), '|') AS regions FROM resolved GROUP BY ord")
def resolved_regions(spark, sf_dir):
    return medicines(spark, sf_dir).select("ord", joined(resolved()).alias("regions"))


@query(MEDICINES + "SELECT ord, display_name AS region_label FROM resolved JOIN names USING (region) WHERE pos = 0")
def region_label(spark, sf_dir):
    return lookups.region_label(medicines(spark, sf_dir), resolved()).select("ord", "region_label")


@query(MEDICINES + "SELECT ord, CASE WHEN indication NOT LIKE 'S%' THEN indication || ' with a primary ' || display_name || ' context.' ELSE 'A ' || display_name || ' therapy in ATC group ' || atc_category || '.' END AS summary FROM resolved JOIN names USING (region) WHERE pos = 0")
def public_summary(spark, sf_dir):
    m = lookups.region_label(medicines(spark, sf_dir), resolved())
    told = F.when(F.col("atc_category") == "S", "approved").otherwise(F.col("indication"))
    return m.select("ord", present.public_summary(F.lit(""), told, F.col("region_label"), F.col("atc_category")).alias("summary"))


@query(MEDICINES + "SELECT ord, name, company, atc_category, year_approved, indication FROM m")
def mode_projection_public(spark, sf_dir):
    return present.for_mode(medicines(spark, sf_dir), expert=False)


@query(MEDICINES + "SELECT ord, name, class, company, atc_category, array_to_string(targets, '|') AS targets, year_approved, molecular_weight, indication FROM m")
def mode_projection_expert(spark, sf_dir):
    return present.for_mode(medicines(spark, sf_dir), expert=True).withColumn("targets", joined(F.col("targets")))


@query("SELECT user_id, max(CAST(props->>'k' AS DOUBLE)) AS score, arg_min(event_id, (-CAST(props->>'k' AS DOUBLE), event_id)) AS best_event FROM events GROUP BY 1".replace("arg_min(event_id, (-CAST(props->>'k' AS DOUBLE), event_id))", "min(struct_pack(s := -CAST(props->>'k' AS DOUBLE), e := event_id)).e"))
def json_scores_max(spark, sf_dir):
    score = F.try_element_at(regions.score_map(F.col("props")), F.lit("k")).try_cast("double")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", score.alias("s"))
    best = F.min(F.struct((-F.col("s")).alias("less"), F.col("event_id").alias("e")))
    return e.groupBy("user_id").agg(F.max("s").alias("score"), best["e"].alias("best_event"))


EDGE_TISSUES = [
    (1, '{"liver": 2, "brain": 9.5}', None, None, "A"), (2, '{"liver": -1}', "brain", None, "A"), (3, "{bad", "lung, heart,brain", None, "A"),
    (4, None, "unknown", "kidney failure", "A"), (5, None, None, None, "E"), (6, None, None, None, "C"), (7, '{"x": 1}', None, "bone marrow", "A"),
]


#: Of errors and views, the score of an event for the brain, and one for the liver.
_TISSUE_SCORES = "CASE WHEN event_type IN ('error', 'view') THEN concat('{\"brain\": ', substr(props, 7, length(props) - 7), ', \"liver\": 50}') END"


@query(
    f"""WITH u AS (SELECT k, s, t, o, c FROM {sql_values(EDGE_TISSUES, 'k, s, t, o, c')} UNION ALL
      SELECT 1000 + event_id, {_TISSUE_SCORES}, CASE WHEN event_type = 'click' THEN 'unknown, skin, lung' END, NULL, upper(substr(event_type, 1, 1)) FROM events UNION ALL
      SELECT -1 - doc_id, NULL, NULL, text, 'A' FROM documents),
    v AS (SELECT k, s, t, o, c, CASE WHEN json_valid(s) THEN s END AS j FROM u),
    one AS (SELECT k, {sql_region('lower(key)')} AS region, greatest(0, CAST(j->>key AS DOUBLE)) AS score FROM (SELECT k, j, unnest(json_keys(j)) AS key FROM v WHERE j IS NOT NULL)),
    two AS (SELECT k, {sql_region('lower(trim(tissue))')} AS region, n - pos + 1 AS score FROM (SELECT k, unnest(string_split(t, ',')) AS tissue, generate_subscripts(string_split(t, ','), 1) AS pos, len(string_split(t, ',')) AS n FROM v WHERE t IS NOT NULL)),
    hit AS (SELECT 1 AS tier, k, region, max(score) AS score FROM one WHERE region IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 2, k, region, max(score) FROM two WHERE region IS NOT NULL GROUP BY 2, 3),
    best AS (SELECT k, tier, array_to_string(list(region ORDER BY score DESC, region), '|') AS regions FROM hit GROUP BY 1, 2),
    r(category, region, pos) AS (VALUES {", ".join(f"('{c}', '{r}', {i})" for c, rs in vocab.CATEGORY_REGIONS.items() for i, r in enumerate(rs))})
    SELECT v.k, coalesce(a.regions, b.regions, {sql_region('lower(o)')}, (SELECT array_to_string(list(region ORDER BY pos), '|') FROM r WHERE category = c), 'systemic_multiorgan') AS regions
    FROM v LEFT JOIN best a ON a.k = v.k AND a.tier = 1 LEFT JOIN best b ON b.k = v.k AND b.tier = 2"""
)
def body_regions_tiers(spark, sf_dir):
    nothing = F.lit(None).cast("string")
    tissues = F.when(F.col("event_type") == "click", "unknown, skin, lung")
    e = table(spark, sf_dir, "events").select((1000 + F.col("event_id")).alias("k"), F.expr(_TISSUE_SCORES), tissues, nothing, F.upper(F.left("event_type", F.lit(1))))
    d = table(spark, sf_dir, "documents").select(-1 - F.col("doc_id"), nothing, nothing, "text", F.lit("A"))
    v = rows(spark, EDGE_TISSUES, "k bigint, s string, t string, o string, c string").union(e).union(d)
    return v.select("k", joined(regions.body_regions(F.col("s"), F.col("t"), F.col("o"), F.col("c"))).alias("regions"))


# -- look-ups and genealogy ------------------------------------------------------------


@query(
    """WITH c AS (SELECT c_custkey % 997 AS k, arg_max(c_name, c_custkey) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), s AS (SELECT s_suppkey AS k, s_name AS n FROM supplier), t AS (SELECT n_nationkey AS k, n_name AS n FROM nation)
    SELECT o_orderkey, coalesce(c.n, s.n, t.n) AS name FROM orders LEFT JOIN c ON c.k = o_custkey % 1000 LEFT JOIN s ON s.k = o_custkey % 500 LEFT JOIN t ON t.k = o_custkey % 50"""
)
def lookup_coalesce(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % 997).cast("string").alias("kegg_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("kegg_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("kegg_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    probes = [(f"k{i}", lookups.last_names(t, "kegg_id", cleaned=False)) for i, t in enumerate((customer, supplier, nation))]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *((F.col("o_custkey") % n).cast("string").alias(f"k{i}") for i, n in enumerate((1000, 500, 50))))
    return lookups.coalesced(orders, probes, "name").select("o_orderkey", "name")


@query(MEDICINES + "SELECT ord, coalesce(long_name, 'Unknown') AS atc_name FROM m LEFT JOIN groups ON category = atc_category")
def atc_name_lookup(spark, sf_dir):
    named = lookups.dimension(medicines(spark, sf_dir), F.col("atc_category"), vocab.categories(spark), "category", "long_name", F.lit("Unknown"), "atc_name")
    return named.select("ord", "atc_name")


@query("SELECT r_name AS region, n_name AS node, n_nationkey AS ord FROM region JOIN nation ON n_regionkey = r_regionkey")
def ontology_nodes(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    node = F.struct(F.col("n_name").alias("display_name"), F.lit(None).cast("string").alias("parent"))
    nested = pairs.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", node))).alias("nodes"))
    ontology = nested.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "nodes"))).alias("internal_ontology"))
    return lookups.anatomy_nodes(ontology).select("region", F.col("display_name").alias("node"), F.col("node").alias("ord"))


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, each the child of the turn before it."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    before = F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string"))
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("ord"), key.alias("id"), F.concat(F.lit("turn "), key).alias("name"), F.array(before).alias("parent_drugs"))


_FAMILY = "WITH f AS (SELECT conv_id * 100000 + turn AS ord, conv_id || ':' || turn AS id, conv_id || ':' || (turn - 1) AS parent FROM conversations), k AS (SELECT id AS key, min(ord) AS o, arg_min(id, ord) AS found FROM f GROUP BY 1) "


@query(_FAMILY + "SELECT f.id, CAST(0 AS BIGINT) AS place, f.parent, k.found AS parent_id FROM f LEFT JOIN k ON k.key = f.parent")
def genealogy_parents(spark, sf_dir):
    return lookups.parents(family(spark, sf_dir))


@query(_FAMILY + "SELECT DISTINCT k.key AS id, f.id AS successor_id FROM f JOIN k ON k.key = f.parent")
def genealogy_successors(spark, sf_dir):
    return lookups.successors(family(spark, sf_dir))


@query(
    """WITH b AS (SELECT p_partkey AS k, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
    SELECT k, CASE WHEN n = 1 THEN base ELSE base || '-k' || k END AS unique_id FROM b"""
)
def unique_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.slug(F.col("p_name")).alias("base"))
    found = ids.unique_ids(p, "base", [F.concat(F.lit("K"), F.col("k").cast("string"))], order="k")
    return found.select("k", "unique_id")


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    s AS (SELECT *, length(line) > 12 AND substr(line, 1, 1) <> ' ' AS starts FROM l WHERE {sql_strip('line')} <> ''),
    g AS (SELECT *, CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS field_no FROM s)
    SELECT doc_id AS entry_id, field_no, max(CASE WHEN starts THEN {sql_strip('substr(line, 1, 12)')} END) AS label, count(*) AS n FROM g WHERE field_no > 0 GROUP BY 1, 2"""
)
def field_groups(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), "text")
    return flatfile.fields(entries).select("entry_id", "field_no", "label", F.size("values").cast("long").alias("n"))


#: Events as compounds: name, structure, structure key, weight and scores.
_EVENT_FIELDS = (
    "100 + event_id", "nullif(event_type, 'view')", "CASE WHEN event_id % 7 > 0 THEN 'C' END", "CASE WHEN event_id % 11 > 0 THEN 'K' END",
    "CASE WHEN event_id % 13 = 0 THEN 'heavy' ELSE cast(event_id AS varchar(20)) END", "CASE WHEN event_id % 5 = 0 THEN '{\"liver\": \"x\"}' ELSE props END",
)


EDGE_REJECTS = [(1, "a", "C", "K", "12.5", "{}"), (2, None, "C", "K", None, None), (3, "a", None, "K", None, None), (4, "a", "C", None, None, None), (5, "a", "C", "K", "heavy", None), (6, "a", "C", "K", "1", "[1]"), (7, "a", "C", "K", "1", '{"liver": "x"}'), (8, "a", "C", "K", "1", '{"none": "x"}'), (9, "ä", "C", "K", "1", None)]


@query(
    f"""SELECT k, CASE WHEN n IS NULL THEN 'no name' WHEN n = 'ä' THEN 'no id' WHEN c IS NULL THEN 'no structure' WHEN i IS NULL THEN 'no structure key'
      WHEN w IS NOT NULL AND try_cast(w AS DOUBLE) IS NULL THEN 'weight is no number'
      WHEN coalesce(json_valid(s) AND (json_type(s) <> 'OBJECT' OR (json_extract_string(s, 'liver') IS NOT NULL AND try_cast(json_extract_string(s, 'liver') AS DOUBLE) IS NULL)), false) THEN 'scores are unreadable' END AS reason
    FROM (SELECT k, n, c, i, w, s FROM {sql_values(EDGE_REJECTS, 'k, n, c, i, w, s')} UNION ALL SELECT {", ".join(_EVENT_FIELDS)} FROM events)"""
)
def reject_reasons(spark, sf_dir):
    from galenic.plans.etl import reject_reason

    v = rows(spark, EDGE_REJECTS, "k bigint, name string, canonical_smiles string, inchikey string, molecular_weight string, tissue_scores string")
    v = v.union(table(spark, sf_dir, "events").selectExpr(*_EVENT_FIELDS))
    return reject_reason(v.withColumn("id", text.slug(F.col("name")))).select("k", "reason")


EDGE_SMILES = [(-1, "CC(=O)Cl"), (-2, "c1ccccc1"), (-3, "C" * 60), (-4, ""), (-5, None)]


@query(f"SELECT k, CAST(len(regexp_extract_all(s, '[A-Z][a-z]?')) AS BIGINT) AS atoms, CASE WHEN length(s) > 50 THEN substr(s, 1, 50) || '...' ELSE s END AS preview FROM (SELECT p_partkey AS k, p_brand || p_type AS s FROM part UNION ALL SELECT k, s FROM {sql_values(EDGE_SMILES, 'k, s')})")
def atom_estimate(spark, sf_dir):
    every = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat("p_brand", "p_type").alias("s")).union(rows(spark, EDGE_SMILES, "k bigint, s string"))
    return every.select("k", text.atoms(F.col("s")).cast("long").alias("atoms"), text.preview(F.col("s")).alias("preview"))


@query(MEDICINES + "SELECT ord, name, atc_category, molecular_weight FROM m")
def bundle_round_trip(spark, sf_dir):
    m = medicines(spark, sf_dir).select("ord", F.col("ord").cast("string").alias("id"), "name", F.lit("V99XX99").alias("atc_code"), "atc_category", "molecular_weight")
    value = tables.bundle_of(m, "round trip")
    bundle = value.select(F.from_json("value", tables.BUNDLE).alias("b")).select("b.*")
    return tables.drugs_of(bundle).select(F.col("id").cast("long").alias("ord"), "name", "atc_category", "molecular_weight")


# -- records as readers see them, and the whole batch ----------------------------------

_YEARS = "CASE WHEN ord % 50 = 0 THEN NULL WHEN ord % 51 = 0 THEN 0 ELSE year_approved END"


@query(
    MEDICINES
    + f"""SELECT CAST(ord AS VARCHAR) AS id, name, CASE WHEN ord % 7 = 0 THEN 'V' ELSE atc_category END AS category, array_to_string(targets[1:2], ', ') AS targets,
    CAST(CAST(floor(molecular_weight + 0.5) AS BIGINT) AS VARCHAR) AS weight, coalesce(CAST(nullif({_YEARS}, 0) AS VARCHAR), 'Unknown year') AS year, CASE WHEN ord % 3 = 0 THEN 'N/A' ELSE 'II' END AS phase FROM m"""
)
def cards(spark, sf_dir):
    m = medicines(spark, sf_dir).withColumn("year_approved", F.expr(_YEARS)).withColumn("id", F.col("ord").cast("string"))
    m = m.withColumn("atc_category", F.when(F.col("ord") % 7 != 0, F.col("atc_category"))).withColumn("phase", F.when(F.col("ord") % 3 == 0, "").otherwise("II"))
    return present.card(m)


@query(
    MEDICINES
    + f"""SELECT CAST(ord AS VARCHAR) AS id, name, 'N/A' AS code, printf('%.2f', molecular_weight) AS weight, 'IV' AS phase, coalesce(CAST(nullif({_YEARS}, 0) AS VARCHAR), 'N/A') AS year, indication,
    array_to_string(targets, ', ') AS targets, company, 'N/A' AS synonyms, CASE WHEN ord % 3 = 0 THEN 'N/A' ELSE class END AS class, 'Generation ' || CASE WHEN ord % 5 = 0 THEN 1 ELSE ord % 5 END AS generation,
    CASE WHEN length(repeat(name, 5)) > 50 THEN substr(repeat(name, 5), 1, 50) || '...' ELSE repeat(name, 5) END AS smiles FROM m"""
)
def details(spark, sf_dir):
    m = medicines(spark, sf_dir).withColumn("year_approved", F.expr(_YEARS)).withColumn("id", F.col("ord").cast("string")).withColumn("smiles", F.repeat("name", F.lit(5)))
    m = m.withColumns({"atc_code": F.lit(""), "phase": F.lit("IV"), "synonyms": F.expr("cast(array() as array<string>)"), "generation": (F.col("ord") % 5).cast("int")})
    return present.detail(m.withColumn("class", F.when(F.col("ord") % 3 != 0, F.col("class"))))


@query(MEDICINES + "SELECT region, atc_category AS category, count(*) AS n FROM resolved WHERE contains(lower(concat_ws(' ', name, class)), 'ring brand#1') GROUP BY 1, 2")
def previews_under_search(spark, sf_dir):
    found = filters.search_haystack(medicines(spark, sf_dir), " Ring brand#1", filters.haystack(F.col("name"), F.col("class")))
    return facets.region_category_facet(found, resolved(), F.col("atc_category"))


@query(
    f"""WITH a AS (SELECT p_partkey AS ord, p_name AS name, replace(p_name, ' ', '-') AS base, CAST(p_retailprice AS DOUBLE) AS w, p_type, coalesce({_INDICATION.replace("lower(text)", "lower(p_type)")}, 'V') AS cat FROM part WHERE p_size % 10 <> 0 AND p_partkey % 97 <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS n FROM a),
    r(category, region, pos) AS (VALUES {", ".join(f"('{c}', '{rs[0]}', 0)" for c, rs in vocab.CATEGORY_REGIONS.items())})
    SELECT ord, CASE WHEN n = 1 THEN base ELSE base || '-d' || ord END AS id, name, cat || '99XX99' AS atc_code, w AS molecular_weight, 'II' AS phase, CAST(1 AS INT) AS generation, p_type AS indication,
      coalesce({sql_region('lower(p_type)')}, region, 'systemic_multiorgan') AS body_region FROM n LEFT JOIN r ON category = cat"""
)
def whole_batch(spark, sf_dir):
    from galenic.plans.etl import build

    raw = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as ord", "if(p_size % 10 <> 0, 'approved', 'withdrawn') as approval_status", "p_name as trialbench_drug_names", "concat('D', p_partkey) as kegg_drug_id",
        "if(p_partkey % 97 <> 0, concat('K', p_partkey), null) as inchikey", "p_brand as canonical_smiles", "cast(p_retailprice as string) as molecular_weight", "p_type as trialbench_outcomes", "'Phase II, Phase I' as trialbench_phases",
    )
    compounds = raw.withColumns({c: F.lit(None).cast("string") for c in tables.COMPOUND_COLUMNS if c not in raw.columns})
    return build(compounds).drugs.select("ord", "id", "name", "atc_code", "molecular_weight", "phase", "generation", "indication", "body_region")
