"""Filters, look-ups, identifiers, regions and presentation."""

import random

import pytest
from pyspark.sql import functions as F

from galenic.operators import facets, filters, ids, lookups, present, regions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def drugs(spark):
    data = [
        (0, "a", "Alpha", "Kinase", ["T1", "t2"], ["Al"], "A", "x-ray", None, "C1"),
        (1, "b", "Beta", None, None, None, "", "Alpha wave", None, ""),
        (2, "c", "alpha", "", ["", None], [], "E", None, "skin", "C1"),
    ]
    schema = "ord int, id string, name string, `class` string, targets array<string>, synonyms array<string>, atc_category string, indication string, body_region string, company string"
    return spark.createDataFrame(data, schema)


def ords(df):
    return sorted(r["ord"] for r in df.collect())


def test_searches(drugs):
    assert ords(filters.search(drugs, "ALPHA")) == [0, 2]
    assert ords(filters.search(drugs, "alpha", with_indication=True)) == [0, 1, 2]
    assert ords(filters.search(drugs, "")) == [0, 1, 2]
    hay = filters.haystack(F.col("id"), F.col("name"), F.col("class"))
    assert ords(filters.search_haystack(drugs, " a alpha ", hay)) == [0]
    assert ords(filters.search_haystack(drugs, "   ", hay)) == [0, 1, 2]


def test_filters_and_regions(drugs):
    assert ords(filters.by_category(drugs, "a")) == [0]
    assert ords(filters.by_category_or_default(drugs, "V")) == [1]
    resolved = filters.resolved_regions(F.col("body_region"), F.lit(None).cast("array<string>"), F.col("atc_category"))
    got = {r["ord"]: r["x"] for r in drugs.select("ord", resolved.alias("x")).collect()}
    assert got[0][0] == "stomach_upper_gi" and got[1] == ["systemic_multiorgan"] and got[2] == ["skin"]
    assert ords(filters.by_region(drugs, "skin", resolved)) == [2]
    facet = {r["region"]: r["n"] for r in facets.region_facet(drugs, resolved).collect()}
    assert len(facet) == 14 and facet["skin"] == 1 and facet["brain_cns"] == 0


def test_paging_and_caps(drugs):
    assert ords(filters.page(drugs, limit=2, offset=2)) == [2]
    for bad in ({"limit": 0}, {"limit": 10_001}, {"offset": -1}):
        with pytest.raises(ValueError):
            filters.page(drugs, **bad)
    assert filters.with_total(drugs).first()["total"] == 3
    assert filters.cap_applies(query=" ") and not filters.cap_applies()
    assert filters.toggled("A", "A", "all") == "all" and filters.toggled(None, "skin") == "skin"
    assert "TakeOrderedAndProject" in plan(filters.page(drugs))
    assert "category" in filters.empty_message("A") and filters.empty_message() == "No medicines are loaded."


def test_statistics(drugs):
    r = facets.statistics(drugs).first()
    assert (r["total"], r["companies"], r["targets"]) == (3, 1, 3)


def test_lookup_tables(spark):
    names = spark.createDataFrame([(0, "k1", "First"), (1, "k1", "Second"), (2, "k1", "placebo"), (3, None, "x"), (4, "k2", "7")], "ord int, kegg_id string, name string")
    assert {r["key"]: r["name"] for r in lookups.last_names(names, "kegg_id").collect()} == {"k1": "Second"}


def test_genealogy(spark):
    data = [(0, "a", "Alpha", []), (1, "b", "a", ["a", "nobody"]), (2, "c", "Gamma", ["Alpha", "a"]), (3, "d", "Alpha", None)]
    df = spark.createDataFrame(data, "ord int, id string, name string, parent_drugs array<string>")
    got = sorted((r["id"], r["place"], r["parent_id"]) for r in lookups.parents(df).collect())
    assert got == [("b", 0, "a"), ("b", 1, None), ("c", 0, "a"), ("c", 1, "a")]
    got = sorted((r["id"], r["successor_id"]) for r in lookups.successors(df).collect())
    assert got == [("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("d", "c")]
    assert "NestedLoop" not in plan(lookups.parents(df)) + plan(lookups.successors(df))


def sequential(rows):
    used, seen, out = set(), {}, []
    for base, *parts in rows:
        seen[base] = seen.get(base, 0) + 1
        if seen[base] == 1 and base not in used:
            free = base
        else:
            free = base
            for p in [*(x.lower() for x in parts if x), str(seen[base])]:
                free += "-" + p
                if free not in used:
                    break
            while free in used:
                free += f"-{seen[base]}"
        used.add(free)
        out.append(free)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_ids(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "b", "a-k", "a-k-2", "c"] if seed % 2 else ["a", "b", "c"]
    rows = [(rng.choice(bases), rng.choice([None, "K", "", "L"]), rng.choice([None, "I"])) for _ in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, base string, p string, q string")
    got = [r["unique_id"] for r in ids.unique_ids(df, "base", [F.col("p"), F.col("q")]).orderBy("ord").collect()]
    assert got == sequential(rows)


def test_body_regions(spark):
    data = [('{"liver": 2, "brain": 9}', None, None, "A"), (None, "lung,brain", None, "A"), ("{oops", None, "kidney", "A"), ("[1]", None, None, "S"), ('{"skin": -3}', "brain", None, "A")]
    df = spark.createDataFrame(data, "s string, t string, o string, c string")
    got = [r["x"] for r in df.select(regions.body_regions(*(F.col(x) for x in "stoc")).alias("x")).collect()]
    assert got == [["brain_cns", "liver_biliary_pancreas"], ["lung_respiratory", "brain_cns"], ["kidney_urinary"], ["eye_ear"], ["skin"]]
    bad = [r["x"] for r in df.select(regions.unreadable(F.col("s")).alias("x")).collect()]
    assert bad == [False, False, False, True, False]


def test_body_regions_look_once(spark):
    """Scores are parsed once, and each tier asks once for the regions of its words."""
    df = spark.createDataFrame([], "s string, t string, o string, c string")
    plan = df.select(regions.body_regions(*(F.col(x) for x in "stoc")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("jsontostructs") + plan.count("from_json(") == 1 and plan.count("lower(") == 3


def test_presentation(spark):
    df = spark.createDataFrame([("s", "i", "L", "A"), ("", " pain ", "L", "A"), (None, "approved", "L", ""), (None, None, "L", "B")], "s string, i string, l string, c string")
    got = [r["x"] for r in df.select(present.public_summary(*(F.col(x) for x in "silc")).alias("x")).collect()]
    assert got == ["s", "pain with a primary L context.", "A L therapy in ATC group V.", "A L therapy in ATC group B."]
    full = spark.createDataFrame(
        [("a", "A", None, None, ["x", "y", "z"], 0.0, 0, "", None, "", [], None, 0, "C" * 60, "k")],
        "id string, name string, atc_category string, atc_code string, targets array<string>, molecular_weight double, year_approved int, phase string, indication string, company string, synonyms array<string>, `class` string, generation int, smiles string, inchikey string",
    )
    card = present.card(full).first()
    assert (card["category"], card["targets"], card["weight"], card["year"], card["phase"]) == ("V", "x, y", None, "Unknown year", "N/A")
    detail = present.detail(full).first()
    assert (detail["generation"], detail["synonyms"], detail["weight"]) == ("Generation 1", "N/A", "N/A")
    assert "inchikey" not in present.for_mode(full, expert=False).columns
    assert present.result_header(full, True).first()["header"] == "1 matching drugs"


def test_no_python_in_plans(spark, drugs):
    resolved = filters.resolved_regions(F.col("body_region"), F.lit(None).cast("array<string>"), F.col("atc_category"))
    for df in (facets.region_category_facet(drugs, resolved, F.col("atc_category")), filters.search(drugs, "a")):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_ids_of_apart_families_and_without_base(spark):
    data = [(0, "a", "k"), (1, "a-k", "x"), (2, "a", "k"), (3, "b", "q"), (4, "b", "q"), (5, None, "z"), (6, "b-c", "q")]
    df = spark.createDataFrame(data, "ord int, base string, p string")
    got = [r["unique_id"] for r in ids.unique_ids(df, "base", [F.col("p")]).orderBy("ord").collect()]
    assert got == ["a", "a-k", "a-k-2", "b", "b-q", None, "b-c"]


def test_numbers_by_name(spark):
    data = [(i, f"N{i % 7}" if i % 2 else f"n{i % 7}") for i in range(200)]
    df = spark.createDataFrame(data, "ord int, name string")
    got = [(r["name"].lower(), r["ord"]) for r in filters.numbered_by_name(df, "name", "ord").orderBy("position").collect()]
    assert got == sorted((n.lower(), i) for i, n in data)
    assert filters.numbered_by_name(df.where("false"), "name", "ord").count() == 0
