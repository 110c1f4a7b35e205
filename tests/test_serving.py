"""As-of joins, mergeable statistics, bundles in parts, the entry store and the routes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from galenic.operators import sketches, timeline
from galenic.plans import api
from galenic.sources import flatfile, parts, store, tables


def test_as_of_against_brute_force(spark):
    """Three rows in four have one key, so it reaches over several ranges; times tie, keys and times are missing."""
    rng = random.Random(1)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None]) if rng.random() < 0.9 else 1
    left = [(i, key(), rng.choice([*range(40), None])) for i in range(300)]
    right = [(i, key(), rng.choice([*range(40), None]), f"v{i}" if i % 5 else None) for i in range(200)]
    a = spark.createDataFrame(left, "id long, k int, t int").repartition(5)
    b = spark.createDataFrame(right, "e long, u int, at int, v string").repartition(3)
    got = {r["id"]: (r["e"], r["v"]) for r in timeline.as_of(a, b, ("k", "u"), ("t", "at"), ["e", "v"], tie="e").collect()}
    want = {}
    for i, k, t in left:
        found = max(((at, e, v) for e, u, at, v in right if u == k is not None and at is not None and t is not None and at <= t), key=lambda x: x[:2], default=(None,) * 3)
        want[i] = found[1:]
    assert got == want
    assert timeline.as_of(a, b.limit(0), ("k", "u"), ("t", "at"), ["v"], tie="e").where("v is not null").count() == 0
    assert timeline.as_of(a.limit(0), b, ("k", "u"), ("t", "at"), ["v"], tie="e").count() == 0


def test_sketches_add_up(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 9000).alias("v"), F.array(F.col("id") % 500, F.lit(-1)).alias("l"), (F.col("id") * 7 % 40_000).alias("x"))
    df = df.withColumn("v", F.when(F.col("id") % 2 == 0, F.col("v")))

    def made(some):
        return sketches.sketched(some, F.col("g"), {"v": F.col("v")}, {"l": F.col("l")}, {"x": F.col("x")})

    whole, halves = made(df), made(df.where("id < 15000")).union(made(df.where("id >= 15000")))
    exact = {"v": df.select("v").distinct().where("v is not null").count(), "l": 501}
    for some in (whole, halves):
        one = sketches.united(some, ["v", "l"], ["x"]).select("n", sketches.distinct_count("v").alias("v"), sketches.distinct_count("l").alias("l"), sketches.quantile("x", 0.25).alias("q")).first()
        assert one["n"] == 40_000
        assert abs(one["v"] - exact["v"]) <= sketches.ERROR * exact["v"] and abs(one["l"] - exact["l"]) <= sketches.ERROR * exact["l"]
        assert abs(one["q"] / 40_000 - 0.25) <= sketches.RANK_ERROR
    by = {r["category"]: r["v"] for r in sketches.united(halves, ["v"], [], F.col("category")).select("category", sketches.distinct_count("v").alias("v")).collect()}
    assert by.keys() == {0, 1, 2} and all(abs(v - 1500) <= 1500 * sketches.ERROR for v in by.values())


@pytest.fixture()
def drugs(spark):
    rows = [(i, f"d{i}", f"{'Nn'[i % 2]}ame {i % 7}", "A10BA02", "AB"[i % 2], ["x", "y"], None) for i in range(60)]
    return spark.createDataFrame(rows, "ord long, id string, name string, atc_code string, atc_category string, targets array<string>, company string")


def test_bundle_in_parts(spark, drugs, tmp_path):
    path = str(tmp_path / "bundle")
    parts.write_parts(drugs, path, "test", local_names=True)
    manifest = parts.read_manifest(spark, path).orderBy("part").collect()
    assert len(manifest) > 1 and sum(r["n"] for r in manifest) == 60
    assert [r["first"] for r in manifest] == [sum(r["n"] for r in manifest[:k]) for k in range(len(manifest))]
    meta = parts.read_metadata(spark, path).first()
    assert meta["total_drugs"] == 60 and meta["atc_categories"] == {"A": 30, "B": 30} and meta["local_name_enriched"] and meta["source"] == "test"
    want = [r["id"] for r in drugs.orderBy(F.lower("name"), "ord").collect()]
    found = parts.read_parts(spark, path).orderBy("ord").collect()
    assert [r["id"] for r in found] == want and [r["ord"] for r in found] == list(range(60)) and found[0]["targets"] == ["x", "y"] and found[0]["class"] is None
    for limit, offset in ((10, 0), (25, 20), (10, 55), (10, 200)):
        assert [r["id"] for r in parts.read_page(spark, path, limit, offset).collect()] == want[offset : offset + limit]
    with pytest.raises(ValueError, match="limit"):
        parts.read_page(spark, path, 0)
    parts.write_parts(drugs.limit(0), path, "none")
    assert parts.read_parts(spark, path).count() == 0 and parts.read_metadata(spark, path).first()["total_drugs"] == 0


def test_store_asks_for_what_is_missing(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []

    def fetch(ids):
        asked.append(sorted(r["entry_id"] for r in ids.collect()))
        return ids.where("entry_id <> 'gone'").select("entry_id", F.concat(F.lit("NAME        "), "entry_id").alias("text"))

    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "entry_id string")
    assert store.load(spark, path).count() == 0
    first = store.completed(spark, path, ids("a", "b", "gone", None, "a"), fetch)
    assert sorted(r["entry_id"] for r in first.collect()) == ["a", "b"]
    assert store.completed(spark, path, ids("b", "c", "gone"), fetch).count() == 2
    assert asked == [["a", "b", "gone"], ["c", "gone"]]
    assert store.completed(spark, path, ids("a"), fetch).count() == 1 and len(asked) == 2
    store.save(spark.createDataFrame([("a", "NAME        newer")], store.ENTRY), path)
    assert {r["entry_id"]: r["text"][12:] for r in store.load(spark, path).collect()} == {"a": "newer", "b": "b", "c": "c"}


def test_fields_of_odd_entries(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "short\n   \nLABEL       one\n  more \n\nNEXT LABEL  \n"), ("d", "LONGER LABEL x")], "entry_id string, text string")
    got = [(r["entry_id"], r["field_no"], r["label"], r["values"]) for r in flatfile.fields(df).orderBy("entry_id", "field_no").collect()]
    assert got == [("c", 1, "LABEL", ["one", "more", "NEXT LABEL"]), ("d", 1, "LONGER LABEL", ["x"])]
    assert "Exchange" not in flatfile.fields(df)._jdf.queryExecution().executedPlan().toString()


def test_routes(spark, drugs):
    df = drugs.withColumns({"phase": F.lit("II"), "class": F.lit("Statin"), "synonyms": F.array(F.lit("syn")), "indication": F.lit("Pain")})
    answer = api.list_drugs(df, "a", "STATIN", "II", limit=5, offset=28)
    assert answer.total.first()["total"] == 30 and [r["ord"] for r in answer.drugs.collect()] == [56, 58]
    assert api.list_drugs(df, search="pain").total.first()["total"] == 0 and api.search_drugs(df, "pain").total.first()["total"] == 60
    assert api.get_drug(df, "d7").first()["ord"] == 7 and api.get_drug(df, "none").count() == 0
    assert api.drugs_of_category(df, "b").total.first()["total"] == 30
    assert [tuple(r) for r in api.categories(df).collect()] == [("A", 30), ("B", 30)]
    stats = {(r["statistic"], r["value"]): r["n"] for r in api.stats(df).collect()}
    assert stats == {("total_drugs", None): 60, ("unique_companies", None): 0, ("unique_targets", None): 2, ("categories", "A"): 30, ("categories", "B"): 30, ("phases", "II"): 60}


def test_snapshot_scripts_and_fallback(spark, drugs, tmp_path):
    bundle, ontology, drawing = (str(tmp_path / n) for n in ("b.json", "o.json", "d.svg"))
    with open(bundle, "w") as f:
        json.dump({"drugs": [{"id": "a", "name": "A"}, {"name": "no id"}]}, f)
    for path, text in ((ontology, '{"version": "1"}'), (drawing, '<svg a="1">\n"é"</svg>')):
        with open(path, "w") as f:
            f.write(text)
    kept = api.snapshot(spark, bundle)
    with open(bundle, "w") as f:
        json.dump({"drugs": []}, f)
    assert api.health(kept).first().asDict() == {"status": "ok", "version": "1.0.0", "drugs_count": 2}

    tables.write_scripts(spark, str(tmp_path / "js"), bundle, ontology, drawing)
    script = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "js" / "human-body-svg")).collect())
    name, _, value = script.partition(" = ")
    assert name == "window.GALENIC_HUMAN_BODY_SVG" and json.loads(value.rstrip(";")) == '<svg a="1">\n"é"</svg>'
    script = "".join(r["value"] for r in spark.read.text(str(tmp_path / "js" / "body-ontology")).collect())
    assert json.loads(script.partition(" = ")[2].rstrip(";")) == {"version": "1"}

    absent = lambda: spark.read.parquet(str(tmp_path / "absent"))
    assert tables.first_with_rows([absent, lambda: drugs.limit(0), lambda: drugs.limit(3), absent]).count() == 3
    assert tables.first_with_rows([absent]) is None
