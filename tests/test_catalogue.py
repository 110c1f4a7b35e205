"""Sources, the batch and the registered queries against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from galenic.plans import registry
from galenic.plans.etl import build
from galenic.sources import flatfile, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ENTRIES = [
    (
        "D1",
        "ENTRY       D1  Drug\nNAME        Old; x\n            more\nNAME        Newname (JP) ; y\nATC         A10BA02 N02BE01\nREMARK      Adopted 1987 and 2003\nREMARK      approved 1950\nCOMMENT     " + "c" * 230 + "\nATC         B01AA01\n///\n",
    ),
    ("D2", ""),
    ("D3", "NAME        Only name"),
]


def test_entries(spark):
    df = spark.createDataFrame(ENTRIES, "entry_id string, text string")
    got = {r["entry_id"]: r for r in flatfile.interpret(df).collect()}
    one = got["D1"]
    assert one["name"] == "Newname (JP)" and one["atc_codes"] == ["A10BA02", "N02BE01", "B01AA01"] and one["atc_category"] == "A"
    assert one["year_approved"] == 20 and one["indication"] == "c" * 200
    assert "D2" not in got and got["D3"]["name"] == "Only name" and got["D3"]["atc_codes"] == []
    assert {r["year_approved"] for r in flatfile.interpret(df, whole_years=True).collect()} == {2003, None}


HEADER = "approval_status\ttrialbench_drug_names\tkegg_drug_id\tkegg_compound_id\tinchikey\tcanonical_smiles\tmolecular_weight\ttrialbench_outcomes\ttissues_union\ttissue_scores\ttrialbench_phases\ttrialbench_nct_ids"
ROWS = [
    "approved\tZeta, zeta, Eta 1,2\tD1\t\tKEY1\tCC\t12.5\tPain relief, x\tliver\t\tPhase II\tN1, N2",
    "approved\tZeta\tD9\t\tKEY2\tCC\tNA\tasthma\t\t\t\t",
    "approved\tplacebo\tD3\t\tKEY3\tC\t\t\tliver,skin\t\tPhase III\t",
    "approved\tplacebo\t\tC7\tKEY4\tC\t\t\t\t\t\t",
    "approved\tNokey\t\t\t\tC\t\t\t\t\t\t",
    "approved\tHeavy\t\t\tKEY6\tC\theavy\t\t\t\t\t",
    "withdrawn\tGone\t\t\tKEY7\tC\t\t\t\t\t\t",
    "approved\t1/2\t\t\tKEY8\tC\t1\t\theart\t\t\t",
    "approved\tplacebo\t\t\tKEY9\tC\t1\t\t\t\t\t",
]


def test_batch(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("\n".join([HEADER, *ROWS]) + "\n")
    (tmp_path / "n.tsv").write_text("kegg_id\tinchikey\tname\nC7\t\tCompound seven\nC7\t\tplacebo\n\tKEY9\tNine\n")
    compounds = tables.read_tsv(spark, str(tmp_path / "c.tsv"))
    names = tables.read_names(spark, str(tmp_path / "n.tsv"))
    entries = spark.createDataFrame(ENTRIES, "entry_id string, text string")
    out = build(compounds, tables.read_names(spark, str(tmp_path / "absent.tsv")), names, entries)
    got = {r["id"]: r for r in out.drugs.collect()}
    assert set(got) == {"zeta", "zeta-d9", "only-name", "compound-seven", "12", "nine"}
    assert got["zeta"]["atc_code"] == "A10BA02" and got["zeta"]["synonyms"] == ["Eta 1,2"] and got["zeta"]["phase"] == "II"
    assert got["zeta"]["indication"] == "c" * 200 and got["zeta"]["clinical_trials"] == ["N1", "N2"] and got["zeta"]["generation"] == 1
    assert got["zeta-d9"]["atc_code"] == "R99XX99" and got["zeta-d9"]["molecular_weight"] == 0.0
    assert got["only-name"]["phase"] == "IV" and got["only-name"]["body_region"] == "liver_biliary_pancreas" and got["only-name"]["secondary_body_regions"] == ["skin"]
    assert got["12"]["atc_category"] == "C" and got["nine"]["atc_code"] == "V99XX99"
    counts = out.counts().first()
    assert (counts["approved"], counts["kept"], counts["skipped"]) == (8, 6, 2)
    assert {r["reason"] for r in out.rejects.collect()} == {"no structure key", "weight is no number"}
    assert build(compounds, limit=1).drugs.count() == 1

    tables.write_bundle(out.drugs, str(tmp_path / "bundle"), source="test")
    again = tables.read_bundle(spark, str(tmp_path / "bundle"))
    assert [r["name"] for r in again.orderBy("ord").collect()] == sorted((r["name"] for r in got.values()), key=str.lower)
    tables.write_table(out.drugs, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6


def test_batch_is_worked_out_once(spark):
    """Names, rejects and everything behind them are read from one written table."""
    rows = spark.createDataFrame([(1, "approved", "A one, B", "C", "K1"), (2, "approved", "B", None, "K2")], "ord long, approval_status string, trialbench_drug_names string, canonical_smiles string, inchikey string")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in tables.COMPOUND_COLUMNS if c not in rows.columns})
    found = build(rows)
    plan = found.rejects._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "split(" not in plan
    assert [tuple(r) for r in found.rejects.collect()] == [(2, "B", "no structure")] and [r["id"] for r in found.drugs.collect()] == ["a-one"]


def test_bundles(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"drugs": [{"id": "a", "name": "A", "atc_code": "A", "atc_category": "A", "class_name": "k"}, {"id": "b", "name": "B"}]}')
    path = str(tmp_path / "b.json")
    assert tables.read_bundle(spark, path).count() == 0
    loose = tables.read_bundle(spark, path, strict=False).collect()
    assert [(r["id"], r["class"]) for r in loose] == [("a", "k")]
    assert tables.read_bundle(spark, str(tmp_path / "none.json")).count() == 0
    assert tables.first_readable(spark, [str(tmp_path / "none.json"), path]).count() == 1


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want


def test_command_line(spark, tmp_path, capsys):
    from galenic.__main__ import main

    (tmp_path / "c.tsv").write_text("\n".join([HEADER, *ROWS]) + "\n")
    main([str(tmp_path / "c.tsv"), str(tmp_path / "out"), "--bundle", str(tmp_path / "bundle")])
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "approved 8, kept 3, skipped 5"
    assert len(lines) == 4 and all(line.endswith(" 1") for line in lines[1:])
    assert tables.read_bundle(spark, str(tmp_path / "bundle")).count() == 3
