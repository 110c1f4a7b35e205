import json

from galenic.operators import lookups
from galenic.sources import tables

ONTOLOGY = {
    "version": "1",
    "updated": "2020-01-01",
    "visible_regions": [{"id": "skin", "display_name": "Skin", "icon": "s", "description": "d", "internal_nodes": ["epidermis", "dermis"]}],
    "internal_ontology": {"skin": {"epidermis": {"display_name": "Epidermis"}, "basal_layer": {"display_name": "Basal layer", "parent": "epidermis"}}},
    "disease_to_anatomy": {"rash": {"region": "skin", "nodes": ["epidermis", "dermis"]}},
    "placement_authority": ["curated", "inferred"],
}


def test_ontology(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps(ONTOLOGY, indent=1))
    o = tables.read_ontology(spark, str(path))
    assert sorted(map(tuple, lookups.anatomy_nodes(o).collect()), key=str) == [("skin", "basal_layer", "Basal layer", "epidermis"), ("skin", "epidermis", "Epidermis", None)]
    assert sorted(map(tuple, lookups.diseases(o).collect())) == [("rash", "skin", "dermis"), ("rash", "skin", "epidermis")]
    assert [r["id"] for r in lookups.visible_regions(o).collect()] == ["skin"]
    assert [tuple(r) for r in lookups.placement_authority(o).orderBy("ord").collect()] == [(0, "curated"), (1, "inferred")]
    assert tables.read_ontology(spark, str(tmp_path / "none.json")).count() == 0


def test_script(spark):
    df = spark.createDataFrame([('{"a": 1}',)], "value string")
    assert tables.as_script(df, "DATA").first()["value"] == 'window.DATA = {"a": 1};'
