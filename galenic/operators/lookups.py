"""Look-ups: names by several keys, dimensions, genealogy and the anatomy tables.

Look-up tables may grow with the data, so no side is broadcast by hand:
adaptive execution broadcasts what it has measured to be small.  Only the fixed
vocabularies are hinted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.functions.text import clean_name, humanised, present
from galenic.functions.vocab import regions


def last_names(table: DataFrame, key: str, cleaned: bool = True) -> DataFrame:
    """key, name: the last usable name of each key (``ord`` tells the order)."""
    name = clean_name(F.col("name")) if cleaned else F.col("name")
    usable = table.select(F.col(key).alias("key"), name.alias("name"), "ord").where(present(F.col("key")) & F.col("name").isNotNull())
    return usable.groupBy("key").agg(F.max_by("name", "ord").alias("name"))


def coalesced(df: DataFrame, probes: list[tuple[str, DataFrame]], out: str) -> DataFrame:
    """``out``: the name found first by probing (key column, table of key and name) in turn."""
    found = []
    for i, (key, table) in enumerate(probes):
        found.append(f"_name{i}")
        df = df.join(table.select(F.col("key").alias(f"_key{i}"), F.col("name").alias(f"_name{i}")), F.col(key) == F.col(f"_key{i}"), "left").drop(f"_key{i}")
    return df.withColumn(out, F.coalesce(*found)).drop(*found)


def dimension(df: DataFrame, key: Column, table: DataFrame, table_key: str, value: str, default: Column, out: str) -> DataFrame:
    """``out``: a value of a fixed dimension, or a default."""
    small = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v"))
    return df.withColumn("_key", key).join(F.broadcast(small), F.col("_key") == F.col("_k"), "left").withColumn(out, F.coalesce("_v", default)).drop("_key", "_k", "_v")


def region_label(df: DataFrame, resolved: Column, out: str = "region_label") -> DataFrame:
    first = F.get(resolved, F.lit(0))
    return dimension(df, first, regions(df.sparkSession), "region", "display_name", humanised(first), out)


def key_table(df: DataFrame, *keys: str) -> DataFrame:
    """key -> ord, id, name of the first row that has it in any of ``keys``."""
    each = reduce(DataFrame.union, [df.select(F.col(k).alias("key"), "ord", "id", "name") for k in keys])
    first = each.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("ord", "id", "name")).alias("row"))
    return first.select("key", F.col("row.ord").alias("found_ord"), F.col("row.id").alias("found_id"), F.col("row.name").alias("found_name"))


def parents(df: DataFrame) -> DataFrame:
    """id, place, parent, parent_id: every named parent, resolved to the first row
    whose id or name it is; null parent_id where it stays plain text.

    Ids and names are one key table, so this is an equality join and not a
    nested loop over an OR.
    """
    each = df.select("id", F.posexplode("parent_drugs").alias("place", "parent"))
    return each.join(key_table(df, "id", "name"), F.col("parent") == F.col("key"), "left").select("id", F.col("place").cast("long").alias("place"), "parent", F.col("found_id").alias("parent_id"))


def successors(df: DataFrame) -> DataFrame:
    """id, successor_id: the rows that name a row's id or name among their parents."""
    keys = df.select(F.col("id").alias("key"), F.col("id").alias("parent")).union(df.select("name", "id")).where(F.col("key").isNotNull()).distinct()
    each = df.select(F.col("id").alias("successor_id"), F.explode("parent_drugs").alias("named"))
    return each.join(keys, F.col("named") == F.col("key")).select(F.col("parent").alias("id"), "successor_id").distinct()


def anatomy_nodes(ontology: DataFrame) -> DataFrame:
    """region, node, display_name, parent from the nested map of regions and nodes."""
    each = ontology.select(F.explode("internal_ontology").alias("region", "nodes"))
    each = each.select("region", F.explode("nodes").alias("node", "v"))
    return each.select("region", "node", F.col("v.display_name").alias("display_name"), F.col("v.parent").alias("parent"))


#: Steps from a root that a path may have: the bound of the recursion.
DEEPEST = 50


def anatomy_paths(nodes: DataFrame, separator: str = " > ") -> DataFrame:
    """region, node, depth, root, path of every node: its way from the root, down along ``parent``.

    A recursive query, a step for each level.  A node whose parent is not among the
    nodes of its region is a root.  Nodes on a cycle, or below one, have no way
    from a root: they come with null depth, root and path.  ``nodes`` is a vocabulary, so
    its rows are within the bound that Spark sets on recursion; a table of any size
    that refers to nodes is joined with the result.
    """
    spark = nodes.sparkSession
    nodes = nodes.select("region", "node", "parent").dropDuplicates(["region", "node"])
    found = spark.sql(
        f"""
        WITH RECURSIVE down (region, node, depth, root, way) MAX RECURSION LEVEL {DEEPEST} AS (
          SELECT n.region, n.node, 0, n.node, array(n.node) FROM {{nodes}} n LEFT ANTI JOIN {{nodes}} p ON p.region = n.region AND p.node = n.parent
          UNION ALL
          SELECT c.region, c.node, d.depth + 1, d.root, array_append(d.way, c.node) FROM down d JOIN {{nodes}} c ON c.region = d.region AND c.parent = d.node
          WHERE d.depth + 1 < {DEEPEST} AND NOT array_contains(d.way, c.node))
        SELECT region AS _region, node AS _node, depth, root, array_join(way, :separator) AS path FROM down""",
        args={"separator": separator},
        nodes=nodes,
    )
    return nodes.join(found, (F.col("region") == F.col("_region")) & (F.col("node") == F.col("_node")), "left").select("region", "node", "depth", "root", "path")


def diseases(ontology: DataFrame) -> DataFrame:
    """disease, region, node from the map of diseases."""
    each = ontology.select(F.explode("disease_to_anatomy").alias("disease", "v"))
    return each.select("disease", F.col("v.region").alias("region"), F.explode("v.nodes").alias("node"))


def visible_regions(ontology: DataFrame) -> DataFrame:
    return ontology.select(F.posexplode("visible_regions").alias("ord", "r")).select("ord", "r.id", "r.display_name", "r.icon", "r.description")


def placement_authority(ontology: DataFrame) -> DataFrame:
    return ontology.select(F.posexplode("placement_authority").alias("ord", "authority"))
