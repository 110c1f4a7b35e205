"""Unique identifiers as a fixpoint of proposals.

Every row has a list of names it would take, best first: its base (only the first
row of a base), the base with one more part at a time, with its number among the
rows of its base, and with that number again and again.  The rule is that rows
choose in source order, each the first name that no earlier row has.

That is what proposals in rounds come to: all rows propose at once, a name stays
with the earliest row that ever proposed it, and a row that loses one, now or
when an earlier row asks for it later, proposes its next.  A name's holder only
ever becomes earlier, so it is the minimum over all proposals made for it, a
partial aggregate.  Rounds cover the rows still without a name and end when there
are none; the names do not depend on how rows are dealt out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.functions.text import empty_as_null
from galenic.sources.shared import numbered, staged


def proposed(level: Column) -> Column:
    """The name of a level (from 0) from base, chain (the parts that are there, the number last) and n."""
    within = F.array_join(F.concat(F.array("base"), F.slice("chain", F.lit(1), F.least(level, F.size("chain")))), "-")
    again = F.greatest(level - F.size("chain"), F.lit(0))
    return F.concat(within, F.repeat(F.concat(F.lit("-"), F.col("n").cast("string")), again))


def losers(fresh: DataFrame, made: DataFrame | None) -> DataFrame:
    """Rows of proposals that do not hold their name: of ``fresh``, and those whose name ``fresh`` took.

    ``made`` are the proposals before.  A name that very many rows propose is one
    row of the partial aggregate, and the join with it can be split.
    """
    late = lambda rows, names: rows.join(names, F.col("name") == F.col("_of")).where("_row > _first").select(*fresh.columns)
    names = fresh.groupBy("name").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if made is None:
        return late(fresh, names.where("_n > 1").select(F.col("name").alias("_of"), "_first"))
    asked = names.select(F.col("name").alias("_of"))
    held = made.join(asked, F.col("name") == F.col("_of"), "left_semi").groupBy("name").agg(F.min_by(F.struct(*fresh.columns), "_row").alias("holder"))
    held = staged(held.select("holder.*"), "holders")
    names = names.join(held.select(F.col("name").alias("_of"), F.col("_row").alias("_held")), F.col("name") == F.col("_of"), "left")
    names = names.where("_n > 1 or _held is not null").select(F.col("name").alias("_of"), F.least("_first", "_held").alias("_first"))
    names = staged(names, "contested")
    return late(fresh, names).union(late(held, names))


def unique_ids(df: DataFrame, base: str, parts: list[Column], order: str = "ord", taken: DataFrame | None = None) -> DataFrame:
    """``df`` with unique_id, exact in every case; null where the base is null.

    Rows that share ``order`` follow each other by base and parts; a null
    ``order`` comes first.  ``taken`` (base, unique_id) are rows that have their names
    already: they keep them and count among the rows of their base.
    """
    cut = [F.lower(empty_as_null(p)) for p in parts]
    named = df.withColumns({f"_part{i}_": p for i, p in enumerate(cut)} | {"_base": F.col(base)})
    keys = [f"_part{i}_" for i in range(len(cut))]
    # all rows by their place, then by their number among those of one base
    placed = numbered(named, [F.col(order), F.col("_base"), *map(F.col, keys)], "_place", name="places")
    rows = placed.where("_base is not null").select("_base", "_place", *keys)
    counted = numbered(rows, [F.col("_place")], "n", by="_base", name="counts")
    if taken is not None:
        seen = taken.groupBy("base").agg(F.count(F.lit(1)).alias("_seen"))
        counted = counted.join(seen, F.col("_base") == F.col("base"), "left").withColumn("n", F.col("n") + F.coalesce("_seen", F.lit(0))).drop("base", "_seen")
    chain = F.filter(F.array(*keys, F.col("n").cast("string")), lambda p: p.isNotNull())
    first = counted.select(F.col("_place").alias("_row"), F.col("_base").alias("base"), chain.alias("chain"), "n", F.when(F.col("n") == 1, 0).otherwise(1).alias("level"))
    first = staged(first.withColumn("name", proposed(F.col("level"))), "proposals")

    made: list[DataFrame] = []  # a written table for each round
    before = []
    if taken is not None:  # no row comes before those that have their names
        kept = {"_row": F.lit(-1), "base": F.col("base"), "name": F.col("unique_id")}
        before = [taken.where("unique_id is not null").select(*(kept.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in first.schema))]
    fresh = first
    while not fresh.isEmpty():
        again = losers(fresh, reduce(DataFrame.union, before + made) if before or made else None)
        made.append(fresh)
        again = again.withColumn("level", F.col("level") + 1)
        fresh = staged(again.withColumn("name", proposed(F.col("level"))), "proposals")
    later = [r.select("_row", "level", "name") for r in made[1:]]
    names = first.select("_row", F.col("name").alias("_name"))
    if later:  # a row's last proposal is the one that stayed
        last = reduce(DataFrame.union, later).groupBy("_row").agg(F.max_by("name", "level").alias("_last")).withColumnRenamed("_row", "_again")
        names = names.join(last, F.col("_row") == F.col("_again"), "left").select("_row", F.coalesce("_last", "_name").alias("_name"))
    return placed.join(names, F.col("_place") == F.col("_row"), "left").select(*df.columns, F.col("_name").alias("unique_id"))
