"""Helpers shared by the training-data operators.

* ``staged``      cuts lineage with a table written under ``spark.checkpoint.dir``.
* ``components``  connected components of an edge table, distributed.
* ``blocked`` and ``linked`` deal the members of (possibly hot) groups out to
  bounded blocks, so that no task ever holds a whole group.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: blank, and tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


#: Rows of an Arrow batch: some megabytes of texts, so that workers stay small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; where that is unset (tests, a local
    session) a folder in the warehouse is taken and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends
    here, a lost executor costs no recomputation, and every later reader sees
    the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; 0 is the held-out fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns with clashing names never reach
    an operator's own plan."""
    return df.select(*names)


# -- connected components ----------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst long): component
    is the smallest node reachable.

    Each round every node points to its smallest neighbour, pointers are
    followed twice, and the edges are contracted along them: ends are replaced,
    loops and repeats go.  Edges shrink by a factor each round, so the work is
    that of the first few.  Sums are partial aggregates and joins are plain
    shuffles of two written tables, so a node with very many edges is split by
    adaptive execution.  Each round ends in written tables.
    """
    both = edges.select("src", "dst").where("src <> dst")
    left = staged(both.union(both.select("dst", "src")).distinct(), "edges")
    found = left.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    for _ in range(rounds):
        if left.isEmpty():
            return found
        up = left.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("parent"))
        for _ in range(2):
            up = staged(up, "pointers")
            above = up.select(F.col("node").alias("key"), F.col("parent").alias("top"))
            up = up.join(above, F.col("parent") == F.col("key")).select("node", F.col("top").alias("parent"))
        up = staged(up, "pointers")
        found = found.join(up, found["component"] == up["node"], "left").select(found["node"], F.coalesce("parent", "component").alias("component"))
        found = staged(found, "labels")
        one = left.join(up, F.col("src") == F.col("node")).select(F.col("parent").alias("a"), "dst")
        two = one.join(up, F.col("dst") == F.col("node")).select(F.col("a").alias("src"), F.col("parent").alias("dst"))
        left = staged(two.where("src <> dst").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


# -- bounded blocks of hot groups ----------------------------------------------


def blocked(members: DataFrame, group: str, member: str, rows: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """``members`` of groups of two or more, with _mine (a block) and _blocks (how many the group has).

    A group gets a block for each ``rows`` members, and for each ``most`` of
    summed ``weight`` if that is more; a member's block is a hash of its id.
    ``members`` should be a written table: it is read twice.
    """
    n = F.ceil(F.count(F.lit(1)) / rows)
    if weight:
        n = F.greatest(n, F.ceil(F.sum(weight) / most))
    counts = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), n.cast("int").alias("_blocks")).where("_n > 1")
    counts = staged(counts.select(F.col(group).alias("_g"), "_blocks"), "blocks")
    found = members.join(counts, members[group] == counts["_g"]).drop("_g")
    return found.withColumn("_mine", F.pmod(F.xxhash64(F.lit(7), member), F.col("_blocks").cast("long")).cast("int"))


#: Blocks of what is left of a group up to which every other member just meets them all.
FEW = 2
#: What a block holds of a group: members alone, members to be held against others, and those others.
ALONE, LEFT, RIGHT = 0, 1, 2


def linked(
    dealt: DataFrame,
    group: str,
    member: str,
    rows: int,
    compare: Callable[[DataFrame], DataFrame],
    near: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """src, dst: edges that join the members of each group as all links within it do.

    ``dealt`` is a written table of ``blocked`` with what ``compare`` needs;
    ``compare`` gets it with side, block and other added, the rows of a block
    in one task (``together``), and gives edges of it: among members that are
    ALONE all, between LEFT and RIGHT all that cross.  Edges lead to the first
    row of their part in a block (``spanning``), and in groups of several blocks
    (_blocks over 1) none is left out, even if it follows from others.

    1.  Within each block of a group; a group of several blocks sends one member
        to all of them, so most members are joined through it.  Every row
        travels once.
    2.  What is not joined with that member is held against all others of its
        group, in pairs of blocks.  In a group of near copies little or nothing
        is left, and rows are copied as often as blocks of that little.  In a
        group whose members are not alike much is left.  Where it is more than
        ``FEW`` blocks, ``near`` gets those members (group, member) and gives all
        members (and left, whether they are among them) that a link with one of
        them is possible for; the others stay out.
    """
    many = dealt.where("_blocks > 1")
    heads = many.groupBy(group).agg(F.min(member).alias("_head"))
    head = many.join(heads, group).where(F.col(member) == F.col("_head")).drop("_head")
    head = head.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).where("block <> _mine")
    alone = dealt.withColumn("block", F.col("_mine")).unionByName(head.select(*dealt.columns, "block"))
    first = staged(compare(together(alone.withColumn("side", F.lit(ALONE)).withColumn("other", F.lit(-1)), group, member)), "first")
    if many.isEmpty():
        return first
    # the head comes first in its blocks, so what a block joins with it is an edge to it
    whose = many.join(heads, group).where(F.col(member) != F.col("_head")).select(group, member, "_head")
    found = first.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    rest = whose.join(found, (F.col(member) == F.col("_src")) & (F.col("_head") == F.col("_dst")), "left_anti").select(group, member)
    # both tables of members: those left over, in blocks of their own, and all, in the blocks they have
    rest = staged(rest, "rest")
    counted = lambda: staged(rest.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_rest")), "sizes")
    sizes = counted()
    wide = sizes.where(F.col("_rest") > FEW).select(group)
    if near and not wide.isEmpty():
        found = staged(near(rest.join(wide, group, "left_semi").select(group, member)), "near")
        rest = staged(rest.join(wide, group, "left_anti").select(group, member).union(found.where("left").select(group, member)), "rest")
        sizes = counted()
        # as many blocks fewer as there are members fewer
        before = many.groupBy(group).agg(F.count(F.lit(1)).alias("_all"))
        share = found.groupBy(group).agg(F.count(F.lit(1)).alias("_some")).join(before, group)
        fewer = many.join(found.select(group, member), [group, member], "left_semi").join(share, group)
        fewer = fewer.withColumn("_blocks", F.ceil(F.col("_blocks") * F.col("_some") / F.col("_all")).cast("int")).withColumn("_mine", F.pmod("_mine", "_blocks"))
        many = staged(many.join(wide, group, "left_anti").unionByName(fewer.select(*dealt.columns)), "many")
    if sizes.isEmpty():
        return first
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = many.join(rest, [group, member], "left_semi").join(sizes, group)
    left = left.withColumn("block", F.pmod(F.xxhash64(F.lit(9), member), F.col("_rest").cast("long")).cast("int")).withColumn("other", spread("_blocks")).withColumn("side", F.lit(LEFT))
    right = many.join(sizes, group).withColumn("block", spread("_rest")).withColumn("other", F.col("_mine")).withColumn("side", F.lit(RIGHT))
    pairs = left.unionByName(right).drop("_rest")
    return first.union(staged(compare(together(pairs, group, member)), "second"))


def together(pairs: DataFrame, group: str, member: str) -> DataFrame:
    """The rows of a block, or of a pair of blocks, in one task, next to each other, in the order of ``member``."""
    return pairs.repartition(group, "block", "other").sortWithinPartitions(group, "block", "other", member)


def crossing(side: np.ndarray) -> np.ndarray:
    """Which pairs of rows a comparison of ``linked`` may join."""
    left, right = side != RIGHT, side != LEFT
    return left[:, None] & right[None, :] | right[:, None] & left[None, :]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal ``keys`` in sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Linked:
    """What a task has linked so far: tells new edges from those that follow
    from earlier ones. Forgets (and so repeats itself) beyond a bound."""

    def __init__(self, most: int = 500_000) -> None:
        self.up: dict[int, int] = {}
        self.most = most

    def top(self, x: int) -> int:
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def new(self, a: int, b: int) -> bool:
        if len(self.up) > self.most:
            self.up.clear()
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, smallest member of its part) of a symmetric boolean matrix."""
    n = len(links)
    label = np.arange(n)
    links = links | np.eye(n, dtype=bool)
    while True:
        low = np.where(links, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            return [(i, int(r)) for i, r in enumerate(label) if i != r]
        label = low


def named_components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """cls, part, component_id, a written table: ``classes`` (cls, first) joined up by
    ``edges`` (src, dst of cls); part is one number for each component, component_id the smallest ``first`` reachable."""
    parts = components(edges)
    joined = classes.select("cls", "first").join(parts, F.col("cls") == F.col("node"), "left")
    joined = staged(joined.select("cls", "first", F.coalesce("component", "cls").alias("part")), "parts")
    firsts = staged(joined.groupBy("part").agg(F.min("first").alias("component_id")), "firsts")
    return staged(joined.join(firsts, "part").select("cls", "part", "component_id"), "named")


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with rank (long, from 0) in the order of ``keys``, without one task
    sorting it all: dealt out by range, counted by range, numbered within."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    found = dealt.withColumn("_row", inside).join(counts, F.col("_part") == F.col("_at"))
    return found.withColumn("rank", F.col("_start") + F.col("_row") - 1).drop("_part", "_at", "_row", "_start")
