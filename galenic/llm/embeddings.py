"""Embedding near-dedup by an epsilon grid order join.

1.  Equal vectors are one class and go on as one, with their number.
2.  Unit vectors are turned to principal dimensions (a rotation, so distances
    stay; it is fitted on a bounded sample and only steers what is skipped).
    Two unit vectors of cosine c lie sqrt(2 - 2c) apart: that is epsilon.
3.  Classes are put in the order of their grid cells of side epsilon on the
    leading dimensions, and the sequence is cut into blocks.  Pairs of blocks
    whose boxes lie further apart than epsilon are never formed.
4.  A pair of blocks is joined by halving its intervals, skipping pairs of
    intervals whose boxes (in all dimensions) are provably distant, counting
    those that are provably near without looking at their pairs, and comparing
    the rest.  Pairs close to the threshold are decided in double precision.
5.  A pair of blocks passes on a sum for each class and a spanning tree of its
    links; sums and components of those are the result.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths do not link, and those
of each length are joined on their own; a row that repeats a vec_id is a vector of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galenic.llm.common import named_components, ranked, runs, staged

#: Dimensions whose cells order the sequence, and whose boxes decide which blocks meet.
CELLS, BOX = 16, 24
#: Vectors the rotation is fitted on, vectors of a block (at least, at most), of an interval that is compared.
FITTED, SMALL_BLOCK, LARGE_BLOCK, LEAF = 5000, 256, 8192, 256
#: No single-precision product of unit vectors is off by as much.
SLACK = 1e-4


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashed(vectors: DataFrame) -> DataFrame:
    """id, size (of a usable vector, else null), cls (its 64-bit hash), raw (its doubles)."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cls, raw = [], [], []
            for v in batch.column("vector"):
                x = None if not v.is_valid or v.values.null_count or not len(v.values) else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if x is None or not np.isfinite(x).all() or not x.any():
                    size.append(None), cls.append(None), raw.append(None)
                    continue
                x = x + 0.0  # no negative zeros
                size.append(len(x))
                cls.append(int(np.uint64(xxhash.xxh64_intdigest(x.tobytes())).view(np.int64)))
                raw.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int32()), pa.array(cls, pa.int64()), pa.array(raw, pa.binary())], ["id", "size", "cls", "raw"])

    return vectors.mapInArrow(run, f"id {kind}, size int, cls bigint, raw binary")


def rotation(classes: DataFrame) -> np.ndarray:
    """Principal directions of a sample of ``FITTED`` classes, the widest first."""
    rows = classes.select("cls", "raw").orderBy(F.xxhash64("cls"), "cls").limit(FITTED).collect()
    x = unit(np.array([np.frombuffer(r["raw"], dtype=np.float64) for r in rows]))
    values, directions = np.linalg.eigh(np.atleast_2d(np.cov(x, rowvar=False)) if len(x) > 1 else np.eye(x.shape[1]))
    return directions[:, np.argsort(-values)]


def placed(classes: DataFrame, turn: np.ndarray, epsilon: float) -> DataFrame:
    """cls, n, raw, cells c0.. and leading coordinates y0.. of every class."""
    wide = min(BOX, len(turn))
    cells = min(CELLS, len(turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.array([np.frombuffer(b, dtype=np.float64) for b in batch.column("raw").to_pylist()]))
            y = x @ turn[:, :wide]
            c = np.floor(y[:, :cells] / epsilon).astype(np.int32)
            columns = [*(pa.array(c[:, k]) for k in range(cells)), *(pa.array(y[:, k]) for k in range(wide))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("cls", "n", "raw")), *columns], ["cls", "n", "raw", *(f"c{k}" for k in range(cells)), *(f"y{k}" for k in range(wide))])

    schema = ["cls bigint", "n bigint", "raw binary", *(f"c{k} int" for k in range(cells)), *(f"y{k} double" for k in range(wide))]
    return classes.select("cls", "n", "raw").mapInArrow(run, ", ".join(schema))


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """lo, hi: blocks (lo = hi too) whose boxes are at most epsilon apart. One
    row for each block comes in; those that share a neighbouring cell of the
    first dimension are looked at."""
    wide = [c[3:] for c in blocks.columns if c.startswith("lo_y")]
    a = blocks.select(*(F.col(c).alias(f"a_{c}") for c in blocks.columns)).withColumn("cell", F.explode(F.sequence("a_lo_c0", "a_hi_c0")))
    b = blocks.select(*(F.col(c).alias(f"b_{c}") for c in blocks.columns)).withColumn("cell", F.explode(F.sequence(F.col("b_lo_c0") - 1, F.col("b_hi_c0") + 1)))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo_{y}") - F.col(f"b_hi_{y}"), F.col(f"b_lo_{y}") - F.col(f"a_hi_{y}")), 2) for y in wide), F.lit(0.0))
    near = a.join(b, "cell").where((F.col("a_block") <= F.col("b_block")) & (gap <= (epsilon + 1e-6) ** 2))
    return near.select(F.col("a_block").alias("lo"), F.col("b_block").alias("hi")).distinct()


class Join:
    """The recursive join of two intervals of the sequence (or of one with itself)."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float, turn: np.ndarray) -> None:
        self.x, self.single, self.weight, self.cosine = x, x.astype(np.float32), weight, cosine
        self.y = x @ turn
        self.far, self.near = np.sqrt(2 - 2 * cosine) + 1e-6, np.sqrt(2 - 2 * cosine) - 1e-6
        self.sums = np.zeros(len(x), dtype=np.int64)
        self.links: list[tuple[int, int]] = []

    def run(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        if a[0] >= a[1] or b[0] >= b[1]:
            return
        if a == b:
            if a[1] - a[0] <= LEAF:
                return self.compare(a, b)
            middle = (a[0] + a[1]) // 2
            self.run((a[0], middle), (a[0], middle))
            self.run((middle, a[1]), (middle, a[1]))
            return self.run((a[0], middle), (middle, a[1]))
        p, q = self.y[a[0] : a[1]], self.y[b[0] : b[1]]
        p0, p1, q0, q1 = p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0)
        gap = np.maximum(0, np.maximum(p0 - q1, q0 - p1))
        if (gap * gap).sum() > self.far**2:
            return None
        reach = np.maximum(p1 - q0, q1 - p0)
        if (reach * reach).sum() < self.near**2:
            self.sums[a[0] : a[1]] += self.weight[b[0] : b[1]].sum()
            self.sums[b[0] : b[1]] += self.weight[a[0] : a[1]].sum()
            self.links += [(a[0], j) for j in range(*b)] + [(i, b[0]) for i in range(*a)]
            return None
        n, m = a[1] - a[0], b[1] - b[0]
        if max(n, m) <= LEAF:
            return self.compare(a, b)
        if n >= m:
            middle = (a[0] + a[1]) // 2
            self.run((a[0], middle), b)
            return self.run((middle, a[1]), b)
        middle = (b[0] + b[1]) // 2
        self.run(a, (b[0], middle))
        return self.run(a, (middle, b[1]))

    def compare(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        if (self.single[a[0] : a[1]] @ self.single[b[0] : b[1]].T).max() < self.cosine - SLACK:
            return
        hit = self.x[a[0] : a[1]] @ self.x[b[0] : b[1]].T >= self.cosine
        if a == b:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.sums[a[0] : a[1]] += hit @ self.weight[b[0] : b[1]]
        if a != b:
            self.sums[b[0] : b[1]] += self.weight[a[0] : a[1]] @ hit
        # a spanning tree: rows and columns take the smallest label they touch until nothing changes
        row, column = np.arange(*a), np.arange(*b)
        top = len(self.x)
        while True:
            new_row = np.minimum(row, np.where(hit, column[None, :], top).min(axis=1))
            new_column = np.minimum(column, np.where(hit, new_row[:, None], top).min(axis=0))
            if (new_row == row).all() and (new_column == column).all():
                break
            row, column = new_row, new_column
        self.links += [(i, int(r)) for i, r in zip(range(*a), row, strict=True) if r != i] + [(j, int(r)) for j, r in zip(range(*b), column, strict=True) if r != j]


def joined(dealt: DataFrame, turn: np.ndarray, cosine: float) -> DataFrame:
    """kind 0: a class (src) and the sum of its links (dst); kind 1: an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["lo", "hi"]):
            cls, n, block = (group.column(k).to_numpy() for k in ("cls", "n", "block"))
            x = unit(np.array([np.frombuffer(b, dtype=np.float64) for b in group.column("raw").to_pylist()]))
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            work = Join(x, n, cosine, turn)
            if lo == hi:
                work.run((0, len(x)), (0, len(x)))
            else:
                middle = int((block == lo).sum())
                work.run((0, middle), (middle, len(x)))
            some = np.flatnonzero(work.sums)
            src = [*cls[some].tolist(), *(int(cls[i]) for i, _ in work.links)]
            dst = [*work.sums[some].tolist(), *(int(cls[j]) for _, j in work.links)]
            kind = [0] * len(some) + [1] * len(work.links)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return dealt.select("lo", "hi", "block", "cls", "n", "raw").mapInArrow(run, "kind int, src bigint, dst bigint")


def of_length(classes: DataFrame, size: int, cosine: float, epsilon: float) -> DataFrame:
    """cls, n_links, component_id of the classes, all vectors of ``size`` components."""
    turn, total = rotation(classes), classes.count()
    cells = [f"c{k}" for k in range(min(CELLS, size))]
    order = ranked(placed(classes, turn, epsilon), *cells, "y0", "cls")
    width = max(SMALL_BLOCK, min(LARGE_BLOCK, -(-total // 16)))
    order = staged(order.withColumn("block", F.expr(f"cast(rank div {width} as int)")), "sequence")
    wide = [f"y{k}" for k in range(min(BOX, size))]
    boxes = staged(order.groupBy("block").agg(*(f(c).alias(f"{e}_{c}") for c in ["c0", *wide] for e, f in (("lo", F.min), ("hi", F.max)))), "boxes")
    pairs = staged(block_pairs(boxes, epsilon), "pairs")
    sides = pairs.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("at"))
    dealt = order.join(sides, F.col("block") == F.col("at")).repartition("lo", "hi").sortWithinPartitions("lo", "hi", "block", "rank")
    found = staged(joined(dealt, turn, cosine), "found")
    sums = found.where("kind = 0").groupBy(F.col("src").alias("cls")).agg(F.sum("dst").alias("others"))
    named = named_components(classes, found.where("kind = 1").select("src", "dst"))
    known = classes.select("cls", "n").join(named, "cls").join(sums, "cls", "left")
    return staged(known.select("cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "known")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: vectors of cosine
    ``cosine`` or more are linked; component_id is the smallest id reachable."""
    epsilon = float(np.sqrt(2 - 2 * cosine))
    rows = staged(hashed(vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))), "vectors")
    classes = staged(rows.where("cls is not null").groupBy("size", "cls").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw")), "classes")
    sizes = [r["size"] for r in classes.select("size").distinct().orderBy("size").collect()]  # a few lengths
    parts = [of_length(classes.where(F.col("size") == size), size, cosine, epsilon).withColumn("size", F.lit(size)) for size in sizes]
    plain = rows.select("id", "cls", "size")
    if not parts:
        out = plain.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        out = plain.join(reduce(DataFrame.union, parts), ["cls", "size"], "left")
        out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached(x, y) AS (SELECT x, y FROM linked UNION SELECT r.x, l.y FROM reached r JOIN linked l ON l.x = r.y),
low AS (SELECT x, min(y) AS y FROM reached GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM linked GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""
