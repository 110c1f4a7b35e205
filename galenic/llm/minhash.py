"""MinHash near-dedup by a signature-coordinate inverted join.

1.  Every text gets its set of word shingles and a signature of ``K`` minima.
    Texts of equal sets are one class and go on as one.
2.  Classes are posted under each (coordinate, value) pair.  Pairs are counted,
    and a class's postings are ordered by rarity.  Two classes that agree on at
    least t of K coordinates share one of the K - t + 1 rarest of either
    (prefix), so only those are posted; classes with fewer than t shared values
    are skipped altogether, and frequent values are skipped with them.
3.  In a list of postings collisions are counted by merging, coordinate by
    coordinate, skipping postings of most rows at first; pairs with t or more
    are candidates.  Long lists are dealt out in bounded blocks that all meet
    one member of the list, and only what that member does not join goes on to
    pairs of blocks (``common.linked``).
4.  In each cluster of candidates full sets are compared, in the same way; of
    large clusters, what the first member does not join goes on only if it shares
    one of its rarest shingles (prefix) with another.  Components of those links are
    the result.

t lies 4.5 standard deviations below what a pair at the threshold expects, so
a pair is missed with a probability of about one in 100,000; pairs are never
taken for links without their full sets.

Edge cases: null and empty texts, and texts of blanks, have no shingles and
link with nothing; a text with fewer words than a shingle is one shingle; rows
that repeat a doc_id are compared by their own texts and share the id; a row
without a doc_id is linked by its text like any other, its group has the smallest
doc_id there is in it (null if there is none); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galenic.llm.common import WORD, Linked, blocked, components, crossing, linked, named_components, runs, spanning, staged

K = 64
SLICE = 256
#: Members of a block, in lists of postings and in clusters, and shingles of a block in clusters.
LIST_ROWS, CLUSTER_ROWS, CLUSTER_SHINGLES = 512, 128, 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


class WordHash(dict):
    """Word as bytes -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, width: int, known: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    wide = min(width, len(h))
    n = len(h) - wide + 1
    out = np.full(n, wide, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(wide):
            out = (out ^ h[j : j + n]) * _MIX
            out ^= out >> _SHIFT
    return np.unique(out)


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, K, dtype=np.uint64)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """K minima of 32 bits, as signed integers."""
    low = np.full(K, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            np.minimum(low, (found[at : at + 2048, None] * a[None, :] + b[None, :]).min(axis=0), out=low)
    return (low >> _SHIFT).astype(np.uint32).view(np.int32)


def class_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def agreement(percent: int) -> int:
    """t: coordinates on which a candidate pair agrees at least."""
    p = percent / 100
    return max(1, math.floor(K * p - 4.5 * math.sqrt(K * p * (1 - p))))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, cls (null without shingles), sig of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = WordHash(), multipliers()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, cls, sig = [], [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text, width, known)
                    n.append(len(found))
                    cls.append(class_of(found) if len(found) else None)
                    sig.append(signature(found, a, b) if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "mark", "n_shingles", "cls", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, f"doc_id {kind}, mark bigint, n_shingles bigint, cls bigint, sig array<int>")


def postings(classes: DataFrame, t: int) -> DataFrame:
    """value, cls: the rarest shared (coordinate, value) pairs of each class with t shared ones or more."""
    posted = classes.select("cls", F.posexplode("sig").alias("at", "low"))
    posted = posted.select("cls", (F.col("at").cast("long") * 4294967296 + F.col("low").cast("long") + 2147483648).alias("value"))
    common = posted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posted.join(common, "value")
    each = Window.partitionBy("cls")
    shared = shared.select("cls", "value", F.count(F.lit(1)).over(each).alias("m"), F.row_number().over(each.orderBy("n", "value")).alias("rank"))
    return shared.where((F.col("m") >= t) & (F.col("rank") <= F.col("m") - t + 1)).select("value", "cls")


def collisions(signs: np.ndarray, t: int) -> np.ndarray:
    """Which rows agree on t coordinates or more, by merging the postings of each (coordinate, value).

    Every posting of two rows or more adds one to the pairs in it; a posting of
    over half of the rows is skipped at first, and counted only for the pairs
    that can still reach t with it.  Few rows are held against each other at once.
    """
    n, k = signs.shape
    if n <= 64:
        return (signs[:, None, :] == signs[None, :, :]).sum(axis=2) >= t
    count = np.zeros((n, n), dtype=np.uint8)
    skipped = []
    for at in range(k):
        values, where, size = np.unique(signs[:, at], return_inverse=True, return_counts=True)
        if len(values) == n:
            continue
        if 2 * size.max() > n:
            skipped.append(at)
            continue
        shared = np.flatnonzero(size[where] > 1)
        count[np.ix_(shared, shared)] += where[shared, None] == where[None, shared]
    if skipped:
        a, b = np.nonzero(count >= max(0, t - len(skipped)))
        for at in range(0, len(a), 1 << 18):
            x, y = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
            count[x, y] += (signs[x][:, skipped] == signs[y][:, skipped]).sum(axis=1).astype(np.uint8)
    found = count >= t
    np.fill_diagonal(found, True)
    return found


def candidates(posted: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """src, dst: edges that join what the pairs agreeing on t coordinates or more do."""

    def compare(dealt: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Linked()
            for group in runs(batches, ["value", "block", "other"]):
                if group.num_rows < 2:
                    continue
                cls = group.column("cls").to_numpy()
                signs = group.combine_chunks().column("sig").chunk(0).flatten().to_numpy().reshape(-1, K)
                found = collisions(signs, t) & crossing(group.column("side").to_numpy())
                several = group.column("_blocks")[0].as_py() > 1
                new = [(int(cls[i]), int(cls[j])) for i, j in spanning(found) if several or known.new(int(cls[i]), int(cls[j]))]
                if new:
                    yield pa.RecordBatch.from_pydict({"src": pa.array([a for a, _ in new], pa.int64()), "dst": pa.array([b for _, b in new], pa.int64())})

        return dealt.select("value", "block", "other", "side", "_blocks", "cls", "sig").mapInArrow(run, "src bigint, dst bigint")

    dealt = blocked(posted, "value", "cls", LIST_ROWS).join(classes.select("cls", "sig"), "cls")
    return linked(staged(dealt, "lists"), "value", "cls", LIST_ROWS, compare)


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    out = np.zeros((n, n), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    wide = 4096
    for at in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(column, [at, at + wide])
        dense = np.zeros((n, wide), dtype=np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        out += (dense @ dense.T).astype(np.int64)
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def links(docs: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """src, dst: edges that join what the links confirmed on full sets do. ``clusters``: one (the doc_id and
    mark of the row that stands for a class, either may be null), cls, n_shingles, cluster, again (there are several such rows)."""
    dealt = blocked(clusters, "cluster", "cls", CLUSTER_ROWS, "n_shingles", CLUSTER_SHINGLES)
    several = not clusters.where("again").isEmpty()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    met = rows["doc_id"].eqNullSafe(F.col("one.doc_id")) & (rows["mark"] == F.col("one.mark"))
    texts = rows.join(dealt.select("one", "cls", "cluster", "_mine", "_blocks"), met).drop("doc_id", "mark", "one")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [shingles(t, width, known) for t in part.column("text").to_pylist()]
                same = np.array([class_of(f) if len(f) else 0 for f in found], dtype=np.int64) == part.column("cls").to_numpy()
                out = part.select(["cls", "cluster", "_mine", "_blocks"]).append_column("found", pa.array([f.tobytes() for f in found], pa.binary()))
                yield out.filter(pa.array(same))

    full = texts.mapInArrow(sets, "cls bigint, cluster bigint, _mine int, _blocks int, found binary")
    full = staged(full.dropDuplicates(["cls"]) if several else full, "sets")

    def compare(dealt: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in runs(batches, ["cluster", "block", "other"]):
                if group.num_rows < 2:
                    continue
                cls = group.column("cls").to_numpy()
                inter = overlap([np.frombuffer(b, dtype=np.uint64) for b in group.column("found").to_pylist()])
                n = np.diag(inter)
                found = (100 * inter >= percent * (n[:, None] + n[None, :] - inter)) & crossing(group.column("side").to_numpy())
                tree = spanning(found)
                yield pa.RecordBatch.from_pydict({"src": pa.array([cls[i] for i, _ in tree], pa.int64()), "dst": pa.array([cls[j] for _, j in tree], pa.int64())})

        return dealt.select("cluster", "block", "other", "side", "cls", "found").mapInArrow(run, "src bigint, dst bigint")

    return linked(full, "cluster", "cls", CLUSTER_ROWS, compare, lambda rest: prefixed(full, rest, percent))


def prefixed(full: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """cluster, cls, left: members of clusters that may be linked with one of ``rest``, and whether they are among it.

    A set of n shingles that is linked with another shares at least need = percent / 100
    of n with it, and with one that is not smaller 2 * percent / (100 + percent) of n; so
    the two share one of the n - need + 1 shingles that come first in any order, and
    it is among still fewer of the smaller set.  The order is by how many of ``rest``
    hold a shingle: what none of them holds comes first and meets nothing.
    """

    def shingled(some: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    sets = [np.frombuffer(b, dtype=np.int64) for b in part.column("found").to_pylist()]
                    n = np.array([len(s) for s in sets])
                    owner = pa.array(np.repeat(np.arange(len(sets)), n))
                    yield pa.RecordBatch.from_arrays([part.column("cluster").take(owner), part.column("cls").take(owner), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], ["cluster", "cls", "n", "shingle"])

        return some.select("cluster", "cls", "found").mapInArrow(run, "cluster bigint, cls bigint, n bigint, shingle bigint")

    key = ["cluster", "shingle"]
    counts = staged(shingled(full.join(rest, ["cluster", "cls"], "left_semi")).groupBy(*key).agg(F.count(F.lit(1)).alias("held")), "held")
    of_large = full.join(rest.select("cluster").distinct(), "cluster", "left_semi")
    shared = shingled(of_large).join(counts, key)
    each = Window.partitionBy("cluster", "cls")
    place = F.col("n") - F.count(F.lit(1)).over(each) + F.row_number().over(each.orderBy("held", "shingle"))
    within = lambda a, b: F.col("_place") <= F.col("n") - F.ceil(F.col("n") * a / b) + 1  # noqa: E731  the product first, so that whole shares stay whole
    first = shared.withColumn("_place", place).where(within(percent, 100)).select(*key, "cls", within(2 * percent, 100 + percent).alias("few"))
    left = rest.select(F.col("cluster").alias("_cluster"), F.col("cls").alias("_cls"))
    first = first.join(left, (F.col("cluster") == F.col("_cluster")) & (F.col("cls") == F.col("_cls")), "left").select(*key, "cls", "few", F.col("_cls").isNotNull().alias("left"))
    first = staged(first, "prefixes")
    met = first.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max("left").alias("_any"), F.max("few").alias("_few")).where("_n > 1 and _any and _few").select(*key)
    return first.join(met, key, "left_semi").groupBy("cluster", "cls").agg(F.max("left").alias("left"))


def grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """What ``near_duplicates`` gives, with mark and part (the component, null without shingles) of every row."""
    t = agreement(percent)
    rows = staged(signatures(docs, width), "signatures")
    # rows of one doc_id and text are one here, so that what stands for a class is told apart from the others
    each = rows.where("cls is not null").groupBy("cls", "doc_id", "mark").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), (F.count(F.lit(1)) > 1).alias("again"))
    one = F.struct("doc_id", "mark")
    classes = each.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min(one).alias("one"), F.min_by("again", one).alias("again"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = staged(classes, "classes")
    found = staged(candidates(staged(postings(classes, t), "postings"), classes, t), "candidates")
    clusters = components(found).withColumnRenamed("component", "cluster")
    members = staged(classes.select("one", "again", "cls", "n_shingles").join(clusters, F.col("cls") == F.col("node")).drop("node"), "clusters")
    named = named_components(classes.select("cls", F.col("doc_id").alias("first")), links(docs, members, width, percent))
    out = rows.select("doc_id", "mark", "n_shingles", "cls").join(named, "cls", "left")
    out = out.select("doc_id", "mark", "part", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: documents whose sets
    of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or
    more are linked; component_id is the smallest doc_id reachable."""
    return grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which near-duplicates keep one: that with the
    smallest doc_id, and of several of that the text of the smallest hash, once.
    Other texts of the same doc_id are judged for themselves.  Rows without a
    doc_id go with their group like any other, and stay if no row of it has one: of
    them the text of the smallest hash; if they have no words, all."""
    found = grouped(docs, **options).where("kept")
    kept = found.where("doc_id is not null or part is not null").groupBy("doc_id", "part").agg(F.min("mark").alias("_mark"))
    kept = kept.select(F.struct("doc_id", F.col("_mark").alias("mark")).alias("_kept")).distinct()
    rows = docs.withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("mark")))
    one = rows.join(kept, F.col("_row").eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["_row"])
    bare = docs.where(F.col("doc_id").isNull() & (F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0))
    return one.select(*docs.columns).union(bare)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
linked AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
reached(x, y) AS (
  SELECT x, y FROM linked UNION SELECT r.x, l.y FROM reached r JOIN linked l ON l.x = r.y),
low AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.x = d.doc_id
"""
