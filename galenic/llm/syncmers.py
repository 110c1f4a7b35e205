"""Document fingerprints from closed syncmers. DataFrame functions only.

A text is a sequence of code points, white space counting as blanks.  A run of
k of them is an anchor if the smallest hash of its inner runs of s is that of
the first or the last.  Whether a run is an anchor depends on nothing around
it, so an edit changes only the anchors it touches.  Every stretch of 2k - s - 1
code points holds an anchor.  k and s are the same for all texts; a text in which
no run is an anchor, as it is shorter than that, is one anchor as a whole.

A fingerprint keeps all anchors, hash and place.  Anchors of two texts match by
hash and by order of place: the first place of a hash with the first, the second
with the second, and so on.  likeness is the share of the anchors of both that match.

As anchors are free of context, an edited text is not cut again: it has the
anchors of the part that stays, those of the part put in, moved, and those
across the joint, which alone are looked for.  Texts are dealt out once, by
range of doc_id, and each meets its successor in its range; the first text of
a range is also sent to the range above, and the largest of all to the lowest.

``anchors`` and ``shared_places`` do the same over words.

Edge cases: null counts as empty; a text without words has the empty
fingerprint, and two empty fingerprints have likeness 1; short texts (see above)
are alike if they are equal, and not at all else; rows that repeat a doc_id are fingerprinted row by
row in the order of a hash of their texts, each followed by the next row; a row
without a doc_id has no next document; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galenic.llm.common import SPACE

#: Words of a run of ``anchors``.
RUN = 5
#: Code points of a run and of its inner runs, and of a text that has anchors in any case, and a run in either half.
K, S = 16, 4
SURE = 2 * K
#: Ranges of doc_id for each shuffle partition.
RANGES = 4


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(text: Column) -> Column:
    """array<struct<hash, at>>: the anchors of a text and the place of their first word."""

    def closed(h: Column) -> Column:
        def edge(i: Column) -> Column:
            inner = F.least(*(F.get(h, i + j) for j in range(1, RUN - 1)))
            return F.least(F.get(h, i), F.get(h, i + (RUN - 1))) <= inner

        places = F.when(F.size(h) >= RUN, F.filter(F.sequence(F.lit(0), F.size(h) - RUN), edge)).otherwise(F.expr("cast(array() as array<int>)"))
        found = F.transform(places, lambda i: F.struct(_hash(*(F.get(h, i + j) for j in range(RUN))).alias("hash"), i.alias("at")))
        whole = F.array(F.struct(_hash(h).alias("hash"), F.lit(0).alias("at")))
        return bound(found, lambda f: F.when((F.size(f) == 0) & (F.size(h) > 0), whole).otherwise(f))

    return bound(F.transform(word_array(text), lambda w: F.xxhash64(w)), closed)


# The expressions over code points are written as SQL text: they are large, and
# as one text each they are parsed at once.


def let(value: str, name: str, use: str) -> str:
    """``use``, an expression of ``name``, with ``value`` computed once, however often ``use`` looks at it."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _packed(value: str, place: str) -> str:
    return f"(shiftleft(({value}) & 4294967295, 32) | cast({place} as bigint))"


def _runs(points: str) -> str:
    """array<bigint>: the runs of the code points that are anchors, in the order of their hashes; hash in the upper, place in the lower half."""
    wide = K - S
    inner = ", ".join(f"get({points}, i + {j})" for j in range(S))
    hashes = f"transform(sequence(0, size({points}) - {S}), i -> xxhash64({inner}))"
    # m has the smaller of each two neighbours, so that half as many values decide; of most runs the first few do
    pairs = "zip_with(g, slice(g, 2, size(g)), (a, b) -> least(a, b))"
    between = [*range(1, wide - 1, 2), *[wide - 2] * (wide % 2 == 0)]
    least = lambda v: " and ".join(f"{v} <= get(m, i + {j})" for j in between)
    first, last = "get(g, i)", f"get(g, i + {wide})"
    closed = f"case when {first} <= {last} then {least(first)} else {least(last)} end"
    whole = ", ".join(f"get(g, i + {j})" for j in range(0, wide + 1, S))
    found = f"sort_array(transform(filter(sequence(0, size(g) - {wide + 1}), i -> {closed}), i -> {_packed(f'xxhash64({whole})', 'i')}))"
    return f"case when size({points}) >= {K} then {let(hashes, 'g', let(pairs, 'm', found))} else cast(array() as array<bigint>) end"


def code_points(text: str) -> str:
    for c in (r"\t", r"\n", r"\u000b", r"\u000c", r"\r"):  # whole texts are searched for each, which costs less than a look-up for each character
        text = f"replace({text}, '{c}', ' ')"
    return f"split({text}, '')"


def blank(text: str) -> str:
    # from the left alone, which ends at the first character that is no blank
    return rf"(trim(leading ' \t\n\u000b\u000c\r' from {text}) = '')"


def places(text: str) -> str:
    """array<bigint>: all anchors of a text, in the order of their hashes."""
    either = let(_runs("c"), "f", f"case when size(f) > 0 then f else array({_packed('xxhash64(c)', '0')}) end")
    return f"case when {blank(text)} then cast(array() as array<bigint>) else {let(code_points(text), 'c', either)} end"


def spliced(own: str, text: str, stay: str, after: str, other: str, put: str) -> str:
    """Anchors of the first ``stay`` code points of ``text`` and the
    first ``put`` of ``after``, from those of either (``own``, ``other``)."""
    joint = f"concat(right(left({text}, {stay}), {K - 1}), left(left({after}, {put}), {K - 1}))"
    across = f"transform({let(code_points(joint), 'c', _runs('c'))}, x -> x + n.stay - {K - 1})"
    left = f"filter({own}, x -> (x & 4294967295) <= n.own)"
    right = f"transform(filter({other}, x -> (x & 4294967295) <= n.other), x -> x + n.stay)"
    # bound: the lengths of whole texts are counted once and not for each anchor
    ends = f"named_struct('stay', cast({stay} as bigint), 'own', cast({stay} as bigint) - {K}, 'other', cast({put} as bigint) - {K})"
    return let(ends, "n", f"sort_array(concat({left}, {across}, {right}))")


def fingerprint(found: Column, compact: bool = False) -> Column:
    """Anchors in the order of their hashes as text: eight hexadecimal digits of the hash and eight of the place of each, with commas between.

    ``compact`` leaves places and commas out: half the size, enough to tell how alike texts are, not where.
    """
    if compact:
        return F.array_join(F.transform(found, lambda p: F.left(F.lpad(F.hex(p), 16, "0"), F.lit(8))), "")
    # all but one in sixteen have sixteen digits as they are
    return F.array_join(F.transform(found, lambda p: F.when((p < 0) | (p >= 1 << 60), F.hex(p)).otherwise(F.lpad(F.hex(p), 16, "0"))), ",")


def counted(found: str) -> str:
    """array<bigint>: for each anchor, in the order of their hashes, a number
    made of its hash and how many places of the hash come before."""
    mark = "xxhash64(shiftright({}, 32), {})"
    first = f"transform(p, (x, i) -> case when shiftright(x, 32) = shiftright(get(p, i - 1), 32) then null else {mark.format('x', 0)} end)"
    last = "coalesce(get(starts, j + 1), size(p)) - start - 1"
    # most hashes have one place, and need no sequence; nor do texts in which all have
    group = f"case when {last} = 0 then array(get(m, start)) else transform(sequence(0, {last}), o -> {mark.format('get(p, start)', 'o')}) end"
    each = let("filter(sequence(0, size(p) - 1), i -> get(m, i) is not null)", "starts", f"flatten(transform(starts, (start, j) -> {group}))")
    return let(found, "p", let(first, "m", f"case when exists(m, x -> x is null) then {each} else m end"))


def both(a: str, b: str) -> str:
    """How many anchors of two results of ``counted`` match."""
    return f"size(array_intersect({a}, {b}))"


def likeness(a: str, b: str, n: str | None = None) -> str:
    """0 to 1, of two results of ``counted``: of the anchors of both, the share that matches.

    ``n`` names a column of what ``both`` gives, which as a column of its own is
    compiled; within a look at an array's elements nothing is.
    """
    share = "case when size({0}) = 0 and size({1}) = 0 then 1D else {2} / (size({0}) + size({1}) - {2}) end"
    if n:
        return share.format(a, b, n)
    return let(f"named_struct('a', {a}, 'b', {b})", "x", let(both("x.a", "x.b"), "n", share.format("x.a", "x.b", "n")))


def shared_places(a: Column, b: Column) -> Column:
    """array<struct<at, other, shift>>: the anchors of ``a`` that occur in ``b``,
    with the place there (the first) and how far it is shifted."""
    first = F.map_from_entries(F.transform(F.array_distinct(b["hash"]), lambda h: F.struct(h, F.array_min(F.transform(F.filter(b, lambda x: x["hash"] == h), lambda x: x["at"])))))
    found = F.filter(a, lambda x: F.map_contains_key(first, x["hash"]))
    return F.transform(found, lambda x: F.struct(x["at"].alias("at"), F.try_element_at(first, x["hash"]).alias("other"), (F.try_element_at(first, x["hash"]) - x["at"]).alias("shift")))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with own, the anchors of text, and marks, the same ``counted``."""
    return rows.withColumn("own", F.expr(places("text"))).withColumn("marks", F.expr(counted("own")))


def below(bounds: Column, value: Column, n: int) -> Column:
    """How many of the n ascending ``bounds`` are below ``value``, in as many steps as n has binary digits."""

    def step(low: Column, width: Column) -> Column:
        far = low + width
        return F.when((far <= n) & (F.get(bounds, far - 1) < value), far).otherwise(low)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length())))), F.lit(0), step)


def followed(rows: DataFrame) -> DataFrame:
    """doc_id, text, own (anchors), marks (``counted``) of every row, and with
    next_ what the next one in descending order has; after the last comes the first.

    Ids alone are dealt out by range first, to learn the largest id of each
    range (a row for each range reaches the driver); then every text travels
    once to its range and, if it heads one, to the range above as well.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES
    ids = rows.select("doc_id").repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("top"))
    tops = [r["top"] for r in ids.orderBy("part").collect()]
    if not tops:
        tops = [None]
    kind = rows.schema["doc_id"].dataType
    bounds = F.from_json(F.lit(json.dumps(tops, default=str)), T.ArrayType(kind))  # one constant
    mark = F.xxhash64(F.lit(11), "text")
    part = below(bounds, F.col("doc_id"), len(tops))
    above = F.pmod(F.col("part") + 1, F.lit(len(tops)))
    dealt = rows.select("doc_id", "text", mark.alias("mark"), part.alias("part"))
    # of the rows of a range's largest id, the one that comes first heads it
    heads = dealt.where(F.col("doc_id") == F.get(bounds, F.col("part"))).groupBy("part").agg(F.min_by(F.struct("doc_id", "text"), "mark").alias("head"), F.min("mark").alias("mark"))
    heads = heads.select("head.doc_id", "head.text", "mark", above.cast("int").alias("part"), F.lit(True).alias("copy"))
    dealt = dealt.withColumn("copy", F.lit(False)).union(heads).repartition("part")
    dealt = marked(dealt)
    order = Window.partitionBy("part").orderBy("copy", F.desc("doc_id"), "mark")
    after = F.lead(F.struct("text", "own", "marks")).over(order)
    found = dealt.withColumn("after", after).where("not copy")
    return found.select("doc_id", "text", "own", "marks", F.col("after.text").alias("next"), F.col("after.own").alias("next_own"), F.col("after.marks").alias("next_marks"))


def fingerprints(docs: DataFrame, compact: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = followed(rows.where("doc_id is not null"))
    alone = marked(rows.where("doc_id is null"))
    none = {"next": "string", "next_own": "array<bigint>", "next_marks": "array<bigint>"}
    found = found.union(alone.select("doc_id", "text", "own", "marks", *(F.lit(None).cast(kind).alias(name) for name, kind in none.items())))
    half, after = "cast(length(text) div 2 as int)", "coalesce(next, '')"
    found = found.withColumn("edited", F.expr(f"concat(left(text, length(text) - {half}), left({after}, {half}))"))
    whole = " and ".join(f"length({c}) >= {SURE} and not {blank(c)}" for c in ("text", "edited", "next"))
    splice = spliced("own", "text", f"length(text) - {half}", after, "next_own", f"least({half}, length({after}))")
    found = found.withColumn("new", F.expr(f"case when next is not null and {whole} then {splice} else {places('edited')} end"))
    found = found.withColumn("new_marks", F.expr(counted("new")))
    found = found.withColumn("n_edited", F.expr(both("marks", "new_marks"))).withColumn("n_next", F.expr(both("marks", "next_marks")))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own"), compact).alias("fingerprint"),
        fingerprint(F.col("new"), compact).alias("edited_fingerprint"),
        F.expr(likeness("marks", "new_marks", "n_edited")).alias("near_edited"),
        F.expr(f"case when next is null then 0D else {likeness('marks', 'next_marks', 'n_next')} end").alias("near_next"),
    )
