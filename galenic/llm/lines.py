"""Line dedup by a segment-partition edit join. DataFrame functions only.

A line goes when an equal line, or one within ``edits`` edits (a character put
in, left out or exchanged; one, unless asked otherwise), stands earlier: in a
smaller doc_id, or further up in the same document.  Lines are compared without
blanks at their ends, and only from ``min_chars`` characters on; shorter ones stay.

1.  Lines are split into edits + 1 segments, by positions that depend on the
    length.  Of two lines within the threshold one segment of the shorter stands
    in the longer, at most as far off as the edits before and after it allow.
    So each line is posted under its segments with its own length, and probes
    the indexes of its own and up to ``edits`` smaller lengths.
2.  Postings that meet no other line are left out; what remains is few, and its
    texts are fetched.  Bitmaps of a fixed size keep the rest from the shuffle.
3.  Where many lines share a segment, what is left of them without it is
    split in the same way, again and again, until few share all of it or no more
    characters are left than edits are allowed: such lines of one length are
    within the threshold of each other, and each is held against the earliest.
4.  Pairs that meet are verified by banded bit-parallel edit distance: one bit
    for each diagonal of the band, one word for each number of edits.

Equal lines are one class throughout, so a very common line is one posting.

Edge cases: a null text stays null; an empty text stays empty; every other
text keeps the lines that stay, in order; a document may end up empty; rows
that repeat a doc_id are judged by their own texts (in the order of a hash of
them), and rows that repeat doc_id and text lose the same lines; lines of a row
without a doc_id count as the earliest; an empty table gives an empty result;
other columns, whatever their names, are kept, and n_chars is recomputed where it exists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.llm.common import staged

EDITS = 1
#: Bits of a bitmap: its 64-bit words are a broadcast of 65,536 rows at most.
BITMAP_BITS = 22
#: Lines that may share a posting before it is split further.
HOT = 32


def bitmap(rows: DataFrame, key: str) -> DataFrame:
    """word, bits: which of 2 ** BITMAP_BITS buckets the keys fall into."""
    place = F.pmod(key, F.lit(1 << BITMAP_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")
    return staged(rows.select(F.shiftright(place, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "bitmap")


def among(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key falls into a bucket of ``bits`` (all that are wanted, and a few more)."""
    word = F.shiftright(F.pmod(key, F.lit(1 << BITMAP_BITS)), 6)
    found = rows.withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word"))
    return found.where(F.expr(f"(shiftright(_bits, cast(pmod({key}, 64) as int)) & 1L) = 1L")).drop("_at", "_word", "_bits", "_bit")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, mark (a hash of the text), at, line (trimmed), h1, h2, size of every line long enough."""
    each = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    each = each.withColumn("line", trimmed(F.col("line")))
    each = each.withColumn("size", F.length("line")).where(F.col("size") >= min_chars)
    return each.select("doc_id", "mark", "at", "line", "size", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the indexed line is, segment, shift) of all that a line
    asks for: a segment has moved by no more than the edits before it, nor the
    rest behind it by more than those after it."""
    return [
        (delta, q, shift)
        for delta in range(edits + 1)
        for q in range(edits + 1)
        for shift in range(max(-q, delta - (edits - q)), min(q, delta + (edits - q)) + 1)
    ]


def posted(rows: DataFrame, edits: int, text: str, within: str, deeper: bool) -> DataFrame:
    """``rows`` with own (an index entry, or else a probe), base (length of the index), start and wide of a segment of ``text``, and key.

    ``within`` names what the lines share already.  ``deeper``, rows have own and delta, and go on as what they are.
    """
    found = ", ".join(f"named_struct('delta', {d}, 'q', {q}, 'shift', {s}, 'own', {str(not d and not s).lower()})" for d, q, s in probes(edits))
    if deeper:
        out = rows.withColumn("_p", F.expr(f"explode(filter(array({found}), p -> p.delta = delta))")).withColumn("own", F.expr("own and _p.own"))
    else:
        out = rows.withColumn("_p", F.expr(f"explode(array({found}))")).withColumn("own", F.col("_p.own"))
    out = out.withColumns({"delta": F.col("_p.delta"), "base": F.expr(f"length({text}) - _p.delta")})
    out = out.withColumn("start", F.expr(f"cast(base * _p.q div {edits + 1} as int)")).withColumn("wide", F.expr(f"cast(base * (_p.q + 1) div {edits + 1} as int) - start"))
    out = out.withColumn("start", F.expr("start + _p.shift")).where(f"base > {edits} and start >= 0 and start + wide <= length({text})")
    return out.withColumn("key", F.expr(f"xxhash64({within}, base, _p.q, substring({text}, start + 1, wide))")).drop("_p")


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings are at most ``edits`` edits apart.

    Bit ``edits + d`` of word e says: so far, the first j characters of a and
    the first j + d of b are e edits apart.  A character of a moves all
    diagonals at once: equal keeps them, exchange and omission cost an edit (and
    omission a diagonal down), insertion costs an edit and a diagonal up.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def grown(words: list[Column]) -> list[Column]:
        """Insertions within a column."""
        out = [words[0]]
        for w in words[1:]:
            out.append(w.bitwiseOR(F.shiftleft(out[-1], 1).bitwiseAND(F.lit(full))))
        return out

    x, y = F.split(a, ""), F.split(b, "")

    def distance(pair: Column) -> Column:
        p, r = pair["x"], pair["y"]
        zero = grown([F.lit(1 << edits), *(F.lit(0) for _ in range(edits))])
        start = F.struct(*(z.cast("int").alias(f"w{e}") for e, z in enumerate(zero)))

        def step(s: Column, j: Column) -> Column:
            c = F.get(p, j)
            match = reduce(lambda u, v: u.bitwiseOR(v), [F.when(F.get(r, j + d) == c, 1 << (edits + d)).otherwise(0) for d in range(-edits, edits + 1)])
            old = [s[f"w{e}"] for e in range(edits + 1)]
            new = [old[0].bitwiseAND(match)]
            for e in range(1, edits + 1):
                new.append(old[e].bitwiseAND(match).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)))
            return F.struct(*(w.cast("int").alias(f"w{e}") for e, w in enumerate(grown(new))))

        def end(s: Column) -> Column:
            last = F.call_function("shiftleft", F.lit(1), F.size(r) - F.size(p) + edits)
            return reduce(lambda u, v: u | v, [s[f"w{e}"].bitwiseAND(last) != 0 for e in range(edits + 1)])

        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, step, end)

    near = F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), distance), F.lit(0))
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, F.lit(False)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(True)).otherwise(near)


def meeting(found: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """a1, a2, b1, b2: pairs of lines that meet in a posting, hot postings split on."""
    parts, deep = [], False
    while True:
        counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where("n > 1 and any").select("key", "n")
        dealt = staged(found.join(staged(counts, "counts"), "key"), "met")
        cold = dealt.where(F.col("n") <= HOT)
        a = cold.where("own").select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
        b = cold.select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"), "own")
        pairs = a.join(b, "key").where("(a1 <> b1 or a2 <> b2) and (not own or a1 < b1 or (a1 = b1 and a2 < b2))")
        parts.append(pairs.select("a1", "a2", "b1", "b2"))
        hot = dealt.where(F.col("n") > HOT).drop("n")
        if hot.isEmpty():
            break
        if not deep:
            hot = hot.join(texts.select("h1", "h2", "first", F.col("line").alias("rest")), ["h1", "h2"])
            deep = True
        hot = hot.withColumn("rest", F.expr("concat(left(rest, start), substring(rest, start + wide + 1))")).withColumn("base", F.col("base") - F.col("wide"))
        hot = staged(hot.select("h1", "h2", "first", "key", "own", "delta", "base", "rest").distinct(), "hot")
        ended = hot.where(F.col("base") <= edits)
        parts.append(alike(ended).unionByName(inserted(ended, edits)))
        more = hot.where(F.col("base") > edits).withColumnRenamed("key", "parent").drop("base")
        found = staged(posted(more, edits, "rest", "parent", True).drop("parent"), "split")
    return reduce(DataFrame.union, parts).distinct()


def alike(ended: DataFrame) -> DataFrame:
    """Lines of one posting that differ in ``edits`` characters at most: each with the earliest."""
    own = ended.where("own").select("key", "h1", "h2", "first")
    top = own.groupBy("key").agg(F.min(F.struct("first", "h1", "h2")).alias("top"))
    return own.join(top, "key").where("h1 <> top.h1 or h2 <> top.h2").select(F.col("top.h1").alias("a1"), F.col("top.h2").alias("a2"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))


def inserted(ended: DataFrame, edits: int) -> DataFrame:
    """Index entries and probes of one posting with no more characters left than
    edits.  With one edit the character left over must be one of the probe's two,
    which makes the pairs exact; with more all that meet are pairs."""
    one = "array(rest)" if edits == 1 else "array('')"
    two = "array_distinct(split(rest, ''))" if edits == 1 else "array('')"
    a = ended.where("own").select("key", F.explode(F.expr(one)).alias("left"), F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    b = ended.where("not own").select("key", F.explode(F.expr(two)).alias("left"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    return a.join(b, ["key", "left"]).where("a1 <> b1 or a2 <> b2").select("a1", "a2", "b1", "b2")


def repeated(each: DataFrame, edits: int = EDITS) -> DataFrame:
    """h1, h2 of the lines (of ``lines_of``, written) that stand within ``edits`` edits of an earlier other line."""
    rows = posted(each.select("h1", "h2", "line"), edits, "line", "0", False).drop("line")
    shared = staged(rows.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select(F.col("key").alias("_key")), "shared")
    found = among(rows, "key", bitmap(shared, "_key")).distinct().join(shared, F.col("key") == F.col("_key"), "left_semi")
    found = staged(found, "postings")
    texts = among(each, "h1", bitmap(found, "h1")).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "mark", "at")).alias("first"), F.first("line").alias("line"))
    texts = staged(texts, "texts")
    pairs = meeting(found, texts, edits)
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("a_first"), F.col("line").alias("a_line"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("b_first"), F.col("line").alias("b_line"))
    near = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where(within(F.col("a_line"), F.col("b_line"), edits))
    later = F.col("a_first") > F.col("b_first")
    return near.select(F.when(later, F.col("a1")).otherwise(F.col("b1")).alias("h1"), F.when(later, F.col("a2")).otherwise(F.col("b2")).alias("h2")).distinct()


def cleaned(docs: DataFrame, min_chars: int = 20, edits: int = EDITS) -> DataFrame:
    """The rows of ``docs`` with the lines that stay; n_lines and n_dropped besides."""
    lines = staged(lines_of(docs, min_chars), "lines")
    dropped = staged(repeated(lines, edits), "dropped")
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "mark", "at")).alias("first"))
    stay = firsts.join(dropped, ["h1", "h2"], "left_anti").groupBy(F.struct("first.doc_id", "first.mark").alias("k")).agg(F.collect_list("first.at").alias("stay"))
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("k"), F.struct(*docs.columns).alias("row"))
    out = rows.alias("r").join(stay.alias("s"), F.col("r.k").eqNullSafe(F.col("s.k")), "left").select("row", "stay")
    # the numbers of the lines that stay, sorted, and each looked up by its number: no search for each line
    out = out.withColumn("each", F.split("row.text", "\n"))
    short = F.filter(F.transform("each", lambda line, i: F.when(F.length(trimmed(line)) < min_chars, i)), lambda i: i.isNotNull())
    out = out.withColumn("stay", F.array_sort(F.concat(short, F.coalesce("stay", F.expr("cast(array() as array<int>)")))))
    out = out.withColumn("kept", F.transform("stay", lambda i: F.get("each", i)))
    text = F.array_join("kept", "\n")
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    lost = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size("each") - F.size("kept"))
    columns = [changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    return out.select(*columns, F.coalesce(F.size("each"), F.lit(0)).cast("long").alias("n_lines"), lost.cast("long").alias("n_dropped"))


SQL = r"""
WITH lines AS MATERIALIZED (
  SELECT doc_id, pos - 1 AS pos, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
firsts AS MATERIALIZED (
  SELECT line, length(line) AS n, min({'d': doc_id, 'p': pos}) AS first FROM lines WHERE length(line) >= 20 GROUP BY line),
halves AS MATERIALIZED (
  SELECT line, n, first, b, b = n AS own, q, CASE q WHEN 0 THEN right(line, b - b // 2) ELSE left(line, b // 2) END AS part
  FROM firsts, (VALUES (0), (1)) AS s(q), unnest([n, n - 1]) AS t(b)),
near AS (
  SELECT x.first AS f, x.line AS l, y.first AS g, y.line AS m
  FROM halves x JOIN halves y ON x.own AND x.b = y.b AND x.q = y.q AND x.part = y.part AND x.line <> y.line
  WHERE levenshtein(x.line, y.line) <= 1),
dropped AS (SELECT DISTINCT CASE WHEN f > g THEN l ELSE m END AS line FROM near),
kept AS (
  SELECT doc_id, pos, raw FROM lines l
  WHERE length(line) < 20 OR EXISTS (SELECT 1 FROM firsts f WHERE f.line = l.line AND f.first.d = l.doc_id AND f.first.p = l.pos
    AND f.line NOT IN (SELECT line FROM dropped))),
texts AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS text, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(t.n, 0) END AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(t.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN texts t USING (doc_id)
"""
