"""Periodic runs of words, by Lyndon arrays in linear time.

A run is a stretch of words that repeats with a smallest period and that no
neighbouring word extends.  Each is found at the Lyndon root it has in one of
the two orders of the alphabet: where the longest Lyndon word that starts at j
ends at i (i is the next smaller suffix of j), and words match from j and from i
on for ``e`` words, the run of period i - j ends at i + e; its start is less than a
period before j.

Words are only compared with each other (equal, smaller): no suffix array, no
hashes of texts.  Matches already made are used again in two ways.  Candidates
for the previous smaller suffix of i stand in a chain, and what the last one
shares with i, held against what it shares with the next one, settles the next
comparison or tells where it goes on.  And inside the matched stretch that
reaches furthest, two positions share what their images share, up to its end;
words beyond it are compared once.

Edge cases: null and empty texts, and texts of blanks, have no words and no
runs; a row without a doc_id is not rewritten; rows that repeat a doc_id or a
text are each handled for themselves; of runs that are equally long the first
by start and then by period is the longest; very long texts are one row of a
task, in memory and time linear in their words; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows turned into Python objects at once.
SLICE = 256
SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def rooted(a: Sequence, rising: bool, times: int) -> Iterator[tuple[int, int, int]]:
    """start, length, period of the runs of ``times`` periods or more whose Lyndon
    root belongs to this order of the alphabet."""
    n = len(a)
    above, shared = [-1] * n, [0] * n  # previous smaller suffix, and how much it shares
    below, matched = [0] * n, [0] * n  # next smaller suffix, and how much it shares
    left = right = end = 0  # the stretch that reaches furthest: a[left:] and a[right:end] are alike
    ends: dict[int, int] = {}

    def extended(j: int, i: int, e: int) -> int:
        nonlocal left, right, end
        if i < end:
            u, v, room = i - right + left, j, end - i
            if j >= right:
                u, v = j - right + left, u
            elif j < u:
                u, v = v, u
            known = room if u == v else matched[u] if below[u] == v else shared[v] if above[v] == u else -1
            if 0 <= known < room:
                return known
            if known >= 0:
                e = max(e, room)
        while i + e < n and a[j + e] == a[i + e]:
            e += 1
        if i + e > end:
            left, right, end = j, i, i + e
        return e

    for i in range(1, n):
        j, e, link = i - 1, 0, 0
        while j >= 0:
            if e > link:  # the next one parts from the last before i does
                e = link
                break
            if e == link:
                if i + e < n and a[j + e] == a[i + e]:
                    e = extended(j, i, e)
                if i + e < n and (a[j + e] < a[i + e]) is rising:
                    break
            period = i - j
            below[j], matched[j] = i, e
            if e > (times - 2) * period and ends.get(period) != i + e:
                ends[period] = i + e
                back = 0
                while j > back and a[j - back - 1] == a[i - back - 1]:
                    back += 1
                yield j - back, back + period + e, period
            link, j = shared[j], above[j]
        above[i], shared[i] = j, e if j >= 0 else 0


def runs(a: Sequence, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """start, length, period of every run of at least ``least`` words and ``times``
    periods (2 or more), by start and then period."""
    found = {run for rising in (True, False) for run in rooted(a, rising, times)}
    return sorted((run for run in found if run[1] >= max(least, times * run[2])), key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in found:
        keep[start + period : start + length] = bytes(length - period)
    return list(compress(words, keep))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of one document in ten with a period from some word on, by a hash of its id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(words: list[bytes], least: int, times: int) -> tuple:
    """The values of SCHEMA."""
    found = runs(words, least, times)
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * longest[1] // longest[2] if found else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return len(found), *longest, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()


def _each(docs: DataFrame, schema: str, of, names: list[str]) -> DataFrame:
    """doc_id and what ``of`` gives for the words of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [pa.field(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [of((text or b"").split(), key) for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")


def detect(docs: DataFrame, least: int = 6, times: int = 4, rewritten: bool = False) -> DataFrame:
    """Per row of ``docs``: the number of runs, the longest of them, and digests of all
    runs and of the words that stay when each run keeps its first period.
    ``rewritten`` looks at the words of ``planted``."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return _each(docs, SCHEMA, lambda words, key: digest(planted(words, key) if rewritten else words, least, times), names)


def without_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with the text of the words that stay, joined by one blank, where a text has a run; others stay as they are."""
    at = docs.columns.index("text")

    def text_of(text: str | None) -> str | None:
        words = (text or "").encode("utf-8", "replace").split()
        found = runs(words, least, times)
        return b" ".join(collapsed(words, found)).decode() if found else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = pa.array([text_of(t) for t in part.column(at).to_pylist()], part.column(at).type)
                yield part.set_column(at, part.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)


SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
hashed AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(list_reduce([4294967295] || list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, tab),
placed AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM hashed),
texts AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN again
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w
  FROM placed),
alike AS (
  SELECT doc_id, q, unnest(list_filter(range(n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i
  FROM texts, unnest(range(1, n // 4 + 1)) AS r(q)),
islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM alike)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM islands GROUP BY ALL),
each AS (
  SELECT doc_id, count(*) AS n_runs, min(struct_pack(a := -length, b := start, c := period)) AS first,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    list(struct_pack(low := start + period, high := start + length)) AS cuts
  FROM runs GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, first.b AS start, -first.a AS length, first.c AS period, (1000 * -first.a) // first.c AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN n_runs IS NULL THEN w
    ELSE list_transform(list_filter(range(n), lambda i: len(list_filter(cuts, lambda c: i >= c.low AND i < c.high)) = 0), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM texts t LEFT JOIN each e ON e.doc_id = t.doc_id
"""
