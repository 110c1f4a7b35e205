"""Importance resampling towards a target, over hashed n-grams, by the algebra of CRCs.

The CRC of two joined strings follows from those of the parts: the first is
multiplied by a power of a GF(2) matrix (one zero byte more for each byte of the
second) and added to the second.  So each distinct word's CRC is computed once,
and those of n-grams are composed from words' CRCs and lengths; no n-gram is ever
put together as a string.

1.  Features of all documents and of the target are counted by bucket: each
    task sums its own, so at most one row for each bucket leaves it.
2.  Gains, one integer for each of a stated number of buckets, go to all tasks.
3.  Every whole text is weighed; the log of the weight plus Gumbel noise, from a
    hash of the id, gives a sample without replacement as the largest scores.  Ranks
    come from counts by range and numbers within, so no task sorts everything.

Edge cases: null and empty texts, and texts without words, have no features and
weight 0 and are not drawn unless ``least_words`` is 0; ties of score go to the
smaller doc_id, nulls first, then by a hash of the text; a null doc_id is hashed
as an empty one; rows that repeat a doc_id are scored by their own texts with the
same noise; an empty target or corpus counts 0 in all buckets; very long texts are
one row of a task; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galenic.llm.common import ranked, staged

#: Rows turned into Python objects at once, and words remembered.
SLICE, KNOWN = 256, 400_000
#: Buckets that may be asked for: gains go to every task.
MOST_BUCKETS = 1 << 20
#: Each byte of a text: letters in lower case, what separates words as a blank.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_POLYNOMIAL = 0xEDB88320


@cache
def shifts() -> np.ndarray:
    """[k, b, v]: the value v in byte b of a CRC, after 2**k zero bytes more."""
    column = [1 << k for k in range(32)]
    matrix = [_POLYNOMIAL, *column[:-1]]  # one zero bit
    for _ in range(3):
        matrix = [_product(matrix, v) for v in matrix]
    out = np.zeros((31, 4, 256), dtype=np.uint32)
    for k in range(31):
        for b in range(4):
            for v in range(256):
                out[k, b, v] = _product(matrix, v << (8 * b))
        matrix = [_product(matrix, v) for v in matrix]
    return out


def _product(matrix: list[int], value: int) -> int:
    """A GF(2) matrix (its columns) times a vector of bits."""
    out = 0
    for column in matrix:
        if value & 1:
            out ^= column
        value >>= 1
        if not value:
            break
    return out


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs (uint32) moved by as many zero bytes as ``length`` says."""
    crc, table = crc.copy(), shifts()
    for k in range(int(length.max(initial=0)).bit_length()):
        pick = np.flatnonzero(length >> k & 1)
        v = crc[pick]
        crc[pick] = table[k, 0][v & 255] ^ table[k, 1][v >> 8 & 255] ^ table[k, 2][v >> 16 & 255] ^ table[k, 3][v >> 24]
    return crc


def ngram_crcs(crc: np.ndarray, length: np.ndarray, most: int) -> list[np.ndarray]:
    """CRCs of all runs of 1 to ``most`` words joined by a blank, from the words' CRCs and lengths."""
    out = [crc]
    if most > 1 and len(crc) > 1:
        blank = np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32)
        spaced = shifted(blank, length) ^ crc  # a blank and the word
        for n in range(2, min(most, len(crc)) + 1):
            crc = shifted(crc[:-1], length[n - 1 :] + 1) ^ spaced[n - 1 :]
            out.append(crc)
    return out


class WordCrc(dict):
    """Word as bytes -> CRC, computed once, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


def features(text: bytes | None, known: WordCrc, most: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the bucket of each of its features."""
    words = (text or b"").translate(BYTES).split()
    crc = np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words))
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if most > 1 else crc
    return len(words), np.concatenate(ngram_crcs(crc, length, most)) % np.uint32(buckets)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, part.column("text").to_pylist()


def counts(docs: DataFrame, most: int, buckets: int) -> DataFrame:
    """bucket, n: features of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = WordCrc(), np.zeros(buckets, dtype=np.int64)
        for _, texts in texts_of(batches):
            for text in texts:
                total += np.bincount(features(text, known, most, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    each = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most: int, buckets: int) -> list[int]:
    """1000 times the log of how much likelier a bucket is in the target, rounded down; every bucket counts one more than it holds."""
    here, there = ({r["bucket"]: r["n"] for r in counts(df, most, buckets).collect()} for df in (docs, target))  # at most a row for each bucket
    s, t = sum(here.values()), sum(there.values())
    return [math.floor(1000 * math.log((there.get(b, 0) + 1) * (s + buckets) / ((here.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def weighed(docs: DataFrame, gain: list[int], most: int) -> DataFrame:
    """doc_id, mark, n_words, n_features, weight of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = np.array(gain, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCrc()
        for part, texts in texts_of(batches):
            found = [features(text, known, most, len(table)) for text in texts]
            columns = [[n for n, _ in found], [len(f) for _, f in found], [int(table[f].sum()) for _, f in found]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "mark", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, mark bigint, n_words bigint, n_features bigint, weight bigint")


def scored(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """What ``resampled`` gives, with a hash of the text as mark."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    rows = weighed(docs, gains(docs, target, most, buckets), most)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    rows = rows.withColumn("score", F.col("weight") + noise)
    rows = rows.withColumn("_out", (F.col("n_words") < least_words).cast("int")).withColumn("_less", -F.col("score"))
    rows = staged(rows, "weights")
    drawn = rows.where("_out = 0").count() * percent // 100
    found = ranked(rows, "_out", "_less", "doc_id", "mark")
    return found.select("doc_id", "mark", "n_features", "weight", "score", F.when((F.col("_out") == 0) & (F.col("rank") < drawn), F.col("rank") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``.

    ``rank`` numbers the ``percent`` of the documents with ``least_words`` words or more
    that are drawn: the largest scores.  Features are runs of 1 to ``most`` words.
    """
    return scored(docs, target, **options).drop("mark")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns as they are; rows that repeat a doc_id and text go by the first of them."""
    ranks = scored(docs.select("doc_id", "text"), target, **options).groupBy("doc_id", "mark").agg(F.min("rank").alias("rank")).where("rank is not null")
    ranks = ranks.select(F.struct("doc_id", "mark").alias("_drawn"))
    rows = docs.withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("mark")))
    return rows.join(ranks, F.col("_row").eqNullSafe(F.col("_drawn")), "left_semi").select(*docs.columns)


SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
texts AS (
  SELECT doc_id, text FROM documents UNION ALL BY NAME SELECT text, 1 AS target FROM benchmark),
words AS MATERIALIZED (
  SELECT doc_id, target, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM texts),
hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)),
buckets AS MATERIALIZED (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, tab),
counted AS (
  SELECT bucket, count(*) FILTER (target IS NULL) AS s, count(*) FILTER (target = 1) AS t FROM words JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counted),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM counted, totals),
weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE target IS NULL GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id
"""
