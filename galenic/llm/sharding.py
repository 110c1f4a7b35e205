"""Sharding by extendible hashing. DataFrame functions only.

A directory is indexed by the leading bits of a hash of doc_id.  A bucket over
the byte limit is split on another bit; the others keep their depth.  Sums are
taken once for buckets of many bits and added up to those of fewer bits, so
one pass over the documents settles every depth up to there; only what is
still too large goes through another pass on deeper bits.

Edge cases: a null text has 0 bytes; a single document over the limit is a
shard of its own, and so are the rows that repeat one doc_id (a hash cannot
tell them apart, whatever their size); a null doc_id hashes like the empty
string; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.llm.common import staged

#: Bits of the hash in use: 15 hexadecimal digits, a positive long.
BITS = 60


def hashed(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _leaves(rows: DataFrame, start: int, bits: int, limit: int) -> DataFrame:
    """p (the leading start + bits bits) -> depth, bucket, shard_bytes, shard_docs of the shallowest bucket that fits."""
    deepest = start + bits
    fine = rows.groupBy(F.shiftright("hash", BITS - deepest).alias("p"))
    fine = staged(fine.agg(F.sum("n_bytes").alias("size"), F.count(F.lit(1)).alias("docs"), F.min("hash").alias("low"), F.max("hash").alias("high")), "buckets")
    each = fine.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(deepest))))
    each = each.withColumn("bucket", F.expr(f"shiftright(p, {deepest} - depth)"))
    levels = each.groupBy("depth", "bucket").agg(F.sum("size").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = levels.where((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))).drop("low", "high")
    found = each.select("p", "depth", "bucket").join(fits, ["depth", "bucket"])
    return found.groupBy("p").agg(F.min(F.struct("depth", "bucket", "shard_bytes", "shard_docs")).alias("leaf")).select("p", "leaf.*")


def assign(docs: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """doc_id, n_bytes, shard (its bits), depth, shard_bytes, shard_docs of every row of ``docs``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    left = staged(docs.select("doc_id", hashed(F.col("doc_id")).alias("hash"), size.alias("n_bytes")), "sizes")
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(4, min(24, math.ceil(math.log2(max(1, total / limit))) + 6))
    parts, start = [], 0
    while True:
        bits = min(bits, BITS - start)
        p = F.shiftright("hash", BITS - start - bits)
        dealt = left.withColumn("p", p).join(_leaves(left, start, bits, limit), "p", "left")
        dealt = staged(dealt, "dealt")
        parts.append(dealt.where("depth is not null"))
        left = dealt.where("depth is null").select("doc_id", "hash", "n_bytes")
        start += bits
        if start >= BITS or left.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "n_bytes", shard.alias("shard"), "depth", "shard_bytes", "shard_docs")


def write(docs: DataFrame, path: str, limit: int = 64 << 20) -> None:
    """The documents as Parquet, a folder for each shard."""
    shards = assign(docs, limit).select(F.col("doc_id").alias("_id"), "shard").distinct()
    out = docs.join(shards, docs["doc_id"].eqNullSafe(shards["_id"])).drop("_id")
    out.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


SQL = """
WITH base AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes
  FROM documents),
levels AS (
  SELECT d AS depth, h >> (60 - d) AS bucket, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs, min(h) AS low, max(h) AS high
  FROM base, range(0, 61) AS r(d) GROUP BY ALL),
fits AS (SELECT * FROM levels WHERE shard_bytes <= 67108864 OR low = high),
found AS (
  SELECT doc_id, n_bytes, bucket, CAST(depth AS INT) AS depth, shard_bytes, shard_docs
  FROM base JOIN fits ON bucket = h >> (60 - depth)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(bucket), 60, '0'), depth) END AS shard, depth, shard_bytes, shard_docs
FROM found
"""
