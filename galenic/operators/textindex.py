"""Search without a scan: a trigram index over the words of a table, and postings by range.

Three written tables beside the files of the searched one: ``postings``, (word, key, slot)
by range of word and key, where a slot stands for the file of a row; ``words``, each
distinct word with its number of rows and the ranges its postings stand in; ``grams``,
the trigrams of the distinct words, by range.

A query without blanks that a text contains stands inside one of its words; of a query
with blanks the first piece ends a word, the last begins one and those between
are words.  Pieces of three characters or more are looked up: the words that have all
their trigrams are confirmed, their postings read from the ranges named, the keys of
all pieces intersected, and only the files they stand in are read, where the
query's own predicate decides.  So the result is that of the scan, whatever is looked
up.  A query whose pieces are all shorter is answered by the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.sources.shared import staged

#: What separates words, in texts and in queries.
BLANK = "[ \\t\\n\\x0B\\f\\r]+"
GRAM = 3


@dataclass(frozen=True)
class TextIndex:
    rows: DataFrame
    postings: DataFrame
    words: DataFrame
    grams: DataFrame
    key: str


def words_of(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), BLANK)), "")


def grams_of(word: Column, size: int = GRAM) -> Column:
    """The distinct stretches of ``size`` characters of a word; none of a shorter one."""
    starts = F.when(F.length(word) >= size, F.sequence(F.lit(1), F.length(word) - size + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    # a stretch is found by counting from the front, so long words are cut into letters first
    short = F.transform(starts, lambda i: F.substring(word, i, F.lit(size)))
    long = F.transform(starts, lambda i: F.array_join(F.slice(letters, i, F.lit(size)), ""))
    return F.array_distinct(F.when(F.length(word) <= 64, short).otherwise(long))


def dealt(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` by range of ``order``, sorted within, with _part: a folder for each range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    return staged(found, name, "_part")


def located(df: DataFrame) -> DataFrame:
    """``df`` with _slot, a number for the file a row stands in; a table that is no plain scan of files is written first."""
    try:
        return df.withColumn("_slot", F.xxhash64("_metadata.file_path"))
    except AnalysisException:
        return staged(df, "rows").withColumn("_slot", F.xxhash64("_metadata.file_path"))


def build(df: DataFrame, key: str, hay: Column) -> TextIndex:
    """An index over ``hay``, a text made of the columns of ``df``; ``key`` tells rows apart.

    Every word of every row is posted.  A word of very many rows reaches over several
    ranges, as its postings are ordered by key too.
    """
    rows = located(df)
    posted = dealt(rows.select(F.explode(words_of(hay)).alias("word"), F.col(key).alias("_key"), "_slot"), "postings", "word", "_key")
    words = posted.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("_part").alias("low"), F.max("_part").alias("high"))
    words = staged(words, "words")
    grams = dealt(words.select(F.explode(grams_of(F.col("word"))).alias("gram"), "word"), "grams", "gram", "word")
    return TextIndex(rows, posted, words, grams, key)


def pieces(query: str) -> list[tuple[str, str]]:
    """(piece, where it stands in a word) of the pieces long enough to be looked up."""
    parts = re.split(BLANK, query)
    if len(parts) == 1:
        found = [(query, "inside")]
    else:
        found = [(parts[0], "end"), *((p, "whole") for p in parts[1:-1]), (parts[-1], "start")]
    return [(p, how) for p, how in dict.fromkeys(found) if len(p) >= GRAM]


def _stands(word: Column, piece: str, how: str) -> Column:
    test = {"inside": F.contains, "end": F.endswith, "start": F.startswith}.get(how)
    return test(word, F.lit(piece)) if test else word == piece


def matching_words(index: TextIndex, piece: str, how: str) -> DataFrame:
    """word, n, low, high of the words in which a piece stands, by its trigrams."""
    grams = sorted({piece[i : i + GRAM] for i in range(len(piece) - GRAM + 1)})
    some = index.grams.where(F.col("gram").isin(grams) & _stands(F.col("word"), piece, how))
    some = some.groupBy(F.col("word").alias("_word")).agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") == len(grams))
    return index.words.join(some, F.col("word") == F.col("_word"), "left_semi")


def candidates(index: TextIndex, query: str) -> DataFrame | None:
    """_key, _slot of the rows that hold all pieces of a query in lower case; None if no piece can be looked up."""
    found = pieces(query)
    if not found:
        return None
    each = []
    for piece, how in found:
        words = staged(matching_words(index, piece, how), "matched")
        spans = words.select(F.explode(F.sequence("low", "high")).alias("_part")).distinct().collect()  # a row for each range at most
        posted = index.postings.where(F.col("_part").isin([r["_part"] for r in spans])) if spans else index.postings.limit(0)
        each.append(posted.join(words.select(F.col("word").alias("_word")), F.col("word") == F.col("_word"), "left_semi").select("_key", "_slot").distinct())
    return reduce(lambda a, b: a.join(b, ["_key", "_slot"], "left_semi"), each)


def search_indexed(index: TextIndex, query: str, predicate: Column) -> DataFrame:
    """The rows of which ``predicate`` (true only of rows whose text holds the query) is true."""
    rows = index.rows
    columns = [c for c in rows.columns if c != "_slot"]
    found = candidates(index, query.lower())
    if found is None:
        return rows.where(predicate).select(*columns)
    found = staged(found, "candidates")
    slots = [r["_slot"] for r in found.select("_slot").distinct().collect()]  # a number for each file at most
    if not slots:
        return rows.limit(0).select(*columns)
    keys = found.select("_key", F.col("_slot").alias("_at"))
    near = rows.where(F.col("_slot").isin(slots))
    return near.join(keys, F.col(index.key).eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at")), "left_semi").where(predicate).select(*columns)
