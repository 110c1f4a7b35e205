"""License scans: an exact set-similarity join of text blocks and license templates.

1.  A text's words (A-Z lower-cased) are cut into blocks of ``WIDE`` words, one
    every ``STEP`` words, so that any ``STEP`` + 1 consecutive words stand whole in
    one block.  A block is the set of its words.
2.  The words of the templates are ordered by the number of documents that hold
    them, rarest first (counted over all documents).  A template of n words of which a
    block must hold ``need`` is posted under its n - need + 1 rarest words (prefix):
    a block that holds none of these cannot meet it.  Most texts hold none of the
    posted words and go no further.
3.  Blocks with the same words of templates are one.  They are joined with the
    postings by word; the length filter drops blocks with fewer words than ``need``,
    the positional filter pairs in which too few words are left behind the place
    of the shared word on either side.
4.  Candidates are confirmed on full sets.  Of the templates that a block meets,
    those it holds most of give it their labels, so that a text under one version of
    a license is not labelled with another that differs in a word.

Beside that, ``PHRASES`` are counted wherever their words stand consecutively.

Edge cases: null and empty texts, and texts without words, have counts and a
score of 0, no places and no labels; rows that repeat a doc_id and text share
one result, other texts of a doc_id are judged for themselves; a null doc_id is
a key like any other; of templates that are held alike all give their labels;
very long texts have more blocks; no templates leave the phrases; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.llm.common import staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDE, STEP = 32, 16
#: Templates that may be given: their words are counted into the driver.
MOST_TEMPLATES = 1000
#: Phrases that are always reported, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, words) of the license statements looked for.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd-3-clause", "licensed under the 3 clause bsd license"),
    ("cc-by-4.0", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("reserved", "all rights reserved"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but none into one of a-z, so ASCII words are told apart as before."""
    plain = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.lower(F.coalesce(plain, F.lit("")))


def places(words: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand consecutively."""
    parts = phrase.split(" ")
    whole = lambda i: reduce(lambda a, b: a & b, (F.get(words, (i + k).cast("int")) == p for k, p in enumerate(parts)))
    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), whole)
    return F.when(F.array_contains(words, parts[0]) & (F.size(words) >= len(parts)), found).otherwise(F.expr("cast(array() as array<int>)"))


def needs(size: int, percent: int) -> int:
    return max(1, -(-size * percent // 100))


def ordered(docs: DataFrame, templates) -> list[str]:
    """The templates' words by the number of documents that hold them: one row for each word comes to the driver."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    if not vocabulary:
        return []
    held = F.array_intersect(F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0)), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = {r["word"]: r["n"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def posted(order: list[str], templates, percent: int) -> list[tuple[str, str, int, int, int, list[str]]]:
    """word, label, place, size, need, words of each word in a template's prefix."""
    place = {w: i for i, w in enumerate(order)}
    out = []
    for label, text in templates:
        words = sorted(set(text.split()), key=place.__getitem__)
        need = needs(len(words), percent)
        out += [(w, label, i, len(words), need, words) for i, w in enumerate(words[: len(words) - need + 1])]
    return out


def matched(blocks: DataFrame, postings: list) -> DataFrame:
    """block -> labels, held (the share of the template): of the templates it meets, those it holds most of."""
    spark = blocks.sparkSession
    index = spark.createDataFrame(postings, "word string, label string, place int, size int, need int, words array<string>")
    each = blocks.select("block", F.posexplode("block").alias("at", "word"))
    left = F.least(F.col("size") - F.col("place"), F.size("block") - F.col("at"))
    pairs = each.join(F.broadcast(index), "word").where((F.size("block") >= F.col("need")) & (left >= F.col("need")))  # MOST_TEMPLATES bounds the index
    both = F.size(F.array_intersect("block", "words"))
    met = pairs.where(both >= F.col("need")).select("block", "label", (both / F.col("size")).alias("held")).distinct()
    best = met.groupBy("block").agg(F.max("held").alias("held"), F.collect_list(F.struct("held", "label")).alias("all"))
    return best.select(F.col("block").alias("met"), "held", F.transform(F.filter("all", lambda x: x["held"] == F.col("held")), lambda x: x["label"]).alias("labels"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = 80) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``score`` is 1 where a phrase stands, else the largest share of a template that a block holds.
    """
    if len(templates) > MOST_TEMPLATES or any(len(t.split()) > STEP + 1 for _, t in templates):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of at most {STEP + 1} words")
    order = ordered(docs, templates)
    postings = posted(order, templates, percent)
    rare = sorted({p[0] for p in postings})
    fewest = min((p[4] for p in postings), default=1)
    nothing = F.expr("cast(array() as array<array<string>>)")
    strings = lambda values: F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    words = F.col("words")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - STEP - 1, F.lit(0)), F.lit(STEP))
    cut = F.transform(starts, lambda i: F.array_intersect(strings(order), F.slice(words, i + 1, F.lit(WIDE))))
    kept = F.array_distinct(F.filter(cut, lambda b: (F.size(b) >= fewest) & F.arrays_overlap(b, strings(rare))))
    at = {label: places(words, phrase) for phrase, label in phrases}
    found = F.flatten(F.array(*at.values())) if at else F.expr("cast(array() as array<int>)")
    rows = rows.select(
        "doc_id",
        "mark",
        F.size(words).cast("long").alias("n_words"),
        found.alias("found"),
        F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for label, p in at.items())), lambda x: x.isNotNull()))).alias("base") if at else strings([]).alias("base"),
        F.when(F.arrays_overlap(words, strings(rare)), kept).otherwise(nothing).alias("blocks"),
    )
    rows = staged(rows, "licenses")

    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("mark").alias("_mark")]
    each = rows.where("size(blocks) > 0").select(*key, F.explode("blocks").alias("block"))
    met = matched(each.select("block").distinct(), postings)
    by_doc = each.join(met, F.col("block") == F.col("met")).select("_id", "_none", "_mark", "held", F.explode("labels").alias("label"))
    by_doc = by_doc.groupBy("_id", "_none", "_mark").agg(F.max("held").alias("held"), F.collect_set("label").alias("own"))
    by_doc = by_doc.withColumnsRenamed({"_id": "_id2", "_none": "_none2", "_mark": "_mark2"})
    out = rows.select("*", *key).join(by_doc, (F.col("_id") == F.col("_id2")) & (F.col("_none") == F.col("_none2")) & (F.col("_mark") == F.col("_mark2")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.size("found").cast("long").alias("n_base"),
        F.array_min("found").cast("long").alias("first_word"),
        F.array_max("found").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", strings([])))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("held", F.lit(0.0))).alias("score"),
    )


SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
phrases(label, p) AS (VALUES {phrases}),
templates(label, t) AS (VALUES {templates}),
based AS (
  SELECT doc_id, label, unnest(list_filter(range(len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS place
  FROM words, phrases WHERE len(w) >= len(p)),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM based GROUP BY doc_id),
blocks AS (
  SELECT doc_id, i, list_distinct(w[i + 1 : i + {wide}]) AS b FROM words, unnest(range(0, greatest(len(w) - {step}, 1), {step})) AS r(i)),
held AS (
  SELECT doc_id, i, label, len(list_intersect(b, t)) AS n_both, len(t) AS n FROM blocks, templates),
met AS (SELECT doc_id, i, label, n_both / n AS held FROM held WHERE 100 * n_both >= {percent} * n),
best AS (SELECT doc_id, label, held FROM (SELECT *, max(held) OVER (PARTITION BY doc_id, i) AS most FROM met) WHERE held = most),
own AS (SELECT doc_id, max(held) AS held, list(DISTINCT label) AS labels FROM best GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(b.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(o.labels, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(held, 0.0::DOUBLE) END AS score
FROM words w LEFT JOIN base b ON b.doc_id = w.doc_id LEFT JOIN own o ON o.doc_id = w.doc_id
""".format(
    phrases=", ".join(f"('{label}', {p.split(' ')})" for p, label in PHRASES),
    templates=", ".join(f"('{label}', {sorted(set(t.split(' ')))})" for label, t in TEMPLATES),
    wide=WIDE,
    step=STEP,
    percent=80,
)
