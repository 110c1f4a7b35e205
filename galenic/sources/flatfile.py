"""Flat-file entries: a label in the first twelve characters of a line, its value after it.

Lines that are longer than twelve characters and do not start with a blank
begin a field; all others continue the one before.  Blank lines count for
nothing, and neither do lines before the first field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galenic.functions.text import codes, strip, year

LABEL = 12


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """entry_id (the file's name without its ending), text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("text"))
    return files.select(F.regexp_extract("f", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("entry_id"), "text")


def missing(ids: DataFrame, known: DataFrame) -> DataFrame:
    """The entry ids that are not in the store yet."""
    return ids.select("entry_id").distinct().join(known.select("entry_id"), "entry_id", "left_anti")


def fields(entries: DataFrame) -> DataFrame:
    """entry_id, field_no, label, values (array of its lines). An entry is cut within its row: nothing is shuffled."""
    counted = entries.select("entry_id", F.filter(F.split("text", "\n"), lambda v: strip(v) != "").alias("lines"))
    begins = lambda v: (F.length(v) > LABEL) & (F.left(v, F.lit(1)) != " ")
    starts = F.filter(F.transform("lines", lambda v, i: F.when(begins(v), i)), lambda i: i.isNotNull())
    placed = counted.select("entry_id", "lines", starts.alias("starts"))
    each = placed.select("entry_id", "lines", F.posexplode(F.transform("starts", lambda i, k: F.struct(i.alias("a"), F.coalesce(F.get("starts", k + 1), F.size("lines")).alias("b")))).alias("k", "at"))
    own = F.slice("lines", F.col("at.a") + 1, F.col("at.b") - F.col("at.a"))
    value = lambda v, i: strip(F.when(i == 0, F.substring(v, LABEL + 1, 1 << 30)).otherwise(v))
    label = strip(F.left(F.get("lines", F.col("at.a")), F.lit(LABEL)))
    return each.select("entry_id", (F.col("k") + 1).cast("long").alias("field_no"), label.alias("label"), F.transform(own, value).alias("values"))


def interpret(entries: DataFrame, whole_years: bool = False) -> DataFrame:
    """entry_id, name, atc_codes, atc_category, year_approved, indication.

    The last name counts, the first comment and the first year; codes add up.
    Years are centuries as catalogues hold them unless ``whole_years``.
    """
    text, head = F.array_join("values", "\n"), F.get("values", F.lit(0))
    approved = F.contains(text, F.lit("Adopted")) | F.contains(F.lower(text), F.lit("approved"))
    f = fields(entries).select(
        "entry_id",
        "field_no",
        F.when(F.col("label") == "NAME", strip(F.get(F.split(head, ";"), F.lit(0)))).alias("name"),
        F.when(F.col("label") == "ATC", codes(text)).alias("codes"),
        F.when((F.col("label") == "REMARK") & approved, year(text, whole_years)).alias("year"),
        F.when((F.col("label") == "COMMENT") & (head != ""), F.left(head, F.lit(200))).alias("indication"),
    )
    by_field = F.sort_array(F.collect_list(F.when(F.col("codes").isNotNull(), F.struct("field_no", "codes"))))
    found = f.groupBy("entry_id").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("field_no"))).alias("name"),
        F.flatten(F.transform(by_field, lambda x: x["codes"])).alias("atc_codes"),
        F.min_by("year", F.when(F.col("year").isNotNull(), F.col("field_no"))).alias("year_approved"),
        F.min_by("indication", F.when(F.col("indication").isNotNull(), F.col("field_no"))).alias("indication"),
    )
    return found.select("entry_id", "name", "atc_codes", F.left(F.get("atc_codes", F.lit(0)), F.lit(1)).alias("atc_category"), "year_approved", "indication")
