"""Arriving files: running counts, and names that stay."""

import random

from pyspark.sql import functions as F

from galenic.operators import ids
from galenic.sources.tables import COMPOUND_COLUMNS
from galenic.streaming import identifiers, ingest


def test_counts_grow_with_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def add(name, outcomes, status="approved"):
        row = {"approval_status": status, "inchikey": name, "trialbench_outcomes": outcomes}
        (folder / f"{name}.tsv").write_text("\t".join(COMPOUND_COLUMNS) + "\n" + "\t".join(row.get(c, "") for c in COMPOUND_COLUMNS) + "\n")

    add("a", "asthma")
    add("b", "asthma", "withdrawn")
    query = ingest.category_counts(ingest.compounds(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("categories").start()
    try:
        query.processAllAvailable()
        add("c", "cough")
        add("d", "")
        query.processAllAvailable()
        assert {r["atc_category"]: r["n"] for r in spark.table("categories").collect()} == {"R": 2, "V": 1}
    finally:
        query.stop()


BASES = ["a", "a-x", "a-x-2", "b", "b-2", None]


def made(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(BASES), rng.choice(["X", "y", "", None])) for i in range(n)]


def test_names_on_a_stream_equal_those_of_the_batch(spark, tmp_path):
    """Four files in order, one after the other; the query is stopped and started again between them."""
    schema, rows = "ord long, base string, p string", made(120, 1)
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        identifiers.named(stream, "base", [F.col("p")], "ord", out, checkpoint, availableNow=True).awaitTermination()

    for at in range(0, 120, 30):
        spark.createDataFrame(rows[at : at + 30], schema).coalesce(1).write.mode("append").parquet(folder)
        run()
    run()  # nothing new
    found = identifiers.names(spark, out)
    want = ids.unique_ids(spark.createDataFrame(rows, schema), "base", [F.col("p")])
    got = {r["ord"]: r["unique_id"] for r in found.collect()}
    assert got == {r["ord"]: r["unique_id"] for r in want.collect()}
    assert found.select("batch").distinct().count() == 4 and identifiers.late_rows(spark, out).count() == 0

    spark.createDataFrame([(3, "a", "X"), (500, "b", None)], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert [r["n"] for r in identifiers.late_rows(spark, out).collect()] == [1]
    known = [r["unique_id"] for r in identifiers.names(spark, out).where("base is not null").collect()]
    assert len(known) == len(set(known)) and {r["ord"]: r["unique_id"] for r in identifiers.names(spark, out).where("batch < 4").collect()} == got


def test_a_batch_that_runs_again_gives_the_same_names(spark, tmp_path):
    schema, rows = "ord long, base string, p string", made(60, 2)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        identifiers.named(stream, "base", [F.col("p")], "ord", out, str(tmp_path / checkpoint), availableNow=True).awaitTermination()
        return {r["ord"]: r["unique_id"] for r in identifiers.names(spark, out).collect()}

    for at in (0, 30):
        spark.createDataFrame(rows[at : at + 30], schema).coalesce(1).write.mode("append").parquet(folder)
    first = run("one")
    assert run("two") == first  # as after a checkpoint that was lost: every batch is written over
