"""The batch from the command line: raw compounds to a catalogue, its rejects and a report.

    spark-submit galenic/__main__.py COMPOUNDS.tsv OUT [--drug-names F] [--compound-names F] [--entries DIR]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from galenic.functions import vocab
from galenic.operators import facets
from galenic.plans.etl import build
from galenic.sources import flatfile, tables


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="galenic", description=__doc__)
    p.add_argument("compounds", help="tab-separated table of compounds")
    p.add_argument("out", help="folder of the tables: drugs (Parquet by category), rejects")
    p.add_argument("--drug-names", help="tab-separated name table of drugs")
    p.add_argument("--compound-names", help="tab-separated name table of compounds")
    p.add_argument("--entries", help="folder of flat-file entries")
    p.add_argument("--bundle", help="folder of a JSON bundle to write as well")
    p.add_argument("--limit", type=int, default=0, help="approved rows to take, all by default")
    p.add_argument("--whole-years", action="store_true", help="keep years, not centuries")
    a = p.parse_args(args)

    spark = SparkSession.builder.appName("galenic").getOrCreate()
    names = [tables.read_names(spark, path) if path else None for path in (a.drug_names, a.compound_names)]
    entries = flatfile.read_entries(spark, a.entries) if a.entries else None
    found = build(tables.read_tsv(spark, a.compounds), *names, entries, limit=a.limit, whole_years=a.whole_years)
    tables.write_table(found.drugs, f"{a.out}/drugs")
    found.rejects.write.mode("overwrite").parquet(f"{a.out}/rejects")
    drugs = spark.read.schema(found.drugs.schema).parquet(f"{a.out}/drugs")
    if a.bundle:
        tables.write_bundle(drugs, a.bundle, source=a.compounds, kegg_enriched=entries is not None, local_names=any(n is not None for n in names))
    kept, skipped = drugs.count(), spark.read.parquet(f"{a.out}/rejects").count()
    print(f"approved {kept + skipped}, kept {kept}, skipped {skipped}")
    for row in facets.report(drugs, vocab.categories(spark)).orderBy("category").toLocalIterator():
        print(row["line"])


if __name__ == "__main__":
    main()
