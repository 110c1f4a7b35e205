import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def docs(spark):
    """docs(texts, sources=None, **extra columns of one value): a documents table, ids from 0."""
    from pyspark.sql import functions as F

    def make(texts, sources=None, ids=None, **extra):
        sources = sources or ["s"] * len(texts)
        ids = ids if ids is not None else list(range(len(texts)))
        rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]
        df = spark.createDataFrame(rows, DOCUMENTS)
        return df.withColumns({k: F.lit(v) for k, v in extra.items()})

    return make
