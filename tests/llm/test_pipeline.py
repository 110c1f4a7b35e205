"""The stages on a small table: each one's decisions take effect, and clean documents stay."""

import random

import corpus_pipeline
import __spark_entry__ as entry


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.staged(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert before > counts[0] >= counts[1] >= counts[2] > before // 2
    assert counts[3] == counts[4] > 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_copies_through_the_stages(spark, docs):
    """Exact copies are stripped bare by line dedup and go; near copies go with the near-duplicates; the others stay."""
    rng = random.Random(4)
    texts = [words(rng, 120) for _ in range(30)]
    exact = texts[:10]
    near = []
    for t in texts[10:20]:
        w = t.split(" ")
        w[rng.randrange(120)] = "exchanged"
        near.append(" ".join(w))
    df = docs([*texts, *exact, *near, None, "", "tiny", "tiny"])
    one = corpus_pipeline.line_dedup(spark, df, "")
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert one.columns == df.columns and set(kept) == {*range(30), *range(40, 54)}
    assert kept[50] is None and kept[51] == "" and kept[52] == kept[53] == "tiny"
    two = corpus_pipeline.minhash_dedup(spark, corpus_pipeline.staged(one), "")
    caught = set(kept) - {r["doc_id"] for r in two.collect()}
    assert caught == {*range(40, 50), 53}


def test_stages_of_odd_tables(spark, docs):
    """Nulls, repeats, an empty table and columns with the names the operators use inside."""
    clash = {c: 7 for c in ("_id", "_stay", "_copies", "_mark", "row", "k", "mark", "copies", "n_lines", "n_dropped", "stay", "each", "size", "cls", "block")}
    again = "the same row stands here twice with the same id"
    df = docs([again, again, "another text under that very same id here", None, "", "x " * 30000], sources=["a", "a", "a", None, "b", "b"], ids=[1, 1, 1, None, 2, 3], **clash)
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.minhash_dedup, corpus_pipeline.source_mix):
        assert stage(spark, docs([], **clash), "").count() == 0
        out = stage(spark, df, "")
        rows = out.collect()
        assert out.columns == df.columns and all(r["_stay"] == r["n_lines"] == 7 for r in rows)
        if stage is not corpus_pipeline.source_mix:
            assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in df.collect()}
