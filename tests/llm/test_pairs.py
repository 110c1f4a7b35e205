"""Near-duplicates of vectors, documents and lines against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galenic.llm import common, embeddings, lines, minhash


def parts(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = parts(500, edges)
    assert all(want[k] == v for k, v in got.items()) and set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r["k"] == r["rank"] for r in common.ranked(df, "k").collect())


def brute_vectors(vectors, cosine=0.95):
    usable = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for a, b in itertools.combinations(usable, 2):
        if len(vectors[a]) != len(vectors[b]):
            continue
        x, y = np.array(vectors[a], dtype=float), np.array(vectors[b], dtype=float)
        if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
            links.append((a, b))
    n = [0] * len(vectors)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, parts(len(vectors), links)


@pytest.mark.parametrize("seed", (0, 1))
def test_vectors(spark, monkeypatch, seed):
    monkeypatch.setattr(embeddings, "SMALL_BLOCK", 16)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 6))
    vectors = [(base[i % 40] * (1 + i) + rng.normal(size=6) * 0.1 * (i % 3) * (1 + i)).astype("float32").tolist() for i in range(150)]
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 6, [float("nan")] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [1.0, 2.1], [5.0], [-1.0], [3.0], [float("inf")] * 6]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("cls", F.lit(1))
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df).collect())
    n, low = brute_vectors(vectors)
    assert got == [(i, n[i], low[i], low[i] == i) for i in range(len(vectors))]


def test_vectors_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = spark.createDataFrame([(3, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_duplicates(only).collect()] == [(3, 0, 3, True)]


def brute_documents(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], parts(len(texts), links)


@pytest.mark.parametrize(("width", "percent"), ((3, 85), (5, 80)))
def test_documents(docs, monkeypatch, width, percent):
    monkeypatch.setattr(minhash, "LIST_ROWS", 8)
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", 8)
    rng = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t).upper() if rng.random() < 0.3 else "\n".join(t))
    texts += [None, "", " \t", "one", "ONE", "one two", "x " * 5000, "x " * 6000]
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs(texts, cls=1, sig="clash"), width=width, percent=percent).collect())
    n, low = brute_documents(texts, width, percent)
    assert got == [(i, n[i], low[i], low[i] == i) for i in range(len(texts))]
    kept = minhash.deduplicated(docs(texts), width=width, percent=percent)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(low))


def test_documents_empty_and_repeated(docs):
    assert minhash.near_duplicates(docs([])).count() == 0
    again = docs(["a b c d e f", "a b c d e f", "other words here", None], ids=[5, 5, 6, None])
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(again).collect())
    assert got == [("5", 5, True), ("5", 5, True), ("6", 6, True), ("None", None, True)]
    assert sorted(str(r["doc_id"]) for r in minhash.deduplicated(again).collect()) == ["5", "6", "None"]


def test_documents_of_one_id(docs):
    copy, near = "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n o"
    texts = [copy, near, "only here and nowhere else at all", "another text under the same id", "another text under the same id", "", None]
    rows = minhash.deduplicated(docs(texts, ids=[1, 5, 5, 5, 5, 6, None])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in rows) == [("1", copy), ("5", texts[3]), ("5", texts[2]), ("6", ""), ("None", None)]
    both = minhash.deduplicated(docs([copy, near], ids=[5, 5])).collect()
    assert len(both) == 1


def test_large_clusters_of_templates(spark, docs, monkeypatch):
    """Documents of one template, none a link, and a few near copies among them: only what shares rare shingles goes on."""
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", 8)
    rng = random.Random(9)
    seen = []
    whole = minhash.prefixed
    monkeypatch.setattr(minhash, "prefixed", lambda *a: seen.append(common.staged(whole(*a), "seen")) or seen[-1])
    template = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = [template[:75] + [f"own{i} {rng.randrange(10**9)}" for _ in range(14)] + template[75:] for i in range(60)]
    texts += [[*t[:80], "other", *t[81:]] for t in texts[20:24]]
    texts = [" ".join(t) for t in texts]
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs(texts)).collect())
    n, low = brute_documents(texts, 5, 80)
    assert got == [(i, n[i], low[i], low[i] == i) for i in range(len(texts))] and len(set(low)) == 60
    assert len(seen) == 1 and seen[0].count() <= 16


def test_documents_without_id(docs):
    """Links do not depend on ids: near copies without one join their group, and a group of such rows keeps one."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    near = lambda at: " ".join([*base[:at], "exchanged", *base[at + 1 :]])
    alone = [f"v{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join(base), near(10), near(100), near(100), " ".join(alone), " ".join([*alone[:-1], "x"]), " ".join(alone), "", None, "a b c d e f g"]
    df = docs(texts, ids=[1, None, None, None, None, None, None, None, None, 9])
    found = minhash.grouped(df).collect()
    assert len(found) == len(texts)
    linked = [r for r in found if r["component_id"] == 1]
    assert len(linked) == 4 and sum(r["kept"] for r in linked) == 1
    others = [r for r in found if r["component_id"] is None and r["part"] is not None]
    assert len(others) == 3 and len({r["part"] for r in others}) == 1 and all(r["kept"] for r in others)
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in minhash.deduplicated(df).collect())
    assert [k for k, _ in kept] == ["1", "9", "None", "None", "None"]
    assert [t for k, t in kept if k == "None"][:2] == ["", ""] and kept[-1][1] in texts[4:7]


@pytest.mark.parametrize("same", (0.2, 0.7, 0.95))
def test_collisions(same):
    """Merged counts are those of a plain comparison, with few and with very frequent values."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 20, 64).astype(np.int32)
    signs = np.where(rng.random((150, 64)) < same, base, rng.integers(0, 40, (150, 64))).astype(np.int32)
    plain = np.array([[(a == b).sum() for b in signs] for a in signs])
    for t in (1, 20, 41, 60):
        assert (minhash.collisions(signs, t) == (plain >= t)).all()


def test_linked_joins_what_all_pairs_join(spark):
    """Points on a line, linked when near: one large group, several blocks, some left over after the first member."""
    import pyarrow as pa

    rng = random.Random(5)
    points = [(0, i, rng.choice([0, 40, 80]) + rng.randrange(12)) for i in range(120)] + [(1, 200 + i, i) for i in range(5)] + [(2, 300, 1)]

    def compare(dealt):
        def run(batches):
            for group in common.runs(batches, ["g", "block", "other"]):
                x, m = group.column("x").to_numpy(), group.column("m").to_numpy()
                found = (np.abs(x[:, None] - x[None, :]) <= 1) & common.crossing(group.column("side").to_numpy())
                tree = common.spanning(found)
                yield pa.RecordBatch.from_pydict({"src": pa.array([m[i] for i, _ in tree], pa.int64()), "dst": pa.array([m[j] for _, j in tree], pa.int64())})

        return dealt.select("g", "block", "other", "side", "m", "x").mapInArrow(run, "src bigint, dst bigint")

    members = common.staged(spark.createDataFrame(points, "g long, m long, x long"))
    dealt = common.staged(common.blocked(members, "g", "m", 8))
    got = {r["node"]: r["component"] for r in common.components(common.linked(dealt, "g", "m", 8, compare)).collect()}
    n = 400
    want = parts(n, [(a[1], b[1]) for a, b in itertools.combinations(points, 2) if a[0] == b[0] and abs(a[2] - b[2]) <= 1])
    assert all(got.get(m, m) == want[m] for _, m, _ in points)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", (1, 2, 3))
def test_within(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("", "a"), ("ab", "ba"), ("aé𝄞", "é𝄞")]
    for _ in range(400):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 12)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r["x"] for r in df.orderBy("i").select(lines.within(F.col("a"), F.col("b"), edits).alias("x")).collect()]
    assert got == [edit(a, b) <= edits for a, b in pairs]


def brute_lines(texts, least, edits=1):
    first = {}
    for d, t in enumerate(texts):
        for p, l in enumerate((t or "").split("\n")):
            l = l.strip(" \t\n\r\x0b\x0c")
            if len(l) >= least:
                first.setdefault(l, (d, p))
    dropped = {(a if first[a] > first[b] else b) for a, b in itertools.combinations(first, 2) if abs(len(a) - len(b)) <= edits and edit(a, b) <= edits}
    out = []
    for d, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        keep = []
        for p, l in enumerate(t.split("\n")):
            s = l.strip(" \t\n\r\x0b\x0c")
            if len(s) < least or (first[s] == (d, p) and s not in dropped):
                keep.append(l)
        out.append("\n".join(keep))
    return out


@pytest.mark.parametrize(("hot", "edits"), ((2, 1), (32, 1), (2, 2)))
def test_lines(docs, monkeypatch, hot, edits):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(hot)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(18, 40))) for _ in range(15)] + ["Visitor number 10000000 today"]
    texts = [None, "", "short\nshort"]
    for _ in range(60):
        own = []
        for _ in range(rng.randrange(1, 5)):
            l = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(l))
                l[at : at + rng.randrange(2)] = rng.choice(["", "z", "7"])
            own.append(" " * rng.randrange(2) + "".join(l))
        texts.append("\n".join(own))
    rows = {r["doc_id"]: r for r in lines.cleaned(docs(texts, at=1, line="clash", h1=3, _id=1, _stay=2, row=3, k=4), edits=edits).collect()}
    want = brute_lines(texts, 20, edits)
    assert [rows[i]["text"] for i in range(len(texts))] == want
    assert all(rows[i]["n_chars"] == (None if w is None else len(w)) for i, w in enumerate(want))


def test_lines_with_a_counter(docs):
    """Long lines that differ in a counter: postings are split until pairs grow with the lines, not with their square."""
    for n in (300, 1200):
        texts = [f"{'common words before it ' * 12}{i:06d}{' and the same words after' * 12}" for i in range(n)]
        each = common.staged(lines.lines_of(docs(texts), 20))
        rows = lines.posted(each.select("h1", "h2", "line"), 1, "line", "0", False).drop("line")
        firsts = each.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "mark", "at")).alias("first"), F.first("line").alias("line"))
        assert lines.meeting(rows.distinct(), firsts, 1).count() < 60 * n


def test_lines_of_repeated_ids(docs):
    a, b = "one long line that stands here", "another long line that stands there"
    texts = [a, f"{a}\n{b}", b, b, None]
    rows = lines.cleaned(docs(texts, ids=[1, 2, 2, 2, None])).collect()
    assert len(rows) == 5 and sum((r["text"] or "").count(a) for r in rows) == 1
    assert {r["text"] for r in rows if r["doc_id"] == 2} <= {"", b, f"{b}"}


def test_lines_empty(docs):
    assert lines.cleaned(docs([])).count() == 0
