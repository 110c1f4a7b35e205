"""Classifiers, fingerprints, sharding, personal data, mixing and tokens."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galenic.llm import bpe, mixing, pii, quality, sharding, syncmers, toxicity


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    texts, marks = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["scum", "moron", "trash"]))
        text = " ".join(t)
        texts.append(text.upper().replace(" ", "!! ") if bad else text)
        marks.append((i, int(not bad), int(toxic)))
    return texts, marks


def accuracy(rows, truth):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_classifiers(spark, docs):
    texts, marks = corpus(600)
    texts += [None, "", "x" * 300_000]
    df, known = docs(texts, label=1, score="clash"), labels(spark, marks)
    for module, column in ((quality, 1), (toxicity, 2)):
        rows = module.score(df, known).collect()
        assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        assert accuracy(rows, {m[0]: m[column] for m in marks}) > 0.95
    kept = quality.accepted(docs(texts[:50]), known)
    assert kept.columns == df.columns[:5] and 0 < kept.count() < 50


def test_classifiers_without_labels(spark, docs):
    none = labels(spark, [(0, None, None), (None, 1, 1), (99, 1, 0)])
    assert {r["score"] for r in quality.score(docs(["a", None]), none).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(docs(["a", None]), none).collect()} == {0.0}
    assert quality.score(docs([]), none).count() == 0 and toxicity.score(docs([]), none).count() == 0


def test_held_out_labels_are_not_read(spark, docs):
    texts, marks = corpus(200)
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in marks]
    a, b = (sorted(map(tuple, quality.score(docs(texts), labels(spark, m)).collect())) for m in (marks, other))
    assert a == b


def test_fingerprints(spark, docs):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 1, 3, 80, 400]))) for _ in range(40)]
    texts += [None, "", texts[3], "é𝄞 " * 30]
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(docs(texts, own=1, next="clash")).collect()}
    prints = {}
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        n, half = len(t), len(t) // 2
        edited = t[: n - half] + after[:half]
        r = rows[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if t == edited:
            assert r["near_edited"] == 1
        if t == after:
            assert r["near_next"] == 1


def test_anchors_are_context_free(spark):
    words = [f"w{i * i % 97}" for i in range(200)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[50:]))], "a string, b string")
    row = df.select(syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b")).first()
    assert [(x["hash"], x["at"]) for x in row["a"] if x["at"] >= 50] == [(x["hash"], x["at"] + 50) for x in row["b"]]
    shared = df.select(syncmers.shared_places(syncmers.anchors(F.col("b")), syncmers.anchors(F.col("a"))).alias("s")).first()["s"]
    assert len(shared) == len(row["b"])


def test_fingerprints_of_few(docs):
    assert syncmers.fingerprints(docs([])).count() == 0
    one = syncmers.fingerprints(docs(["abcd"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1
    again = syncmers.fingerprints(docs(["ab", "ab", None], ids=[1, 1, None])).collect()
    assert len(again) == 3


def test_fingerprints_of_all_anchors(docs):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(3000))
    texts = [long, long[:9000] + "#" + long[9000:], "one small note that goes on for a while, as notes do", "one small note that went off in a while, as notes do", "漢字" * 200 + "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(600))]
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(docs(texts)).collect()}
    marks = sorted(((x[:8], int(x[8:], 16)) for x in rows[0]["fingerprint"].split(",")), key=lambda x: x[1])
    assert len(marks) > len(long) / 16 and all(b[1] - a[1] <= 12 for a, b in zip(marks, marks[1:], strict=False)) and marks[-1][1] > len(long) - 40
    shifted = sorted(((x[:8], int(x[8:], 16)) for x in rows[1]["fingerprint"].split(",")), key=lambda x: x[1])
    assert [m for m in marks if m[1] >= 9000] == [(h, at - 1) for h, at in shifted if at > 9000]
    assert 0.98 < rows[1]["near_next"] < 1  # one code point more, far behind the smallest hashes
    assert 0 < rows[3]["near_next"] < 1 and 0 < rows[2]["near_edited"] < 1  # texts of a line
    assert 0.2 < rows[4]["near_edited"] < 0.8  # a script without blanks


def brute_anchors(text):
    """Closed syncmers by their definition, with the hashes that Spark gives."""
    if not text.strip(" \t\n\x0b\x0c\r"):
        return []
    c = [" " if x in "\t\n\x0b\x0c\r" else x for x in text]
    k, s = syncmers.K, syncmers.S

    def mix(parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    g = [mix(c[i : i + s]) for i in range(len(c) - s + 1)]
    closed = [i for i in range(len(c) - k + 1) if min(g[i], g[i + k - s]) <= min(g[i + 1 : i + k - s])]
    return [f"{mix([g[i + j] for j in range(0, k - s + 1, s)]) & 0xFFFFFFFF:08X}{i:08X}" for i in closed] or [f"{mix(c) & 0xFFFFFFFF:08X}{0:08X}"]


def brute_likeness(a, b):
    a, b = (Counter(x[:8] for x in f) for f in (a, b))
    both = sum((a & b).values())
    return 1.0 if not a and not b else both / (a.total() + b.total() - both)


def test_fingerprints_by_brute_force(docs):
    rng = random.Random(15)
    alphabet = ["a", "b ", "the ", "é", "𝄞", "漢", "\n", " ", "\t ", "word", "12"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 10, 20, 40, 80, 300]))) for _ in range(120)]
    texts += ["".join(rng.choice(alphabet) for _ in range(200))[:n] for n in range(8, 104)]
    texts += [None, "", " " * 100, "x" * 70, " " * 40 + "y" * 60, "y" * 60 + " " * 60, " " * 59 + "yy" + " " * 59, texts[7], texts[7]]
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(docs(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, new, other = brute_anchors(t), brute_anchors(edited), brute_anchors(after)
        split = lambda f: sorted(f.split(","), key=lambda x: x[8:]) if f else []
        assert split(rows[i]["fingerprint"]) == own and split(rows[i]["edited_fingerprint"]) == new
        for column, found in (("near_edited", new), ("near_next", other)):
            assert abs(rows[i][column] - brute_likeness(own, found)) < 1e-12


def test_bounds(spark):
    for n in (1, 2, 3, 7, 8, 9, 100):
        tops = F.array(*(F.lit(3 * i) for i in range(n)))
        got = spark.range(-2, 3 * n + 2).select("id", syncmers.below(tops, F.col("id"), n).alias("n")).collect()
        assert all(r["n"] == sum(3 * i < r["id"] for i in range(n)) for r in got)


def test_compact_fingerprints(docs):
    df = docs(["".join(chr(97 + i * i % 23) for i in range(400)), "short"])
    for whole, small in zip(syncmers.fingerprints(df).orderBy("doc_id").collect(), syncmers.fingerprints(df, compact=True).orderBy("doc_id").collect(), strict=True):
        assert small["fingerprint"] == "".join(x[:8] for x in whole["fingerprint"].split(",")) and small["near_edited"] == whole["near_edited"]


def test_likeness_counts_places(spark):
    df = spark.createDataFrame([("abcdefgh" * 40, "abcdefgh" * 80)], "a string, b string")
    a, b = (syncmers.counted(syncmers.places(c)) for c in "ab")
    row = df.select(F.expr(syncmers.likeness(a, b)).alias("ab"), F.expr(syncmers.likeness(a, a)).alias("aa")).first()
    assert row["aa"] == 1 and 0.4 < row["ab"] < 0.6


def brute_shards(rows, limit):
    """Classic directory: split a bucket on its next bit while it is over the limit and can be told apart."""
    done, open_ = {}, [("", rows)]
    while open_:
        bits, own = open_.pop()
        if sum(n for _, _, n in own) <= limit or len({h for _, h, _ in own}) == 1:
            done |= {i: bits for i, _, _ in own}
            continue
        for b in "01":
            open_ += [(bits + b, part)] if (part := [x for x in own if format(x[1], "060b")[len(bits)] == b]) else []
    return done


def test_sharding(spark, docs, tmp_path):
    rng = random.Random(6)
    texts = ["x" * rng.choice([0, 10, 100, 5000]) for _ in range(200)] + [None]
    rows = sharding.assign(docs(texts, shard="clash", hash=1), limit=3000).collect()
    want = brute_shards([(i, int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), len(t or "")) for i, t in enumerate(texts)], 3000)
    assert {r["doc_id"]: r["shard"] for r in rows} == want
    assert all(r["shard_bytes"] <= 3000 or r["shard_docs"] == 1 for r in rows)
    sharding.write(docs(texts), str(tmp_path / "out"), limit=3000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(texts)
    assert sharding.assign(docs([])).count() == 0
    repeated = sharding.assign(docs(["y" * 2000] * 3 + ["z"], ids=[1, 1, 1, None]), limit=3000).collect()
    assert len(repeated) == 4 and max(r["shard_bytes"] for r in repeated) == 6000


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    return [[(k, m.start(), m.end()) for m in re.finditer(p, text) if good(k, m[0])] for k, p in BASE]


def test_pii(docs):
    rng = random.Random(7)
    pieces = ["a@b.c", "@", ".", "+", "-", " ", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "é", "𝄞", "\x01", "\x02", "\n", "x", "7", "(", "12 34", "+12", "5105105105105100123", "call 555-123-4567 now"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(500)]
    texts += [None, "", "1 " * 20000, "a" * 100_000, "a.b@" + "c." * 20000 + "d", "9" * 50000, "+1" * 20000, "a@b.c" * 3000]
    rows = {r["doc_id"]: r for r in pii.detect(docs(texts, base=1, spans="clash")).collect()}
    for i, t in enumerate(texts):
        found = brute_pii(t or "")
        r = rows[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(f) for f in found], t
        flat = [f"{k}:{a}:{b}" for f in found for k, a, b in f]
        assert r["base_sha256"] == hashlib.sha256(",".join(flat).encode()).hexdigest(), t
        assert set(flat) <= set(r["spans"].split(",")) | ({""} if not flat else set()) and len(r["spans"].split(",")) >= len(flat)
    assert pii.detect(docs([])).count() == 0


def test_reliabilities():
    """A labeler that agrees with the others is trusted; a noisy one is not; every yes raises a posterior."""
    counts = {(1, 1, 1): 80, (1, 1, 0): 60, (-1, -1, 0): 70, (-1, -1, 1): 20, (1, -1, 0): 5, (-1, 1, 0): 4}
    post = pii.reliabilities(counts)
    assert post[(1, 1, 0)] > 0.9 and post[(-1, -1, 1)] < 0.2
    for counts in (counts, {(1, 1, 0): 685, (1, -1, 0): 13, (1, 1, 1): 1}, {v: 1 for v in itertools.product((-1, 0, 1), repeat=3)}):
        post = pii.reliabilities(counts)
        for v, p in post.items():
            for i in range(3):
                for more in range(v[i] + 1, 2):
                    u = (*v[:i], more, *v[i + 1 :])
                    assert u not in post or post[u] > p


def test_classifier_sees_the_span():
    """Equal votes, other spans: the features decide, for each kind apart."""
    secret, card = pii.KINDS.index("secret"), pii.KINDS.index("card")
    rows = [(secret, (1, 0, 1, 1, 1, 0, 0), 0.95, 100), (secret, (0, 0, 0, 1, 0, 0, 0), 0.1, 100), (card, (0, 1, 0, 0, 0, 0, 0), 0.2, 50), (card, (0, 1, 0, 0, 0, 0, 1), 0.9, 50)]
    w = pii.classifier(rows)
    score = {r[:2]: float(np.dot(w, pii.span_vector(*r[:2]))) for r in rows}
    assert all((score[r[:2]] > 0) == (r[2] > 0.5) for r in rows)


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [[], [5], [rng.randrange(50) for _ in range(pii.PIECE)], [rng.randrange(50) for _ in range(3 * pii.PIECE + 7)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, n array<int>").where("size(n) > 0")
    got = {r["i"]: r["s"] for r in df.select("i", pii.running(F.col("n")).alias("s")).collect()}
    assert got == {i: [sum(r[:k]) for k in range(len(r))] for i, r in enumerate(rows) if r}


def test_secrets_and_other_spans(docs):
    """What the base patterns leave out is proposed, and judged by what it looks like."""
    rng = random.Random(12)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'some words token = "{key()}" and more words' for _ in range(60)] + [f"login password={key()[:16]} end" for _ in range(60)]
    texts += [f"plain words {i} and the build version=release notes here" for i in range(200)] + [f"call me at ({rng.randrange(200, 990)}) 555-{rng.randrange(1000, 9999)} today" for i in range(40)]
    texts += [f"mail to jo{i} [at] example [dot] com" for i in range(20)] + ["see chapter 1.2.3.400 and 999.1.1.1"] * 5
    rows = {r["doc_id"]: r for r in pii.detect(docs(texts)).collect()}
    found = [rows[i]["n_added"] > 0 and rows[i]["n_spans"] == rows[i]["n_added"] for i in range(len(texts))]
    assert all(found[:120]) and all(rows[i]["n_secret"] == 1 for i in range(120))
    assert not any(found[120:320])
    assert all(found[320:360]) and all(found[360:380])
    at = texts[0].index("token")
    assert rows[0]["spans"].startswith(f"secret:{at}:")


def test_mixing(spark, docs):
    rng = random.Random(8)
    texts = ["w " * rng.randrange(0, 60) for _ in range(900)] + [None]
    sources = [rng.choice(["a", "a", "a", "b", None, "é"]) for _ in texts]
    df = docs(texts, sources, key=1, size="clash", target=2)
    rows = mixing.systematic(df).collect()
    sizes, taken, goal = {}, {}, {}
    for r in rows:
        s, n = sources[r["doc_id"]], len((texts[r["doc_id"]] or "").split())
        assert r["size"] == n and 0 <= r["taken"] <= 2 * n
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + r["taken"]
        goal[s] = r["target"]
    weights = {"a": 3, "b": 1, "é": 2, None: 3}
    left, free, want = 1.5 * sum(sizes.values()), dict(weights), {}
    while free:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            del free[s]
    for s in sizes:
        assert abs(goal[s] - want[s]) < 1e-6 and abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 120
    again = mixing.systematic(df.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    copies = {r["doc_id"]: r["copies"] for r in rows}
    out = mixing.mixed(docs(texts, sources)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {k: v for k, v in copies.items() if v}
    assert mixing.systematic(docs([])).count() == 0
    assert [r["taken"] for r in mixing.systematic(docs([None, ""])).collect()] == [0, 0]


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 300)
    rng = random.Random(9)
    alphabet = ["the", " cat", "'s", "'", "12", "½", "²", "é", "中文", "𝄞", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "_", "!?", "<|endoftext|>", "x" * 40, "́", "ǅ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "a" * 20000, "ab " * 5000]
    rows = {r["doc_id"]: r for r in bpe.digests(docs(texts, block=1, data="clash"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    encode = reference_encoding().encode_ordinary
    for i, t in enumerate(texts):
        want = encode(t or "")
        assert rows[i]["n_tokens"] == len(want), repr(t)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs([]), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_bpe_of_equal_blocks(docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 50)
    one = docs(["w " * 80, "w " * 80, "other text"], ids=[1, 1, 2]).coalesce(1)
    encode = reference_encoding().encode_ordinary
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for df, times in ((one, 1), (one.union(one), 2)):
        got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.digests(df, path, public_tokenizers.PATTERN).collect())
        ids = [(i, encode(t)) for i, t in ((1, "w " * 80), (1, "w " * 80), (2, "other text"))]
        assert got == sorted((i, len(x), hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest()) for i, x in ids * times)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_splitter(text):
    """The faster pattern and the general one cut every text as the library does."""
    own = bpe.Splitter(public_tokenizers.PATTERN)(text)
    assert "".join(own) == text
    if "made" not in SHARED:
        SHARED["made"] = reference_encoding()
    encoding = SHARED["made"]
    assert [i for w in own for i in encoding._encode_single_piece(w)] == encoding.encode_ordinary(text)


SHARED: dict = {}


def test_packed_numbers():
    values = np.array([0, 1, 255, 256, 70000, 2**32 - 1], dtype="<u4")
    assert (bpe.unpacked(bpe.packed(values)) == values).all()
    assert len(bpe.unpacked(bpe.packed(np.zeros(0, "<u4")))) == 0
    assert bpe.Gather(np.arange(10), np.array([2, 0, 3, 5]))(np.array([2, 0, 1, 3])).tolist() == [2, 3, 4, 0, 1, 5, 6, 7, 8, 9]


def test_logistic_of_separable_points():
    """Classes that separate cleanly keep moderate weights and lie on their own sides."""
    rng = np.random.default_rng(3)
    for n in (40, 4000):
        y = (np.arange(n) % 3 > 0).astype(int)
        x = np.column_stack([y * 0.2 - 0.1 + rng.normal(size=n) * 1e-3, rng.normal(size=n), np.full(n, 2.0)])
        w = np.array(quality.logistic(x, y))
        p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
        assert np.isfinite(w).all() and ((p > 0.5) == (y == 1)).all()
    assert len(quality.logistic(np.zeros((0, 4)), np.zeros(0))) == 5


def test_syncmers_cut_texts_without_a_look_up_for_each_character(spark):
    """All blanks count as spaces, and a hash of one place needs no sequence."""
    from galenic.llm import syncmers

    df = spark.createDataFrame([(" a\tb\n\x0bc\x0cd\re\\fä\U0001f600",)], "text string")
    assert list("".join(df.selectExpr(f"{syncmers.code_points('text')} as c").first()["c"])) == list(" a b  c d e\\fä\U0001f600")
    assert "translate" not in syncmers.code_points("text")
    assert list(spark.sql(f"SELECT {syncmers.blank(chr(39) + 'ff' + chr(39))}, {syncmers.blank('chr(12)')}").first()) == [False, True]  # the letter is no form feed
    h = 7 << 32
    marks = spark.sql(f"SELECT {syncmers.counted(f'array(1L, {h}L, {h + 5}L, {h + 9}L, {8 << 32}L)')} AS m, array(xxhash64(0L, 0), xxhash64(7L, 0), xxhash64(7L, 1), xxhash64(7L, 2), xxhash64(8L, 0)) AS want").first()
    assert marks["m"] == marks["want"]


def test_syncmers_decide_by_pairs_and_match_compiled(spark, docs):
    """Places of inner runs are compared by twos in one pass, anchors matched outside of look-ups in arrays."""
    from galenic.llm import syncmers

    assert syncmers._runs("c").count("<=") <= syncmers.K - syncmers.S + 1  # either edge once, and it with each two of those between
    text = "".join(chr(97 + i * i * i % 23 + i % 3) for i in range(300))
    got = spark.createDataFrame([(text,), ("ab" * 50,), ("z" * 16,), ("z" * 15,)], "text string").selectExpr("text", f"{syncmers.places('text')} as p").collect()
    for r in got:
        assert sorted((f"{x & (1 << 64) - 1:016X}" for x in r["p"]), key=lambda x: x[8:]) == brute_anchors(r["text"])
    plan = syncmers.fingerprints(docs([text, text[:150] + text, None]))._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "array_intersect" in x]
    assert lines and not any("lambdafunction(size(array_intersect" in x or "array_intersect(lambda" in x for x in lines)
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], [])], "a array<bigint>, b array<bigint>").withColumn("n", F.expr(syncmers.both("a", "b")))
    assert [tuple(r) for r in df.selectExpr(syncmers.likeness("a", "b", "n"), syncmers.likeness("a", "b")).collect()] == [(0.5, 0.5), (1, 1), (0, 0)]


def test_syncmers_print_sixteen_digits(spark):
    """Hashes of every first digit, the lower and the upper half of the numbers."""
    from galenic.llm import syncmers

    values = [0, 1, 15, (1 << 60) - 1, 1 << 60, (1 << 63) - 1, -(1 << 63), -1]
    df = spark.createDataFrame([(values,)], "p array<bigint>")
    assert df.select(syncmers.fingerprint(F.col("p")).alias("f")).first()["f"] == ",".join(f"{x & (1 << 64) - 1:016X}" for x in values)
    assert spark.sql(f"SELECT {syncmers.counted('array(1L, 4294967301L, 8589934601L)')} = array(xxhash64(0L, 0), xxhash64(1L, 0), xxhash64(2L, 0)) AND {syncmers.counted('cast(array() as array<bigint>)')} = array() AS same").first()["same"]
