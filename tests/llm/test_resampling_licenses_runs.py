"""Resampling, license scans and periodic runs against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from galenic.llm import importance, licenses, periodic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lowered(text))


# -- periodic runs -----------------------------------------------------------------


def brute_runs(a, least, times):
    found = {}
    for q in range(1, len(a) // times + 1):
        i = 0
        while i + q < len(a):
            if a[i] != a[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(a) and a[i] == a[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_text(rng, letters, most):
    a = [rng.choice(letters) for _ in range(rng.randrange(most))]
    if a and rng.random() < 0.6:
        at, p = rng.randrange(len(a)), rng.randrange(1, 9)
        a = a[:at] + [a[at + (i - at) % min(p, len(a) - at)] for i in range(at, len(a))] + [rng.choice(letters) for _ in range(rng.randrange(12))]
    return a


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        a = periodic_text(rng, "abcd"[: rng.randrange(1, 5)], 60)
        least, times = rng.choice([1, 2, 6]), rng.choice([2, 3, 4])
        assert periodic.runs(a, least, times) == brute_runs(a, least, times)


class Letter:
    """Counts how often letters are compared."""

    compared = 0

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        Letter.compared += 1
        return self.value == other.value

    def __lt__(self, other):
        Letter.compared += 1
        return self.value < other.value


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "text",
    [
        lambda n: "a" * n,
        lambda n: "ab" * (n // 4) + "c" + "ab" * (n // 4),
        lambda n: ("a" * 10 + "b") * (n // 11),
        lambda n: "".join("a" * k + "b" for k in range(1, int((2 * n) ** 0.5))),
        lambda n: "".join("ab" * k + "c" for k in range(int(n**0.5), 0, -1)),
        lambda n: "".join("ab"[bin(i).count("1") & 1] for i in range(n)),
        lambda n: "".join(chr(97 + (i & -i).bit_length()) for i in range(1, n)),
        fibonacci,
    ],
)
def test_runs_compare_a_fixed_number_of_times_a_word(text):
    for n in (2000, 16000):
        letters = [Letter(c) for c in text(n)]
        Letter.compared = 0
        periodic.runs(letters)
        assert Letter.compared < 12 * len(letters)


def test_detect(spark, docs):
    rng = random.Random(6)
    texts = [" ".join(periodic_text(rng, ["the", "of", "Ünder"], 80)) for _ in range(60)]
    texts += [None, "", " \n\t", "a", "a a a a a a", "x y " * 9, texts[0], " ".join(["lorem", "ipsum"] * 30_000)]
    rows = {r["doc_id"]: r for r in periodic.detect(docs(texts, n_runs=5, start="clash"), rewritten=True).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute_runs(w, 6, 4) if len(w) < 1000 else [(0, 60_000, 2)]
        r = rows[i]
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        kept = [x for j, x in enumerate(w) if not any(s + q <= j < s + n for s, n, q in found)]
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)


def test_detect_odd_tables(spark, docs):
    assert periodic.detect(docs([])).count() == 0
    rows = periodic.detect(docs(["a " * 9, "a " * 9, None], ids=[None, 3, 3]), rewritten=True).collect()
    assert sorted(r["n_runs"] for r in rows) == [0, 1, 1]
    df = docs(["a " * 9, "Clean text  stays\nas it is", None, ""], period=2)
    out = periodic.without_runs(df)
    assert out.columns == df.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["a", "Clean text  stays\nas it is", None, ""]


# -- resampling ----------------------------------------------------------------------


def test_crc_algebra():
    rng = random.Random(7)
    for _ in range(200):
        w = [bytes(rng.randrange(33, 256) for _ in range(rng.choice([1, 2, 7, 40, 3000]))) for _ in range(rng.randrange(1, 7))]
        crc, length = np.array([zlib.crc32(x) for x in w], dtype=np.uint32), np.array([len(x) for x in w])
        found = importance.ngram_crcs(crc, length, 4)
        for n, values in enumerate(found, 1):
            assert values.tolist() == [zlib.crc32(b" ".join(w[i : i + n])) for i in range(len(w) - n + 1)]
        assert len(found) == min(4, len(w))


def brute_resampled(texts, target, most, buckets, percent, least):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for held, all_texts in ((s, texts), (t, target)):
        for text in all_texts:
            for b in features(text):
                held[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in enumerate(texts):
        found = features(text)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if len(words(texts[r[0]])) >= least), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return {r[0]: (*r[1:], rank.get(r[0])) for r in rows}


def sample_texts(n, seed):
    rng = random.Random(seed)
    known = ["the", "Of", "ÉTÉ", "x1", "straße", "zwölf", "naïve", "cat", "DOG", "sun"]
    return [rng.choice([" ", ", ", "-", "  "]).join(rng.choice(known) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 3])
def test_resampled(spark, docs, most):
    texts = [*sample_texts(120, 8), None, "", "... !", "word " * 20_000]
    texts.append(texts[0])
    target = sample_texts(10, 9)
    found = importance.resampled(docs(texts, score=0, rank="clash"), docs([*target, None]), most=most, buckets=97, percent=30)
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()}
    assert got == brute_resampled(texts, target, most, 97, 30, 20)


def test_resampled_odd_tables(spark, docs):
    assert importance.resampled(docs([]), docs(["a b"])).count() == 0
    texts = ["one two three " * 9] * 4
    rows = importance.resampled(docs(texts, ids=[None, 5, 5, None]), docs([]), percent=50).collect()
    assert sorted(r["rank"] or 0 for r in rows) == [0, 0, 1, 2]
    df = docs(texts[:2] + [None], label="x")
    out = importance.drawn(df, docs(["one two"]), percent=50)
    assert out.columns == df.columns and out.count() == 1
    with pytest.raises(ValueError, match="buckets"):
        importance.resampled(df, df, buckets=0)


# -- license scans ---------------------------------------------------------------------


def brute_scan(text, templates, percent):
    w = words(text)
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    for i in range(0, max(len(w) - licenses.STEP, 1), licenses.STEP):
        block = set(w[i : i + licenses.WIDE])
        held = {label: (len(block & set(t.split())), len(set(t.split()))) for label, t in templates}
        met = {label: a / n for label, (a, n) in held.items() if 100 * a >= percent * n}
        if met:
            labels |= {k for k, v in met.items() if v == max(met.values())}
            best = max(best, *met.values())
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


def license_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = [rng.choice(["the", "lorem", "été", "version", "2", "0", "by"]) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            _, text = rng.choice(licenses.TEMPLATES)
            part = [x for x in text.split() if rng.random() > 0.12]
            at = rng.randrange(len(t) + 1)
            t[at:at] = part
        out.append(rng.choice([" ", ". ", "\n", "-"]).join(x.upper() if rng.random() < 0.3 else x for x in t))
    return out


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_scan(spark, docs, percent):
    texts = [*license_texts(150, percent), None, "", "?!", "Licensed under CC BY-NC 4.0.", "ALL RIGHTS RESERVED all rights reserved", "Knsas ccİ by", "cc by " * 20_000]
    texts += texts[:3]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs(texts, labels="clash", word=1, block=2), percent=percent).collect()}
    assert got == {i: brute_scan(t, licenses.TEMPLATES, percent) for i, t in enumerate(texts)}


def test_scan_odd_tables(spark, docs):
    assert licenses.scan(docs([])).count() == 0
    rows = licenses.scan(docs(["released under the MIT license", "released under the MIT license", "plain", None], ids=[None, 7, 7, None])).collect()
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in rows) == [(0, ""), (0, "mit"), (7, ""), (7, "mit")]
    assert licenses.scan(docs(["cc by"]), templates=()).first()["labels"] == "cc-by"
    assert licenses.scan(docs(["cc by", "released under the mit license"]), phrases=()).where("labels = 'mit'").count() == 1
    with pytest.raises(ValueError, match="templates"):
        licenses.scan(docs(["x"]), templates=(("long", "w " * 40),))
