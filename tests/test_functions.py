"""Scalar and array functions against small Python models and authored edge rows."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from galenic.functions import arrays, classify, text, vocab


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("o")).collect()]


def texts(n, alphabet, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_slug(spark):
    def model(v):
        head = re.sub(r"[^a-zA-Z0-9\s-]", "", v.split(",")[0].strip().lower())
        return re.sub(r"\s+", "-", head).strip("-")

    values = ["A, b", "1,3-x", "-Alpha  beta-", "αβγ", "  x  y ", "", *texts(300, "aB1 ,-\t\nä/", 12, 1)]
    assert column(spark, values, text.slug) == [model(v) for v in values]
    assert column(spark, [None], text.slug) == [None]


def test_split_names(spark):
    def model(v):
        out, part = [], ""
        for i, c in enumerate(v):
            if c == "," and not (0 < i < len(v) - 1 and v[i - 1] in "0123456789" and v[i + 1] in "0123456789"):
                out.append(part)
                part = ""
            else:
                part += c
        return [p.strip() for p in [*out, part] if p.strip()]

    values = ["1,2,3-x, y", ",a,", "a,1", "1,a", "", *texts(500, "a1, \t", 10, 2)]
    assert column(spark, values, text.split_names) == [model(v) for v in values]


def test_clean_name(spark):
    def blocked(n):
        return any(b in n.lower() for b in vocab.BLOCKED)

    def number(n):
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+)?", n))

    def model(v):
        if not v or v == "nan":
            return None
        n = re.sub(r"\s+", " ", v).strip(" ,;")
        if "/" in n:
            parts = [p.strip() for p in n.split("/") if p.strip()]
            kept = [p for p in parts if not blocked(p) and not number(p)]
            if kept:
                return n if len(kept) == len(parts) else "/".join(kept)
        return None if not n or blocked(n) or number(n) else n

    rng = random.Random(3)
    words = ["placebo", "a", "1.5", "2", "treatment approach", "x y", "", " ", "Medical Care", "b;"]
    values = [None, "nan", " ,;", "1/2", "placebo/placebo", *("/".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(300))]
    assert column(spark, values, text.clean_name) == [model(v) for v in values]


def test_arrays(spark):
    values = [["A", "a", None, "", "b", "B", "c"], [], ["x", "y", "X"]]
    assert column(spark, values, arrays.dedupe_caseless, "array<string>") == [["A", "b", "c"], [], ["x", "y"]]
    assert column(spark, [["a", "", "a", None, "A"]], arrays.unique, "array<string>") == [["a", "A"]]
    assert column(spark, [["p", "q", "Q", "r", "s", "t", "u", "v"]], arrays.synonyms, "array<string>") == [["q", "r", "s", "t", "u"]]
    assert column(spark, [" a ,, b", None, "nan", ""], arrays.listed) == [["a", "b"], [], [], []]


def test_caseless_words_of_a_long_text(spark, tmp_path):
    """20,000 words: looking at all of them for each took minutes. A null text has no words, as in the SQL."""
    from galenic.plans import catalogue

    rng = random.Random(4)
    words = ["".join(rng.choice("aAbBcCdDä") for _ in range(rng.randrange(6))) for _ in range(20_000)]
    first: dict[str, str] = {}
    for w in filter(None, words):
        first.setdefault(w.lower(), w)
    spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    started = time.monotonic()
    got = {r[0]: (r[1], r[2]) for r in catalogue.dedupe_tokens(spark, str(tmp_path)).collect()}
    assert time.monotonic() - started < 40
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (len(first), sha("|".join(first.values()))), 2: (0, sha("")), 3: (0, sha(""))}


def plan(spark, expr, kind="string"):
    return spark.createDataFrame([], f"v {kind}").select(expr(F.col("v")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_cleaned_once(spark):
    """Functions of arrays look at their arguments anew for each element: what they share is bound."""
    names = lambda v: arrays.synonyms(arrays.dedupe_caseless(F.transform(F.split(v, ","), lambda x: F.upper(x))))
    assert plan(spark, names).count("upper(") == 1
    cleaned = plan(spark, text.clean_name)
    assert cleaned.count("btrim(") + cleaned.count("trim(both") <= 1 and cleaned.count("split(") == 1


def test_codes_and_years(spark):
    assert column(spark, ["A10BA02 x N02BE01", "a10ba02"], text.codes) == [["A10BA02", "N02BE01"], []]
    values = ["Adopted 1987, 2003", "x1999", "20031", "", "1950"]
    assert column(spark, values, text.year) == [20, None, None, None, 19]
    assert column(spark, values, lambda c: text.year(c, whole=True)) == [2003, None, None, None, 1950]


def test_small_text(spark):
    assert column(spark, ["brain_cns", "skin"], text.humanised) == ["Brain / Cns", "Skin"]
    assert column(spark, ["CC(=O)Cl", "c1ccccc1", ""], text.atoms) == [4, 0, 0]
    assert column(spark, ["x" * 51, "x" * 50], text.preview) == ["x" * 50 + "...", "x" * 50]
    assert column(spark, ["NA", "na", "nan", "None", "", "x"], text.known) == [None, "na", None, None, None, "x"]


def test_rules(spark):
    values = ["acid, diabetes", "Psychotic", "thyroid vitamin", "none", None, "blood pressure"]
    assert column(spark, values, classify.category_of_indication) == ["A", "S", "H", None, None, "C"]
    assert column(spark, ["heart", "ear", "bone_marrow", "bone marrow", "x"], classify.category_of_tissue) == ["C", "S", "B", "M", None]
    values = ["bronchus", "bone_marrow", "bone marrow", "éear", "an Ear.", "heart brain", ""]
    assert column(spark, values, classify.region_of_text) == [None, None, "blood_immune", None, "eye_ear", "brain_cns", None]


def test_generation_and_phase(spark):
    assert column(spark, [None, 0, 19, 1969, 1970, 1989, 1990, 2009, 2010], classify.generation, "int") == [1, 1, 1, 1, 2, 2, 3, 3, 4]
    lists = [["Phase I"], ["Phase II", "Phase I"], ["Phase III"], ["Phase IV"], ["x"], [], None]
    assert column(spark, lists, classify.phase, "array<string>") == ["I", "II", "IV", "IV", "IV", "IV", "IV"]


def test_category_regions(spark):
    assert column(spark, ["A", "E", None], classify.category_regions) == [list(vocab.CATEGORY_REGIONS["A"]), ["systemic_multiorgan"], ["systemic_multiorgan"]]
