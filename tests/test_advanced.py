"""Index, rules as data, identifiers as a fixpoint, facet cube and paths, each against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from galenic.functions import classify, vocab
from galenic.operators import facets, filters, ids, lookups, rules, textindex
from galenic.plans import advanced

SF = "/root/testdata/sf0.001"


# -- identifiers ---------------------------------------------------------------------------


def one_after_another(rows):
    """The names of (ord, base, parts) rows, chosen in order."""
    used, seen, out = set(), Counter(), {}
    for ord_, base, *parts in sorted(rows, key=lambda r: (r[0], r[1], [(p is not None, p) for p in r[2:]])):
        if base is None:
            out[ord_] = None
            continue
        seen[base] += 1
        n = seen[base]
        names = [base] if n == 1 else []
        for part in [*(p.lower() for p in parts if p), str(n)]:
            names.append(f"{names[-1] if names and len(names) > (n == 1) else base}-{part}")
        while names[-1] in used:
            names.append(f"{names[-1]}-{n}")
        out[ord_] = next(x for x in names if x not in used)
        used.add(out[ord_])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_ids_as_if_one_after_another(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "a-x", "a-x-2", "a-2", "a-2-2", "a-y-x", "b", "b-x", "", None]
    rows = [(i, rng.choice(bases), rng.choice(["X", "x", "y", "", None, "2"]), rng.choice(["x", "z", None, ""])) for i in range(400)]
    df = spark.createDataFrame(rows, "ord long, base string, p string, q string")
    got = {r["ord"]: r["unique_id"] for r in ids.unique_ids(df.repartition(7), "base", [F.col("p"), F.col("q")]).collect()}
    assert got == one_after_another(rows)
    known = [v for v in got.values() if v is not None]
    assert len(known) == len(set(known))


def test_ids_of_one_large_family(spark):
    """Rows that all ask for one name: the second round settles them, and no task numbers them all."""
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("ord"), F.lit("drug").alias("base"), F.lit("K").alias("p"))
    found = ids.unique_ids(df, "base", [F.col("p")])
    assert found.select("unique_id").distinct().count() == n
    got = {r["ord"]: r["unique_id"] for r in found.where(f"ord < 4 or ord = {n - 1}").collect()}
    assert got == {0: "drug", 1: "drug-k", 2: "drug-k-3", 3: "drug-k-4", n - 1: f"drug-k-{n}"}


def test_ids_of_no_rows_and_alike_rows(spark):
    schema = "ord long, base string, p string, unique_id int"
    assert ids.unique_ids(spark.createDataFrame([], schema).drop("unique_id"), "base", [F.col("p")]).count() == 0
    rows = [(1, "a", "x")] * 3 + [(None, "a", None)]
    got = ids.unique_ids(spark.createDataFrame(rows, "ord long, base string, p string"), "base", [F.col("p")])
    assert sorted(r["unique_id"] for r in got.collect()) == ["a", "a-x", "a-x-3", "a-x-4"]
    assert got.where("ord is null").first()["unique_id"] == "a"


# -- facets ------------------------------------------------------------------------------------


def test_cube_against_counts(spark):
    rng = random.Random(2)
    places = [r for r, *_ in vocab.REGIONS]
    rows = [(i, rng.choice("AVX"), rng.sample(places, rng.randrange(0, 3)), rng.choice([*vocab.PHASES, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, c string, r array<string>, p string")
    cube = facets.facet_cube(df, F.col("r"), F.col("c"), F.col("p"))
    got = {(r["category"], r["region"], r["phase"], r["gid"]): r["n"] for r in cube.collect()}
    n_phases, n_categories = len(vocab.PHASES) + 1, len(vocab.CATEGORIES) + 1
    for gid in range(8):
        whole = defaultdict(set)
        for i, c, r, p in rows:
            for region in [None] if gid & 2 else r:
                whole[None if gid & 4 else c, region, None if gid & 1 else p].add(i)
        for key, found in whole.items():
            assert got[(*key, gid)] == len(found)
        assert sum(v for k, v in got.items() if k[3] == gid) == sum(map(len, whole.values()))
    assert len([k for k in got if k[3] == 3]) == n_categories and len([k for k in got if k[3] == 6]) == n_phases
    named = {r["region"]: r["n"] for r in facets.facet(cube, "region", category="A").collect()}
    assert named == {place: sum(c == "A" and place in r for _, c, r, _ in rows) for place in places}
    assert facets.facet(cube, phase="II", region="skin").first()["n"] == sum(p == "II" and "skin" in r for _, _, r, p in rows)


def test_cube_is_one_expand_and_one_shuffle(spark):
    cube = advanced.facet_cube(spark, SF)
    plan = cube._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Expand ") == 1
    assert cube._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


# -- paths -----------------------------------------------------------------------------------------


def test_paths(spark):
    rows = [
        ("brain", "brain", None), ("brain", "cortex", "brain"), ("brain", "layer", "cortex"), ("brain", "lost", "nowhere"),
        ("brain", "a", "b"), ("brain", "b", "a"), ("brain", "below", "a"), ("eye", "cortex", "eye"), ("eye", "eye", None), ("eye", "self", "self"), ("eye", "eye", None),
    ]
    found = {(r["region"], r["node"]): (r["depth"], r["root"], r["path"]) for r in lookups.anatomy_paths(spark.createDataFrame(rows, "region string, node string, parent string")).collect()}
    nothing = (None, None, None)
    assert found == {
        ("brain", "brain"): (0, "brain", "brain"), ("brain", "cortex"): (1, "brain", "brain > cortex"), ("brain", "layer"): (2, "brain", "brain > cortex > layer"),
        ("brain", "lost"): (0, "lost", "lost"), ("brain", "a"): nothing, ("brain", "b"): nothing, ("brain", "below"): nothing,
        ("eye", "eye"): (0, "eye", "eye"), ("eye", "cortex"): (1, "eye", "eye > cortex"), ("eye", "self"): nothing,
    }


# -- rules -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["indication", "tissue", "region"])
def test_rules_as_data_equal_the_case_expressions(spark, name):
    of = {"indication": classify.category_of_indication, "tissue": classify.category_of_tissue, "region": classify.region_of_text}[name]
    words = [w for _, ws in (*vocab.INDICATION_RULES, *vocab.REGION_RULES) for w in ws] + [w for w, _ in vocab.TISSUE_RULES]
    rng = random.Random(3)
    texts = [rng.choice([" ", "-", "_", "\n", ""]).join(rng.choice([*words, "pre", "éx", "Xs", "."]).title() for _ in range(rng.randrange(4))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "k long, text string")
    got = {r["k"]: r["value"] for r in rules.first_rule(df, "k", F.col("text"), advanced.vocabulary_rules(spark, name)).collect()}
    assert got == {r["k"]: r["v"] for r in df.select("k", of(F.col("text")).alias("v")).collect()}
    assert len(set(got.values())) > 5


@pytest.mark.parametrize("direct", [1, 64])
def test_rules_against_brute_force(spark, monkeypatch, direct):
    monkeypatch.setattr(rules, "DIRECT", direct)
    rng = random.Random(4)
    letters = ["a", "b", "é", "-", " ", "_", "."]
    made = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    given = [(i, made(6), f"v{i % 5}", rng.random() < 0.3) for i in range(150)]
    texts = [made(30) for _ in range(80)]

    def first(text):
        for _, keyword, value, whole in given:
            word = whole and " " not in keyword
            pattern = rf"(?:^|[^\w]){re.escape(keyword)}(?:[^\w]|$)" if word else re.escape(keyword)
            if keyword.strip() and re.search(pattern, text):
                return value
        return None

    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    table = spark.createDataFrame(given, rules.RULES)
    got = {r["k"]: r["value"] for r in rules.first_rule(df, "k", F.col("text"), table).collect()}
    assert got == {i: first(t) for i, t in enumerate(texts)}
    assert {r["value"] for r in rules.first_rule(df, "k", F.col("text"), table.limit(0)).collect()} == {None}


def test_keywords_behind_the_first_are_not_looked_for(spark):
    """The first keyword that stands in a text ends the search: those behind it cost a whole text each."""
    asked = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("keyword")) for i, k in ((3, "x y"), (5, "b c"), (9, "c d"))))
    df = spark.createDataFrame([("A B c D",), ("c d",), ("none",), (None,)], "t string").select(rules.first_of(F.col("t"), asked).alias("o"))
    assert [r["o"] for r in df.collect()] == [5, 9, None, None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "filter(" not in plan


def test_plan_does_not_grow_with_rules(spark):
    df = spark.createDataFrame([(1, "the end")], "k long, text string")
    sizes = []
    for n in (1000, 20_000):  # both with more keywords with blanks than are looked for in every text
        some = advanced.generated_rules(spark).where(f"rank <= {n}")
        sizes.append(len(rules.first_rule(df, "k", F.col("text"), some)._jdf.queryExecution().toString()))
    assert sizes[1] < 1.2 * sizes[0]


# -- search ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(5)
    words = ["the", "Thé", "there", "other", "brother", "a", "bo", "x-ray", "ΣΑΣ", "end."]
    rows = [(i, rng.choice(["web", "Other", "", None]), rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(200)]
    rows += [(200, None, None), (201, "", ""), (202, "s", "y" * 20_000 + "zebra" + "y" * 20_000)]
    df = spark.createDataFrame(rows, "k long, name string, text string").repartition(6).cache()
    hay = filters.haystack_of(F.col("name"), F.col("text"))
    return df, hay, textindex.build(df, "k", hay)


def files_read(df):
    """The files that the scan of rows in an executed plan has listed."""

    def scans(node):
        children = node.children().iterator()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            yield from scans(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            yield from scans(node.plan())
        if node.nodeName().startswith("Scan") and "file_path" in node.toString():
            yield node.metrics().apply("numFiles").value()
        while children.hasNext():
            yield from scans(children.next())

    return sum(scans(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("query", ["othe", "the there", "her\nbrother", "bo a", "none such", "σας", " the ", "the  the", "web the"])
def test_index_against_scan(spark, indexed, query):
    df, hay, index = indexed
    q = query.lower()
    holds = F.contains(F.lower(hay), F.lit(q))
    want = sorted(r["k"] for r in df.where(holds).collect())
    found = textindex.search_indexed(index, query, holds)
    assert found.columns == ["k", "name", "text"] and sorted(r["k"] for r in found.collect()) == want
    fields = filters.in_fields(query, texts=("name", "text"), lists=())
    assert sorted(r["k"] for r in textindex.search_indexed(index, query, fields).collect()) == sorted(r["k"] for r in df.where(fields).collect())


def test_index_reads_only_what_matches(spark, indexed):
    _, hay, index = indexed
    assert textindex.pieces("ab") == [] and textindex.candidates(index, "a bo") is None
    found = textindex.search_indexed(index, "zebra", F.contains(F.lower(hay), F.lit("zebra")))
    assert index.rows.select("_slot").distinct().count() > 1
    found.collect()
    assert files_read(found) == 1
    words = textindex.matching_words(index, "zebra", "inside").collect()
    assert len(words) == 1 and words[0]["n"] == 1
    grams = index.grams.select("gram", "_part").distinct().collect()
    assert len({r["_part"] for r in grams}) > 1
    assert all(a <= b for a, b in itertools.pairwise(r["gram"] for r in sorted(grams, key=lambda r: (r["_part"], r["gram"]))))


def test_index_of_no_rows(spark):
    df = spark.createDataFrame([], "k long, text string")
    index = textindex.build(df, "k", F.col("text"))
    assert textindex.search_indexed(index, "abc", F.contains("text", F.lit("abc"))).count() == 0
