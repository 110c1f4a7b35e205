"""Ordered rules as a table: the first rule whose keyword stands in a text, for any number of rules.

Rules are rows of rank, keyword, value and whole (the keyword must stand as a word of its
own, between characters that are no letters, digits or underscores; keywords with
blanks count anywhere).  Neither the plan nor a task grows with them: rules are
matched against the distinct words of the corpus, by trigrams.

1.  A keyword without blanks that a text contains stands inside one of its words.  It is
    posted under one of its trigrams, the one that fewest distinct words have, joined
    with the words' trigrams and confirmed on the word.
2.  A word's first rule is the smallest rank of its matches (``min``), a text's
    first rule the smallest of its words.
3.  Of the keywords with blanks the first ``DIRECT`` are looked for in every text.  Those
    behind them matter only to texts whose rank so far is larger, or that have none:
    there they are looked up by their longest piece, at the end, the start or the
    whole of a word, and confirmed on the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.functions.classify import AFTER, BEFORE
from galenic.functions.text import bound
from galenic.operators.textindex import BLANK, GRAM, grams_of, words_of
from galenic.sources.shared import staged

#: Keywords with blanks that are looked for in every text.
DIRECT = 64
#: Characters of a word, as in the boundaries of ``classify``.
LETTER = r"\p{L}\p{N}_"
RULES = "rank int, keyword string, value string, whole boolean"


def keyed(rules: DataFrame) -> DataFrame:
    """rank, keyword, whole, piece (its longest) and how that stands in a word."""
    parts = F.split("keyword", BLANK)
    place = F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("less"), i.alias("i"), p.alias("piece")))
    best = F.array_min(F.filter(place, lambda p: p["piece"] != ""))
    last = F.size(parts) - 1
    how = F.when(last == 0, "inside").when(best["i"] == 0, "end").when(best["i"] == last, "start").otherwise("whole")
    found = rules.where(F.regexp_replace("keyword", BLANK, "") != "")
    return found.select("rank", F.lower("keyword").alias("keyword"), F.coalesce("whole", F.lit(False)).alias("whole"), F.lower(best["piece"]).alias("piece"), how.alias("how"))


def gram_size(piece: Column) -> Column:
    return F.least(F.length(piece), F.lit(GRAM))


def grams_by_size(text: Column, sizes: list[int]) -> Column:
    return F.flatten(F.array(*(grams_of(text, k) for k in sizes)))


def word_rules(words: DataFrame, rules: DataFrame) -> DataFrame:
    """word, rank, keyword, single: rules whose piece stands in a word as it must; confirmed for single words."""
    sizes = sorted(r[0] for r in rules.select(gram_size(F.col("piece"))).distinct().collect())  # 1 to 3: three rows at most
    if not sizes:
        return words.limit(0).select("word", F.lit(0).alias("rank"), F.lit("").alias("keyword"), F.lit(True).alias("single"))
    held = staged(words.select("word", F.explode(grams_by_size(F.col("word"), sizes)).alias("gram")), "grams")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    posts = rules.select("*", F.explode(F.filter(grams_by_size(F.col("piece"), sizes), lambda g: F.length(g) == gram_size(F.col("piece")))).alias("_gram"))
    posts = posts.join(counts, F.col("_gram") == F.col("gram"), "left")  # a gram that no word has leaves nothing to find
    best = posts.groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("best"), F.first(F.struct("keyword", "whole", "piece", "how")).alias("rule"))
    best = staged(best.where("best.n > 0").select("rank", "rule.*", F.col("best.gram").alias("_gram")), "rules")
    met = held.join(best, F.col("gram") == F.col("_gram"))
    plain = F.regexp_like("piece", F.lit(f"^[{LETTER}]+$"))  # stands alone where it is one of the word's runs of letters
    quoted = F.concat(F.lit(BEFORE), F.regexp_replace("piece", f"([^{LETTER}])", r"\\$1"), F.lit(AFTER))
    apart = F.when(plain, F.array_contains(F.split("word", f"[^{LETTER}]+"), F.col("piece"))).otherwise(F.regexp_like("word", quoted))
    alone = F.contains("word", "piece") & (~F.col("whole") | apart)
    stands = F.when(F.col("how") == "inside", alone).when(F.col("how") == "end", F.endswith("word", "piece")).when(F.col("how") == "start", F.startswith("word", "piece")).otherwise(F.col("word") == F.col("piece"))
    return met.where(stands).select("word", "rank", "keyword", (F.col("how") == "inside").alias("single"))


def first_of(text: Column, asked: Column) -> Column:
    """The smallest rank of ``asked`` (array of rank, keyword; in order) whose keyword stands in ``text``, in lower case once for all.

    Those behind the first that stands there are not looked for."""
    look = lambda lowered: lambda found, m: F.when(found.isNotNull(), found).when(F.contains(lowered, m["keyword"]), m["rank"])
    return bound(F.lower(text), lambda lowered: F.aggregate(asked, F.lit(None).cast("int"), look(lowered)))


def smallest(*found: DataFrame) -> DataFrame:
    """_key, rank: the smallest rank of each key."""
    return reduce(DataFrame.union, (f.select("_key", "rank") for f in found)).where("rank is not null").groupBy("_key").agg(F.min("rank").alias("rank"))


def first_rule(df: DataFrame, key: str, text: Column, rules: DataFrame) -> DataFrame:
    """key, value of every row of ``df``: that of the first rule whose keyword stands in ``text``, else null.

    ``key`` tells rows apart.  Null texts, and rules without a keyword, match nothing.
    """
    rules = staged(rules.select("rank", "keyword", "value", "whole"), "given")
    texts = df.select(F.col(key).alias("_key"), text.alias("_text"))
    asked = keyed(rules)
    words = staged(texts.select(F.explode(words_of(F.col("_text"))).alias("word")).distinct(), "distinct")
    matches = staged(word_rules(words, asked), "matches")

    single = matches.where("single").groupBy("word").agg(F.min("rank").alias("rank")).withColumnRenamed("word", "_word")
    each = texts.select("_key", F.explode(words_of(F.col("_text"))).alias("word"))
    found = each.join(single, F.col("word") == F.col("_word")).groupBy("_key").agg(F.min("rank").alias("rank"))
    several = asked.where("how <> 'inside'")
    first = several.orderBy("rank").limit(DIRECT + 1).collect()
    if first:
        direct = F.array(*(F.struct(F.lit(r["rank"]).alias("rank"), F.lit(r["keyword"]).alias("keyword")) for r in first[:DIRECT]))
        found = smallest(found, texts.select("_key", first_of(F.col("_text"), direct).alias("rank")))
    if len(first) > DIRECT:
        found = staged(found, "single")
        settled = found.where(F.col("rank") < first[-1]["rank"]).select(F.col("_key").alias("_done"))
        open_ = staged(texts.select(F.col("_key").alias("_open")).join(settled, F.col("_open") == F.col("_done"), "left_anti"), "open")  # keys alone, so that texts stay where they are if these are few
        rest = texts.join(open_, F.col("_key") == F.col("_open"), "left_semi")
        by_word = matches.where(~F.col("single") & (F.col("rank") >= first[-1]["rank"])).groupBy(F.col("word").alias("_word")).agg(F.collect_set(F.struct("rank", "keyword")).alias("asked"))
        met = rest.select("_key", F.explode(words_of(F.col("_text"))).alias("word")).join(by_word, F.col("word") == F.col("_word")).select("_key", F.explode("asked").alias("asked"))
        best = found.select(F.col("_key").alias("_best"), F.col("rank").alias("_rank"))
        met = met.join(best, F.col("_key") == F.col("_best"), "left").where(F.col("_rank").isNull() | (F.col("asked.rank") < F.col("_rank")))
        met = met.groupBy(F.col("_key").alias("_row")).agg(F.array_sort(F.collect_set("asked")).alias("asked"))  # of the keywords with blanks
        longer = rest.join(met, F.col("_key") == F.col("_row")).select("_key", first_of(F.col("_text"), F.col("asked")).alias("rank"))
        found = smallest(found, longer)
    values = rules.groupBy("rank").agg(F.first("value").alias("value")).withColumnRenamed("rank", "_rank")
    named = found.join(values, F.col("rank") == F.col("_rank")).select(F.col("_key").alias("_found"), "value")
    return df.select(F.col(key)).join(named, F.col(key) == F.col("_found"), "left").select(key, "value")
