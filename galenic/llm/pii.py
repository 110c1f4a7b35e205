"""Personal data by weak supervision. DataFrame functions only.

Base patterns find emails, ip addresses, card and phone numbers.  Wider
patterns propose candidates of every kind: spelled-out emails, version-like
quadruples, digit runs of a card's length, numbers without a country code,
identity numbers, and secrets (keys with a value, long mixed tokens).

Three labelers vote yes, no or not at all on every candidate, base or not:
  regex      the strict form: check digits, octets, groups of digits, length and mix of a secret
  gazetteer  lists: endings of domains, reserved networks, card issuers, area and country codes, key words of secrets
  context    the words before it: cues for the kind, or for something else (versions, invoices, checksums)

Expectation-maximisation over the counts of vote patterns estimates, for each
kind, how often it is right and how reliable each labeler is.  A labeler is
taken to be better than chance, so that a yes never lowers a posterior; one
that abstains says nothing.  The posteriors are the labels of a logistic
classifier over features of the span itself (kind, length, share of digits,
mix of characters, quotes, grouping, check digits), which decides on the candidates.  Base
spans stay whatever it says.

Only counts reach the driver: one row for each combination of kind (6), votes
(27) and features (2 to the power of 7), 20,736 at most.

Positions count code points, the end is exclusive.  Edge cases: null and empty
texts have no spans; control characters 1 and 2 in a text count as characters
and match nothing; repeated rows are treated row by row; an empty table gives
an empty result; extra columns are ignored; of candidates that overlap, base
spans win, then the earlier kind, then the earlier span.  The patterns are
possessive where runs can be long, so long texts need neither deep recursion
nor quadratic time, and positions are summed in pieces of ``PIECE`` matches.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galenic.llm.common import staged

KINDS = ("email", "ip", "card", "phone", "id", "secret")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits with single separators, of 16 to 19 digits: longer and shorter runs fail as a whole.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MORE_EMAIL = rf"(?<!{LOCAL}){LOCAL}++\x20?[\[(]at[\])]\x20?{LABEL}++(?:\x20?(?:\.|[\[(]dot[\])])\x20?{LABEL}++)++"
MORE_CARD = r"(?<![0-9A-Za-z.])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9A-Za-z])"
MORE_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
MORE_ID = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
#: A key word, a sign and a value without blanks; a long token in quotes or after a sign; well-known prefixes.
SECRET_KEYS = "(?:password|passwd|passwort|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|client[_-]?secret|auth|credential|bearer)"
MORE_SECRET = (
    rf"(?i)(?<![A-Za-z0-9_]){SECRET_KEYS}[\x20]{{0,2}}[:=][\x20]{{0,2}}[\x22\x27]?[A-Za-z0-9+/_.=-]{{8,512}}+"
    r"|(?<![A-Za-z0-9_])[A-Za-z_]{1,40}+[\x20]{0,2}[:=][\x20]{0,2}[\x22\x27]?[A-Za-z0-9+/_-]{20,512}+"
    r"|(?<![A-Za-z0-9])(?-i:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,128}+)"
)
#: A text without a match of these has no candidate of the kind.
PREFILTER = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "more email": r"[\[(]at[\])]", "more phone": r"[0-9]{3}[\x20.-][0-9]{4}", "id": r"-[0-9]{2}-", "secret": r"[:=][\x20]{0,2}[\x22\x27]?[A-Za-z0-9+/_.=-]{8}|AKIA|gh[pousr]_|sk-"}

#: Gazetteers: endings of domains, first octets in no public network, first digits of card issuers, country codes.
ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "be", "pl", "se", "no", "dk", "fi", "pt", "ie", "us", "ca", "au", "jp", "cn", "in", "br", "mx", "ru")
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5)|35|62)"
COUNTRIES = "^\\+(?:1|7|2[07]|3[0-4691]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: The words before a candidate that speak for its kind, and those that speak for something else.
CUES = {
    "email": "mail|contact|write to|reach|address|from|cc",
    "ip": "ip|host|server|address|ping|gateway|client|network",
    "card": "card|visa|mastercard|amex|credit|debit|payment|account",
    "phone": "call|phone|tel|telephone|mobile|cell|fax|dial|number|sms",
    "id": "ssn|social security|identity|id no|passport|tax",
    "secret": "key|login|user|credential|config|export|env|set|header|auth",
}
COUNTER_CUES = "(?:version|release|isbn|issn|part|order|invoice|section|figure|table|page|build|ticket|commit|checksum|sha1|sha256|md5|digest|hash|example)"
#: Matches whose positions are summed at a time.
PIECE = 256

SPAN = "struct<start: int, end: int, text: string, before: string>"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column) -> Column:
    """The sum of all values before each one, in pieces, so that no array grows one by one beyond ``PIECE`` values or pieces."""

    def sums(values: Column) -> Column:
        step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(values, start, step, lambda s: s["out"])

    def pieces(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / PIECE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * PIECE + 1, F.lit(PIECE)))

    def added(p: Column) -> Column:
        starts = sums(F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)))
        return F.flatten(F.zip_with(p, starts, lambda x, s: F.transform(sums(x), lambda y: y + s)))

    return let(lengths, lambda values: let(pieces(values), added))


def spans(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, end, text, before>> of the matches of ``pattern``, of texts that match ``hint``."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def found(pieces: Column) -> Column:
        def located(at: Column) -> Column:
            def one(i: Column) -> Column:
                piece, start = F.get(pieces, i), F.get(at, i)
                return F.struct(start.alias("start"), (start + F.length(piece)).alias("end"), piece.alias("text"), F.lower(F.right(F.get(pieces, i - 1), F.lit(40))).alias("before"))

            return F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)), one)

        return let(running(F.transform(pieces, lambda p: F.length(p))), located)

    def cut(marked: Column) -> Column:
        return F.when(F.contains(marked, F.lit("\x02")), let(F.split(marked, "[\x01\x02]"), found)).otherwise(none)

    marked = F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x02"))
    return F.when(text.rlike(hint), let(marked, cut)).otherwise(none)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = number.substr(-i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def octet(part: Column) -> Column:
    """Digits, zeros in front or not, that make at most 255."""
    value = F.ltrim(part, F.lit("0"))
    return F.when(F.length(value) > 3, F.lit(False)).otherwise(F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)


def octets(text: Column) -> Column:
    return F.forall(F.split(text, "\\."), octet)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": spans(text, EMAIL, PREFILTER["email"]),
        "ip": F.filter(spans(text, IP, PREFILTER["ip"]), lambda s: octets(s["text"])),
        "card": F.filter(spans(text, CARD, PREFILTER["card"]), lambda s: luhn(digits(s["text"]))),
        "phone": F.filter(spans(text, PHONE, PREFILTER["phone"]), lambda s: F.length(digits(s["text"])).between(8, 15)),
    }


def more_spans(text: Column) -> dict[str, Column]:
    """Candidates of all kinds, wider than the base."""
    return {
        "email": spans(text, MORE_EMAIL, PREFILTER["more email"]),
        "ip": spans(text, IP, PREFILTER["ip"]),
        "card": spans(text, MORE_CARD, PREFILTER["card"]),
        "phone": spans(text, MORE_PHONE, PREFILTER["more phone"]),
        "id": spans(text, MORE_ID, PREFILTER["id"]),
        "secret": spans(text, MORE_SECRET, PREFILTER["secret"]),
    }


def value_of(secret: Column) -> Column:
    """What stands after the sign (and quote) of a secret, or all of it."""
    return F.regexp_extract(secret, r"^(?:[A-Za-z_\x20-]{1,40}[:=]\x20{0,2})?[\x22\x27]?(.*)$", 1)


def mixed(value: Column) -> Column:
    """Letters and digits both, in more than one place: no word and no number."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.length(F.regexp_replace(value, "[A-Za-z]+|[0-9]+", "x")) > 3)


def votes(kind: str, span: Column) -> tuple[Column, Column, Column]:
    """Of the regex, gazetteer and context labelers: 1 yes, -1 no, 0 abstains."""
    text, before = span["text"], span["before"]
    number = digits(text)
    form = {
        "email": text.rlike(rf"^{LOCAL}*[A-Za-z0-9]{LOCAL}*(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9].*[A-Za-z]{{2,24}}$"),
        "ip": octets(text) & ~text.rlike(r"(^|\.)0[0-9]"),
        "card": luhn(number) & text.rlike(r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$"),
        "phone": text.rlike(r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}$|^\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}$|^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$"),
        "id": ~number.rlike("^(?:000|666|9)|^...00|0000$"),
        "secret": mixed(value_of(text)) & (F.length(value_of(text)) >= 12),
    }[kind]
    known = {
        "email": F.when(F.lower(F.regexp_extract(text, "([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS), 1).otherwise(-1),
        "ip": F.when(F.regexp_extract(text, "^0*([0-9]+)", 1).isin("0", "127", "255"), -1).otherwise(1),
        "card": F.when(number.rlike(ISSUERS), 1).otherwise(-1),
        "phone": F.when(F.when(F.left(text, F.lit(1)) == "+", text.rlike(COUNTRIES)).otherwise(number.rlike("^[2-9][0-9]{2}[2-9]")), 1).otherwise(-1),
        "id": F.when(number.rlike("^[0-7]"), 1).otherwise(-1),
        "secret": F.when(text.rlike(rf"(?i)^{SECRET_KEYS}|^(?-i:AKIA|gh[pousr]_|sk-)"), 1).otherwise(0),
    }[kind]
    cued = F.when(before.rlike(rf"\b{COUNTER_CUES}\W{{0,4}}(?:\w+\W{{1,3}}){{0,1}}$"), -1).when(before.rlike(rf"\b(?:{CUES[kind]})s?\W{{0,4}}(?:\w+\W{{1,3}}){{0,2}}$"), 1).otherwise(0)
    if kind == "secret":  # the key is part of the span
        cued = F.when(F.lower(text).rlike(rf"^{COUNTER_CUES}\b"), -1).otherwise(cued)
    return F.when(form, 1).otherwise(-1), known, cued


#: Names of the features of a span, 0 or 1 each.
FEATURES = ("long", "digits", "mixed", "signs", "quoted", "grouped", "checked")


def features(kind: str, span: Column) -> list[Column]:
    """Of the span itself: over 20 characters; mostly digits; letters and digits mixed; a sign of assignment or
    an @; a quote; separators between digits; check digits (cards) or octets (addresses) that hold."""
    text = span["text"]
    n, d = F.length(text), F.length(digits(text))
    checked = {"card": luhn(digits(text)), "ip": octets(text)}.get(kind, F.lit(False))
    return [n > 20, 2 * d >= n, mixed(text), text.rlike("[@=:]"), text.rlike(r"[\x22\x27]"), text.rlike(r"[0-9][\x20().-]+[0-9]"), checked]


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: arrays of (kind, start, end, v1..v3, f1..f7), kinds by their place in KINDS."""
    text = F.translate(F.coalesce("text", F.lit("")), "\x01\x02", "\x03\x03")
    found = docs.select("doc_id", text.alias("t"))

    def row(kind: str):
        def of(s: Column) -> Column:
            v = [x.cast("int").alias(f"v{i}") for i, x in enumerate(votes(kind, s), 1)]
            f = [x.cast("int").alias(f"f{i}") for i, x in enumerate(features(kind, s), 1)]
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *v, *f)

        return of

    def every(of: dict[str, Column]) -> Column:
        return F.concat(*(F.transform(c, row(k)) for k, c in of.items()))

    found = found.select("doc_id", every(base_spans(F.col("t"))).alias("base"), every(more_spans(F.col("t"))).alias("more"))
    # both are in the order of start within a kind; a candidate meets what lies within its own span only
    taken = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    clear = F.when(F.size("more") == 0, F.col("more")).otherwise(F.filter("more", lambda m: ~F.exists(taken, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))
    return found.select("doc_id", "base", clear.alias("more"))


Votes = tuple[int, int, int]


def reliabilities(counts: dict[Votes, int], rounds: int = 50) -> dict[Votes, float]:
    """Posterior of each vote pattern of one kind by expectation-maximisation.

    For each labeler: how often it says yes when the candidate is right (a) and
    when it is not (b), of the times it votes; both begin from, and are drawn
    to, what a fair labeler does (4 of 5 and 1 of 5, as if seen in 5 votes), and
    a stays above b, so every yes raises a posterior and every no lowers it.
    """
    post = {v: (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v in counts}
    for _ in range(rounds):
        right, all_ = sum(n * post[v] for v, n in counts.items()), sum(counts.values())
        prior = (right + 2) / (all_ + 4)
        a, b = [], []
        for i in range(3):
            yes = [1.0, 4.0]
            total = [5.0, 5.0]
            for v, n in counts.items():
                if v[i]:
                    for y, share in ((0, 1 - post[v]), (1, post[v])):
                        yes[y] += n * share * (v[i] > 0)
                        total[y] += n * share
            b.append(yes[0] / total[0])
            a.append(yes[1] / total[1])
            if a[i] < b[i] + 0.05:
                middle = min(0.95, max(0.05, (a[i] + b[i]) / 2))
                a[i], b[i] = middle + 0.025, middle - 0.025
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(a[i] / b[i]) if x > 0 else math.log((1 - a[i]) / (1 - b[i])) for i, x in enumerate(v) if x)
            post[v] = 1 / (1 + math.exp(-odds))
    return post


def span_vector(kind: int, marks: tuple[int, ...]) -> list[float]:
    """What the classifier sees: the kind, and the features for each kind apart."""
    x = [float(k == kind) for k in range(len(KINDS))]
    return x + [float(m) if k == kind else 0.0 for k in range(len(KINDS)) for m in marks]


def classifier(rows: list[tuple[int, tuple[int, ...], float, int]], rounds: int = 30, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic curve over ``span_vector``, fitted to posteriors:
    ``rows`` of (kind, features, posterior, count). Newton's method, shrunk."""
    width = len(KINDS) * (1 + len(FEATURES))
    w = np.zeros(width)
    if not rows:
        return w
    x = np.array([span_vector(k, f) for k, f, _, _ in rows])
    y, n = np.array([r[2] for r in rows]), np.array([float(r[3]) for r in rows])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(width), x.T @ (n * (y - p)) - ridge * w)
        w = w + np.clip(step, -4, 4)
    return w


def joined(found: Column) -> Column:
    """kind:start:end by kind, then start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    rows = F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(rows, ",")


def trained(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier from the candidates of ``proposals``."""
    names = ["kind", *(f"v{i}" for i in (1, 2, 3)), *(f"f{i}" for i in range(1, len(FEATURES) + 1))]
    each = found.select(F.explode(F.concat("base", "more")).alias("s")).select(*(F.col(f"s.{n}") for n in names))
    rows = each.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    by_kind: dict[int, dict[Votes, int]] = {}
    for r in rows:
        of = by_kind.setdefault(r["kind"], {})
        v = (r["v1"], r["v2"], r["v3"])
        of[v] = of.get(v, 0) + r["n"]
    post = {k: reliabilities(of) for k, of in by_kind.items()}
    return classifier([(r["kind"], tuple(r[f"f{i}"] for i in range(1, len(FEATURES) + 1)), post[r["kind"]][(r["v1"], r["v2"], r["v3"])], r["n"]) for r in rows])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_secret, n_added and n_spans of every row of ``docs``."""
    found = staged(proposals(docs), "spans")
    w = trained(found)
    kinds, wide = len(KINDS), len(FEATURES)

    def accepted(s: Column) -> Column:
        scores = []
        for k in range(kinds):
            own = w[kinds + k * wide : kinds + (k + 1) * wide]
            scores.append(reduce(lambda a, b: a + b, [s[f"f{i + 1}"] * float(x) for i, x in enumerate(own)], F.lit(float(w[k]))))
        return reduce(lambda c, k: c.when(s["kind"] == k, scores[k]), range(1, kinds), F.when(s["kind"] == 0, scores[0])) > 0

    found = found.withColumn("added", F.filter("more", accepted))

    def number(kind: int, column: str = "base") -> Column:
        return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")

    counted = [number(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select(
        "doc_id",
        *counted,
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        number(KINDS.index("secret"), "added").alias("n_secret"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
