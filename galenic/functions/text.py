"""Scalar functions over text columns, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galenic.functions.vocab import BLOCKED, MISSING

WHITE = "\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
CODE = "[A-Z][0-9]{2}[A-Z]{2}[0-9]{2}"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` looks at it: functions of arrays look at their arguments anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def present(c: Column) -> Column:
    """Neither missing nor empty nor the text nan."""
    return F.coalesce((c != "") & (c != "nan"), F.lit(False))


def known(c: Column) -> Column:
    """``c`` with every spelling of a missing value as null."""
    return F.when(~c.isin(*MISSING), c)


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def slug(name: Column) -> Column:
    """An identifier: the text before the first comma in lower case, letters, digits and hyphens only."""
    head = F.lower(strip(F.get(F.split(name, ","), F.lit(0))))
    plain = F.regexp_replace(head, f"[^a-zA-Z0-9{WHITE}-]", "")
    return F.btrim(F.regexp_replace(plain, f"[{WHITE}]+", "-"), F.lit("-"))


def split_names(text: Column) -> Column:
    """Names between commas; a comma between two digits belongs to the name."""
    parts = F.split(text, "(?<![0-9]),|,(?![0-9])")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def blocked(name: Column) -> Column:
    return F.lower(name).rlike("|".join(BLOCKED))


def number_like(name: Column) -> Column:
    return name.rlike("^[0-9]+([.][0-9]+)?$")


def clean_name(raw: Column) -> Column:
    """A usable name, or null.

    White space is collapsed and stray separators at the ends go.  Of a name
    with slashes, parts that are blocked or bare numbers go; if none is, the
    spelling stays; if all are, the whole is judged like a plain name.
    """


    def judged(name: Column) -> Column:
        whole = F.when((name != "") & ~blocked(name) & ~number_like(name), name)

        def of(parts: Column) -> Column:
            kept = F.filter(parts, lambda p: ~blocked(p) & ~number_like(p))
            return bound(kept, lambda k: F.when(F.size(k) == 0, whole).when(F.size(k) == F.size(parts), name).otherwise(F.array_join(k, "/")))

        parts = F.filter(F.transform(F.split(name, "/"), strip), lambda p: p != "")
        return F.when(F.contains(name, F.lit("/")), bound(parts, of)).otherwise(whole)

    name = F.btrim(F.regexp_replace(raw, f"[{WHITE}]+", " "), F.lit(" ,;"))
    return F.when(present(raw), bound(name, judged))


def codes(text: Column) -> Column:
    """All classification codes in a text, in order."""
    return F.regexp_extract_all(text, F.lit(CODE), F.lit(0))


def year(text: Column, whole: bool = False) -> Column:
    """The last year named in a text: its century (as catalogues hold it), or the whole year."""
    pattern = r"\b((19|20)[0-9]{2})\b"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if whole else 2))
    return F.try_element_at(found, F.lit(-1)).cast("int")


def humanised(region: Column) -> Column:
    """A readable form of an identifier with underscores."""
    return F.initcap(F.replace(region, F.lit("_"), F.lit(" / ")))


def preview(smiles: Column, chars: int = 50) -> Column:
    return F.when(F.length(smiles) > chars, F.concat(F.left(smiles, F.lit(chars)), F.lit("..."))).otherwise(smiles)


def atoms(smiles: Column) -> Column:
    """A rough count of atoms in a structure string."""
    return F.regexp_count(smiles, F.lit("[A-Z][a-z]?"))
