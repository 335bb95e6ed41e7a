"""Column expressions over text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(c: Column) -> Column:
    """Trimmed and lower-cased, every run of other characters than a-z and 0-9 an underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def slug(name: str) -> str:
    """``slugify`` for a column's name."""
    import re

    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def normalize_ws(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def labelled_text(parts: list[tuple[str, Column]]) -> Column:
    """"[name] text" of each part in order, joined by spaces, white space collapsed; null as empty."""
    return normalize_ws(F.concat_ws(" ", *[F.concat(F.lit(f"[{n}] "), F.coalesce(c.cast("string"), F.lit(""))) for n, c in parts]))


def plain_text(parts: list[Column]) -> Column:
    return normalize_ws(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in parts]))


def term_hits(c: Column, terms: list[str]) -> Column:
    """How many of ``terms`` the lower-cased text holds; each counts once."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("double") for t in terms], F.lit(0.0))


def matches(c: Column, pattern: str) -> Column:
    """1.0 where the text matches; a null text does not."""
    return F.coalesce(c, F.lit("")).rlike(pattern).cast("double")


def priority_class(c: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The name of the first rule (name, pattern) that matches the lower-cased text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(n)) for n, p in rules], F.lit(otherwise))


def rounded_text(c: Column, digits: int = 0) -> Column:
    """Rounded half to even and written out; null as NA."""
    value = F.bround(c, digits)
    text = value.cast("long").cast("string") if digits == 0 else F.format_string(f"%.{digits}f", value)
    return F.when(c.isNull() | F.isnan(c.cast("double")), "NA").otherwise(text)


def duration_text(seconds: Column) -> Column:
    """Minutes, and hours in brackets."""
    return F.format_string("%.1f min (%.2f hr)", seconds / 60.0, seconds / 3600.0)
