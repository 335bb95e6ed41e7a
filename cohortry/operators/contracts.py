"""Checks that tables keep their promises, and joins that rely on them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug


class ContractError(ValueError):
    """A table lacks what an operator needs."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str | list[str]) -> DataFrame:
    if some := duplicate_keys(df, key).limit(5).collect():
        raise ContractError(f"key {key} is not unique: {[tuple(r) for r in some]}")
    return df


def require_labels(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """All labels, nulls too, must be among ``allowed``."""
    odd = df.where(F.col(column).isNull() | ~F.col(column).isin(allowed)).select(column).distinct().limit(20).collect()
    if odd:
        raise ContractError(f"unknown labels in {column}: {sorted(str(r[0]) for r in odd)}")
    return df


def require_complete(df: DataFrame, column: str) -> DataFrame:
    if not df.where(F.col(column).isNull()).isEmpty():
        raise ContractError(f"{column} has nulls")
    return df


def missing_values(wanted: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """Values of ``wanted`` that ``present`` has not."""
    return wanted.select(column).distinct().join(present.select(column), column, "left_anti")


def one_to_one_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", check: bool = True) -> DataFrame:
    """Equi-join that fails unless both sides have unique keys."""
    if check:
        require_unique(left, key), require_unique(right, key)
    return left.join(right, key, how)


def prefixed(right: DataFrame, taken: list[str], key: str, prefix: str) -> DataFrame:
    """Columns of ``right`` that are ``taken`` already, renamed ``prefix__column``."""
    clash = {c: f"{slug(prefix)}__{slug(c)}" for c in right.columns if c in taken and c != key}
    return right.withColumnsRenamed(clash)


def fold_join(tables: dict[str, DataFrame], key: str, check: bool = True) -> DataFrame:
    """Inner join of all tables that have the key, in order; clashing columns get the table's name in front."""
    own = [(n, t) for n, t in tables.items() if key in t.columns]
    if not own:
        raise ContractError(f"no table has {key}")
    return reduce(lambda a, nt: one_to_one_join(a, prefixed(nt[1], a.columns, key, nt[0]), key, check=check), own[1:], own[0][1])


def id_columns(df: DataFrame) -> list[str]:
    """Columns whose name looks like that of an identifier."""
    return [c for c in df.columns if re.search(r"(^id$|_id$|encounter|patient)", c.lower())]


#: Names that tell the outcome; fixed values.
LEAKAGE = (
    "disposition", "clinical_course", "structured_mdm", "ed_meds_procedures", r"ed_course\.interventions", "ed_course_reassessment_4h", r"ed_course\.reassessment_4h",
    "intubat", "positive_pressure", r"\bcvc\b",
)


def leaking_columns(columns: list[str], patterns: tuple[str, ...] = LEAKAGE, keep: tuple[str, ...] = ()) -> list[str]:
    return sorted(c for c in columns if c not in keep and any(re.search(p, c.lower()) for p in patterns))


def only_columns(df: DataFrame, key: str, allowed: list[str], patterns: tuple[str, ...] = LEAKAGE) -> DataFrame:
    """The key and ``allowed`` columns, all of which must be there; fails should one of them look like leakage."""
    require_columns(df, [key, *allowed])
    out = df.select(key, *[F.col(f"`{c}`") for c in allowed if c != key])
    if left := leaking_columns(out.columns, patterns, (key,)):
        raise ContractError(f"leaking columns remain: {left}")
    return out


def first_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of each key the first in ``order``, which should tell all rows apart."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def capped(df: DataFrame, rows: int | None, *order: str) -> DataFrame:
    """The first ``rows`` rows in ``order``; all without a number. The number must be above 0."""
    if rows is None:
        return df
    if rows <= 0:
        raise ContractError(f"the number of rows must be above 0, not {rows}")
    return df.orderBy(*order).limit(rows)


def without_leakage(df: DataFrame, patterns: tuple[str, ...] = LEAKAGE, prefixes: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the columns that patterns or prefixes name; fails should any remain."""
    out = df.drop(*[c for c in df.columns if c not in keep and (c in leaking_columns([c], patterns) or c.startswith(prefixes or "\0"))])
    if left := leaking_columns(out.columns, patterns, keep):
        raise ContractError(f"leaking columns remain: {left}")
    return out
