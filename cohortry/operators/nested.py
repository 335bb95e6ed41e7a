"""Nested event lists in text cells: parsing, profiling, and one row of features a record."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metric import scratch

#: One dict of scalars, as text by key; values are read as numbers where they are some.
ITEMS = "array<map<string,string>>"
_ITEMS_TYPE = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


def json_form(cell: Column) -> Column:
    """A Python-literal cell as JSON: None, True and False outside of quotes become JSON's words."""
    out = cell
    for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
        # outside of quotes: such a word follows a colon, a comma or a bracket
        out = F.regexp_replace(out, rf"(?<=[:,\[\{{])(\s*){a}(?=\s*[,\]\}}])", f"$1{b}")
    return out


def parse_nested(cell: Column, strict: bool = False, schema: str = ITEMS) -> Column:
    """A cell's list of dicts with built-in functions: blank, null and unreadable cells give an empty list, and a single
    dict a list of it (an empty one if ``strict``). Of a list that mixes dicts with other items the dicts stay; if ``strict``,
    other items stay as nulls, so that they count. Cells that are no JSON even after ``json_form`` need ``parse_literals``.
    """
    options = {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}
    text = F.trim(cell)
    text = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    form = json_form(text)
    item = schema.removeprefix("array<").removesuffix(">")
    # items one by one, as text, where the list as a whole does not fit
    mixed = F.transform(F.from_json(form, "array<string>", options), lambda x: F.when(F.ltrim(x).startswith("{"), F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), f"array<{item}>", options), F.lit(0))))
    parsed = F.coalesce(F.from_json(form, schema, options), mixed, F.array().cast(schema))
    lone = F.trim(cell).startswith("{")
    kept = parsed if strict else F.filter(parsed, lambda x: x.isNotNull())
    return F.when(text.startswith("[") & ~(F.lit(strict) & lone), kept).otherwise(F.array().cast(schema))


def _literal(text: str | None, strict: bool):
    if text is None or not text.strip():
        return []
    got = None
    for t in (text,) if strict else (text, re.sub(r"\bnull\b", "None", text)):
        try:
            got = ast.literal_eval(t.strip())
            break
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
    if isinstance(got, dict):
        return [] if strict else [got]
    if not isinstance(got, list):
        return []
    return [x if isinstance(x, dict) else None for x in got if strict or isinstance(x, dict)]


@F.pandas_udf(_ITEMS_TYPE)
def _lenient(cells: pd.Series) -> pd.Series:
    return cells.map(lambda t: [{str(k): None if v is None else str(v) for k, v in d.items()} for d in _literal(t, False)])


@F.pandas_udf(_ITEMS_TYPE)
def _strict(cells: pd.Series) -> pd.Series:
    return cells.map(lambda t: [None if d is None else {str(k): None if v is None else str(v) for k, v in d.items()} for d in _literal(t, True)])


def parse_literals(cell: Column, strict: bool = False) -> Column:
    """The same by Python's own reading of literals, in Arrow batches: for cells that JSON's rules do not cover."""
    return (_strict if strict else _lenient)(cell)


def discover_nested(df: DataFrame, preferred: tuple[str, ...] = (), share: float = 0.6) -> list[str]:
    """String columns that look nested: ``preferred`` ones, then those whose non-null cells mostly start with a bracket. One aggregate over all
    rows and columns."""
    found = [c for c in preferred if c in df.columns]
    rest = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in found]
    if rest:
        row = df.agg(*[F.avg(F.trim(F.col(f"`{c}`")).startswith("[").cast("double")).alias(f"s{i}") for i, c in enumerate(rest)]).first()
        found += [c for c, p in zip(rest, row) if p is not None and p >= share]
    return found


def variant_list(cell: Column) -> Column:
    """A cell's list as a VARIANT, a single dict as a list of it; null for cells that are blank or no list of JSON even after ``json_form``."""
    text = F.trim(cell)
    text = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).when(text.startswith("["), text)
    return F.from_json(json_form(text), "variant", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})


def nested_profile(df: DataFrame, columns: list[str], top: int = 8, skip: tuple[str, ...] = ("encounter_id", "minute")) -> DataFrame:
    """(column, key, n_numeric, n_other, types, values): what the dicts of nested columns hold, all columns in one scan.

    Numbers and truth values count as numeric, all else, nulls too, as other. ``types`` are the kinds of values that are there, in order; ``values`` the ``top`` most frequent
    texts among the others, of equal ones the first. Items that are no dicts are passed over; keys of ``skip`` are left out.
    """
    spark = df.sparkSession
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns])))
    lists = cells.select("column", variant_list(F.col("cell")).alias("list")).where(F.schema_of_variant("list").startswith("ARRAY"))
    items = lists.lateralJoin(spark.tvf.variant_explode(F.col("list").outer())).select("column", F.col("value").alias("item")).where(F.schema_of_variant("item").startswith("OBJECT"))
    pairs = items.lateralJoin(spark.tvf.variant_explode(F.col("item").outer())).select("column", "key", F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("type"), F.col("value").cast("string").alias("text"))
    numeric = F.col("type").isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "BOOLEAN")
    # a row a distinct value: partial counts go through the shuffle
    text = F.when(~numeric & (F.trim("text") != ""), F.trim("text"))
    counts = scratch(pairs.where(~F.col("key").isin(*skip) if skip else F.lit(True)).groupBy("column", "key", "type", text.alias("text")).agg(F.count("*").alias("n")), "values")
    own = counts.groupBy("column", "key").agg(F.sum(F.when(numeric, F.col("n")).otherwise(0)).alias("n_numeric"), F.sum(F.when(numeric, 0).otherwise(F.col("n"))).alias("n_other"), F.collect_set("type").alias("t"))
    # the limit is on the rank alone, so that each task sends ``top`` texts of a key at most
    texts = counts.where("text is not null").groupBy("column", "key", "text").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("column", "key").orderBy(F.desc("n"), "text"))
    first = texts.withColumn("r", place).where(F.col("r") <= top).groupBy("column", "key").agg(F.collect_list(F.struct("r", F.col("text").alias("s"))).alias("v"))
    own = own.join(first, ["column", "key"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<struct<r:int,s:string>>")))
    return own.select("column", "key", "n_numeric", "n_other", F.array_sort("t").alias("types"), F.transform(F.array_sort("v"), lambda x: x["s"]).alias("values"))


def length_histogram(df: DataFrame, items: str) -> DataFrame:
    return df.groupBy(F.size(items).alias("length")).agg(F.count("*").alias("count"))


def event_counts(df: DataFrame, items: str, key: str = "event_name") -> DataFrame:
    """How often each non-empty value of ``key`` stands in the lists, the most frequent first."""
    events = df.select(F.explode(items).alias("e")).select(F.nullif(F.col("e")[key].cast("string"), F.lit("")).alias(key))
    return events.dropna().groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key)


def key_types(df: DataFrame, items: str, skip: tuple[str, ...] = ("encounter_id", "minute")) -> DataFrame:
    """For each key of the items: whether any value is a number (booleans count), and whether any is not. Both may hold."""
    pairs = df.select(F.explode(items).alias("e")).select(F.explode("e").alias("key", "value")).where(~F.col("key").isin(*skip))
    number = F.expr("try_cast(value as double) is not null and not isnan(try_cast(value as double)) or value in ('True', 'False', 'true', 'false')")
    return pairs.groupBy("key").agg(F.bool_or(F.coalesce(number, F.lit(False))).alias("is_numeric"), F.bool_or(~F.coalesce(number, F.lit(False))).alias("is_categorical"))


def top_categories(pairs: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values of each key; of equal ones the first in order."""
    counts = pairs.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def _stats(own: Column, mean: Column, full: bool) -> dict[str, Column]:
    """Of an array of numbers in list order, with its mean: population deviation, extremes, first, last, and their difference."""
    n = F.size(own)
    last, first = F.get(own, n - 1), F.get(own, F.lit(0))
    out = {"mean": mean, "min": F.array_min(own), "max": F.array_max(own), "last": last, "delta": last - first}
    if full:
        squares = F.aggregate(own, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
        out |= {"std": F.when(n > 0, F.sqrt(squares / n)), "first": first}
    return out


def summarize_nested(
    df: DataFrame, key: str, items: str, prefix: str, numeric: list[str], categorical: dict[str, list[str]], full: bool = True
) -> DataFrame:
    """One row of features for each row of ``df``, made inside the row: no explode, no shuffle.

    ``numeric`` and ``categorical`` (with the values to count) come from a discovery pass; column order is fixed by
    name. The full form has deviation and first values and the number of non-null values, the reduced one has not.
    """
    as_number = lambda e, k: F.when(e[k].isin("True", "true"), 1.0).when(e[k].isin("False", "false"), 0.0).otherwise(e[k].try_cast("double"))
    # arrays and then their means are columns of their own, so that no lambda works them out again for each element
    names = {k: f"__a{i}" for i, k in enumerate(dict.fromkeys(["minute", *numeric]))}
    arrays = {c: F.filter(F.transform(items, lambda e: as_number(e, k)), lambda x: x.isNotNull() & ~F.isnan(x)) for k, c in names.items()}  # noqa: B023
    means = {f"{c}m": F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)) for c in names.values()}
    df = df.withColumns(arrays).withColumns(means)
    stats = lambda k, full: _stats(F.col(names[k]), F.col(f"{names[k]}m"), full)
    cols: dict[str, Column] = {"n_events": F.size(items).cast("double")}
    minute = stats("minute", True)
    cols |= {"minute_min": minute["min"], "minute_max": minute["max"], "minute_span": minute["max"] - minute["min"]}
    if full:
        cols |= {"minute_mean": minute["mean"], "minute_std": minute["std"]}
    for k in numeric:
        cols |= {f"{k}_{n}": c for n, c in stats(k, full).items()}
    for k, values in categorical.items():
        own = F.filter(F.transform(items, lambda e: e[k]), lambda x: x.isNotNull())
        cols[f"{k}_nunique"] = F.size(F.array_distinct(own)).cast("double")
        if full:
            cols[f"{k}_non_null"] = F.size(own).cast("double")
        for v in values:
            cols[f"{k}_count_{v}"] = F.size(F.filter(own, lambda x: x == v)).cast("double")
    return df.select(key, *[cols[n].alias(f"{prefix}__{n}") for n in sorted(cols)])


def merge_summaries(base: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Left joins of summaries, each with unique keys, to a table of records."""
    for p in parts:
        base = base.join(p, key, "left")
    return base
