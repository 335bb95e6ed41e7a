"""Profiles of tables: one wide aggregate a table, turned into tall rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers, without booleans."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def _tall(row: DataFrame, names: list[str], fields: list[tuple[str, str]]) -> DataFrame:
    """Of one row with columns i_field: a row for each name."""
    parts = ", ".join(f"struct({n!r} as column, {i} as ordinal, " + ", ".join(f"cast(`{i}_{f}` as {t}) as {f}" for f, t in fields) + ")" for i, n in enumerate(names))
    return row.selectExpr(f"inline(array({parts}))")


def missingness(df: DataFrame) -> DataFrame:
    """Nulls of each column and their percentage of the rows; the emptiest first, equal ones in column order."""
    names = df.columns
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"{i}_missing_count") for i, c in enumerate(names)])
    row = row.select("*", *[(100.0 * F.col(f"`{i}_missing_count`") / F.greatest(F.col("n"), F.lit(1))).alias(f"{i}_missing_pct") for i in range(len(names))])
    return _tall(row, names, [("missing_count", "long"), ("missing_pct", "double")]).orderBy(F.desc("missing_pct"), F.desc("missing_count"), "ordinal")


QUANTILES = (("p01", 0.01), ("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99))


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quantiles (exact, linear) and maximum of each numeric column: one aggregate of
    a row, and one pass for the quantiles of all columns, whose distinct values are counted and summed up by ranges.
    """
    names = columns or numeric_columns(df)
    aggs = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"{i}_count"), F.avg(x).alias(f"{i}_mean"), F.stddev_samp(x).alias(f"{i}_std"), F.min(x).alias(f"{i}_min"), F.max(x).alias(f"{i}_max")]
    tall = _tall(df.agg(*aggs), names, [("count", "long"), *[(f, "double") for f in ("mean", "std", "min", "max")]])
    own = quantiles(df, names, [q for _, q in QUANTILES]).select("ordinal", *[F.col("q")[k].alias(n) for k, (n, _) in enumerate(QUANTILES)])
    return tall.join(F.broadcast(own), "ordinal", "left").select("column", "count", "mean", "std", "min", *[n for n, _ in QUANTILES], "max")


def _unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(parts))


def categorical_summary(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """Distinct non-null values, nulls with percentage, and the most frequent values ("k: v", " | " between) by column."""
    names = columns or other_columns(df)
    counts = _unpivoted(df, names).groupBy("column", "value").agg(F.count("*").alias("n"))
    order = (F.desc("n"), "value")
    # the best of parts first, so that no task ranks all values of a column
    parts = counts.where("value is not null").withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64)))
    best = parts.withColumn("r", F.row_number().over(Window.partitionBy("column", "part").orderBy(*order))).where(F.col("r") <= top)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("r") <= top)
    tops = best.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(": ", "value", F.col("n").cast("string")).alias("t")))).alias("l"))
    alls = counts.groupBy("column").agg(F.count("value").alias("n_unique"), F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"))
    out = alls.join(tops, "column", "left")
    return out.select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "missing_count", (100.0 * F.col("missing_count") / F.col("rows")).alias("missing_pct"), F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), " | "), F.lit("")).alias("top_values"))


def value_counts(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows of each value, nulls too."""
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Counts of each value and their percentage of all."""
    counts = value_counts(df, key)
    return counts.join(counts.agg(F.sum("count").alias("total")), how="cross").select(key, "count", (100.0 * F.col("count") / F.col("total")).alias("pct"))


def key_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_name: str, right_name: str) -> DataFrame:
    """Distinct keys of two tables, those in both, and the percentage of either side that they are."""
    a, b = left.select(F.col(left_key).alias("k")).where("k is not null").distinct(), right.select(F.col(right_key).alias("k")).where("k is not null").distinct()
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full")
    n = sides.agg(F.count("l").alias("left_unique"), F.count("r").alias("right_unique"), F.count(F.col("l") * F.col("r")).alias("intersection"))
    pct = lambda c: 100.0 * F.col("intersection") / F.greatest(F.col(c), F.lit(1))
    return n.select(F.lit(left_name).alias("left_table"), F.lit(right_name).alias("right_table"), "left_unique", "right_unique", "intersection", pct("left_unique").alias("left_coverage_pct"), pct("right_unique").alias("right_coverage_pct"))


def pattern_scan(df: DataFrame, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """Rows of which a column's lower-cased text matches, by column and pattern, in one pass."""
    names = [(c, p) for c in columns for p in patterns]
    low = {c: F.lower(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in columns}
    row = df.agg(*[F.count_if(low[c].rlike(patterns[p])).alias(f"n{i}") for i, (c, p) in enumerate(names)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("pattern"), F.col(f"n{i}").alias("count")) for i, (c, p) in enumerate(names)])))


def crosstab_long(df: DataFrame, row: str, column: str, max_cells: int = 10_000_000) -> DataFrame:
    """All pairs of a row's and a column's values with count and row percentage; pairs that never meet count 0.

    Pairs come from the distinct values of both; more than ``max_cells`` pairs are refused. Rows with a null in either are left out.
    """
    size = df.agg(F.count_distinct(row).alias("r"), F.count_distinct(column).alias("c")).first()
    if size["r"] * size["c"] > max_cells:
        raise ValueError(f"{size['r']} x {size['c']} cells are more than {max_cells}")
    own = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    counts = own.groupBy(row, column).agg(F.count("*").alias("n"))
    grid = counts.select(row).distinct().join(counts.select(column).distinct(), how="cross")
    full = grid.join(counts, [row, column], "left").withColumn("count", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(row)
    return full.select(row, column, "count", (100.0 * F.col("count") / F.sum("count").over(w)).alias("row_pct"))
