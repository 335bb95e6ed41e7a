"""Running sums and exact quantiles over distributed values, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metric import scratch


def running_sums(df: DataFrame, order: str, values: dict[str, str], descending: bool = False, inclusive: bool = True, buckets: int = 16, by: str | None = None, totals_too: bool = False) -> DataFrame:
    """Adds, for each name, the sum of the column it names over all rows up to this one in the order (which is unique).

    Rows are dealt into ranges by approximate quantiles; a range is summed by a window of its own, and ranges before it
    add a total each, so that no task sorts all rows. With ``by`` each of its values has sums and ranges of its own, in
    the same pass; its values are few. With ``totals_too`` each name has a column ``name_total`` of the sum over all rows.
    The input is written once, as bounds, totals and sums read it each.
    """
    keyed = scratch(df.withColumn("__g", F.col(by) if by else F.lit(0)), "sums")
    bounds = keyed.groupBy(F.col("__g").alias("__by")).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000).alias("__bounds"), *[F.sum(c).alias(f"{n}_total") for n, c in values.items() if totals_too])
    # one row a value of ``by``, with a fixed number of bounds
    cut = keyed.join(F.broadcast(bounds), F.col("__g").eqNullSafe(F.col("__by")))
    bucket = F.size(F.filter("__bounds", lambda b: b < F.col(order)))
    cut = cut.withColumn("__b", -bucket if descending else bucket).drop("__by", "__bounds")
    totals = cut.groupBy(F.col("__g").alias("__by"), F.col("__b").alias("__q")).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in values.items()])
    before = Window.partitionBy("__by").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    totals = totals.select("__by", "__q", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__{n}") for n in values])
    inside = Window.partitionBy("__g", "__b").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in values.items()])
    joined = own.join(F.broadcast(totals), F.col("__g").eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__q")))
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in values}).drop("__g", "__b", "__by", "__q", *[f"__{n}" for n in values])


def quantiles(df: DataFrame, columns: list[str], shares: list[float], exclusive: bool = False) -> DataFrame:
    """(ordinal, n, q): of each column, by its place in ``columns``, the non-null and non-NaN values and their exact quantiles,
    linear between neighbours; all columns in one pass. A share q lies at place q (n - 1) from 0, or at q (n + 1) - 1 if ``exclusive``, where
    shares beyond the outermost places go on along the line through the last two values.

    Distinct values are counted by column, with partial counts, and counts are summed up by ranges. A column without
    values has no row.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(parts)).where("x is not null and not isnan(x)").groupBy("ordinal", "x").agg(F.count("*").alias("k"))
    run = running_sums(counts, "x", {"until": "k"}, by="ordinal", totals_too=True).withColumnRenamed("until_total", "n")
    at = [F.lit(float(q)) * (F.col("n") + 1) - 1 if exclusive else F.lit(float(q)) * (F.col("n") - 1) for q in shares]
    low = [F.greatest(F.lit(0), F.least(F.floor(h), F.col("n") - 2)) if exclusive else F.floor(h) for h in at]
    high = [F.least(x + 1, F.col("n") - 1) if exclusive else F.ceil(h) for x, h in zip(low, at)]
    ends = [F.min(F.when(F.col("until") > p, F.col("x"))).alias(f"{k}{i}") for i, both in enumerate(zip(low, high)) for k, p in zip("ab", both)]
    found = run.groupBy("ordinal", "n").agg(*ends)
    between = [F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (h - x) for i, (h, x) in enumerate(zip(at, low))]
    # equal neighbours, infinite ones too, need no interpolation
    return found.select("ordinal", "n", F.array(*[F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}")).otherwise(x) for i, x in enumerate(between)]).alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """The same as numbers for each column that has any value."""
    return {columns[r["ordinal"]]: list(r["q"]) for r in quantiles(df, columns, shares).collect()}
