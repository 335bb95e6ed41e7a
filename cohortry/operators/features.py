"""Feature tables: one-hot columns, dates, imputation, scaling, assembly in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite_or_null
from .quantiles import column_quantiles


def categories(df: DataFrame, column: str, limit: int = 10_000) -> list:
    """Distinct non-null values in order; fails beyond ``limit``, as each becomes a column."""
    got = [r[0] for r in df.select(F.col(f"`{column}`")).where(F.col(f"`{column}`").isNotNull()).distinct().limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"{column} has more than {limit} values")
    return sorted(got)


def one_hot(df: DataFrame, column: str, values: list | None = None, null_column: bool = True) -> list[Column]:
    """``column_value`` as 0.0 or 1.0 for each value, and ``column_nan`` for nulls, whether there are any or not."""
    c = F.col(f"`{column}`")
    out = [c.eqNullSafe(F.lit(v)).cast("double").alias(f"{column}_{v}") for v in (values if values is not None else categories(df, column))]
    return [*out, c.isNull().cast("double").alias(f"{column}_nan")] if null_column else out


def date_parts(c: Column, prefix: str) -> list[Column]:
    """Hour, weekday (Monday 0), month, day and whether it is a weekend; unreadable dates give nulls."""
    t = F.try_to_timestamp(c.cast("string"))
    day = F.weekday(t)
    parts = {"hour": F.hour(t), "dow": day, "month": F.month(t), "day": F.dayofmonth(t), "is_weekend": (day >= 5).cast("int")}
    return [v.cast("long").alias(f"{prefix}_{k}") for k, v in parts.items()]


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of finite values, in one pass; 0.0 for a column without any."""
    finite = df.select(*[finite_or_null(F.col(f"`{c}`")).alias(c) for c in columns])
    return {c: 0.0 for c in columns} | {c: q[0] for c, q in column_quantiles(finite, columns, [0.5]).items()}


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities, NaN and nulls replaced by the column's median, or 0.0."""
    m = medians(df, columns)
    return df.withColumns({c: F.coalesce(finite_or_null(F.col(f"`{c}`")), F.lit(m[c])) for c in columns})


def standardize(df: DataFrame, columns: list[str], fit: DataFrame | None = None, zero: float = 1.0, least: float = 0.0) -> DataFrame:
    """Less the mean and over the population's deviation of ``fit`` (``df`` itself by default); deviations at or below
    ``least`` count as ``zero``. One aggregate, whose single row is sent to all tasks: rows are not moved.
    """
    stats = (fit if fit is not None else df).agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {}
    for i, c in enumerate(columns):
        m, s = stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 0.0
        out[c] = (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s if s > least else zero)
    return df.withColumns(out)


def assemble(df: DataFrame, key: str, columns: list[str], name: str = "features") -> DataFrame:
    """The columns, in order of name, as an array."""
    return df.select(key, F.array(*[F.col(f"`{c}`").cast("double") for c in sorted(columns)]).alias(name))


def append_arrays(*parts: Column) -> Column:
    return F.concat(*[p.cast("array<double>") for p in parts])


def feature_frame(df: DataFrame, key: str, exclude: tuple[str, ...] = (), dates: tuple[str, ...] = (), max_values: int = 10_000) -> DataFrame:
    """Numbers as they are, booleans as 0 or 1, dates in parts, strings one-hot; medians for what is missing; names in order.

    Columns in ``exclude`` are left out: give labels and duplicate keys here.
    """
    cols: list[Column] = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if f.name == key or f.name in exclude:
            continue
        if f.name in dates:
            cols += date_parts(F.col(f"`{f.name}`"), f.name)
        elif kind == "string":
            cols += one_hot(df, f.name, categories(df, f.name, max_values))
        elif kind == "boolean" or kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            cols.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
    wide = df.select(key, *cols)
    names = [c for c in wide.columns if c != key]
    return impute_median(wide, names).select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in sorted(names)])
