"""Monte-Carlo time of calls that may fail and be tried again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metric import scratch
from .quantiles import quantiles


def call_seconds(uniforms: list[Column], seconds: float, error_rate: float, pause: float = 1.25) -> Column:
    """Of one call with as many attempts as uniforms: each costs ``seconds``, and a failed one a pause before the next."""
    total, open_ = F.lit(0.0), F.lit(True)
    for n, u in enumerate(uniforms):
        total = total + F.when(open_, seconds).otherwise(0.0)
        open_ = open_ & (u < error_rate)
        if n + 1 < len(uniforms):
            total = total + F.when(open_, pause * (n + 1)).otherwise(0.0)
    return total


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from md5 of the parts: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def simulate(spark: SparkSession, rows: int, trials: int = 200, seconds: float = 3.0, error_rate: float = 0.03, attempts: int = 4, seed: int = 42) -> DataFrame:
    """(trial, total_seconds), by random numbers of Spark's generator."""
    calls = spark.range(rows * trials).select((F.col("id") / rows).cast("long").alias("trial"), *[F.rand(seed + i).alias(f"u{i}") for i in range(attempts)])
    return calls.groupBy("trial").agg(F.sum(call_seconds([F.col(f"u{i}") for i in range(attempts)], seconds, error_rate)).alias("total_seconds"))


def time_summary(df: DataFrame, seconds: str) -> DataFrame:
    """Mean and exclusive quantiles, from counts of distinct values by ranges: no task holds all trials."""
    shares = (50, 90, 95, 99)
    held = scratch(df.select(F.col(seconds).cast("double").alias("s")), "trials")
    found = quantiles(held, ["s"], [q / 100 for q in shares], exclusive=True).select(*[F.col("q")[i].alias(f"p{q}") for i, q in enumerate(shares)])
    return held.agg(F.avg("s").alias("mean")).join(F.broadcast(found), how="left")  # a row each
