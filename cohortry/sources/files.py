"""Delimited, JSON and cached tables, and where reports go."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A header and a given schema: nothing is inferred, and no pass over the data is spent on it."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; an empty table still leaves one. ``single`` is for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def require_inputs(spark: SparkSession, *paths: str) -> None:
    """Fails with the names of all inputs that are not there, before any work begins."""
    gone = [p for p in paths if not (at := _path(spark, p))[1].exists(at[0])]
    if gone:
        raise FileNotFoundError(f"missing input: {', '.join(gone)}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text (a report, metadata) to any file system that Spark reads."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_metadata(spark: SparkSession, path: str, **entries) -> dict:
    """Run metadata as JSON: the entries, Spark's version and the session's time zone."""
    own = {**entries, "spark_version": spark.version, "time_zone": spark.conf.get("spark.sql.session.timeZone")}
    write_text(spark, json.dumps(own, indent=2, sort_keys=True, default=str), path)
    return own


def write_matrix(df: DataFrame, path: str) -> None:
    """Rows with array columns, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame | None:
    """A cached table, or None where there is none or its rows (from file footers) are not as many as expected."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    df = spark.read.parquet(path)
    return df if expected_rows is None or df.count() == expected_rows else None


def cached_matrix(spark: SparkSession, path: str, rows: int, make) -> DataFrame:
    """The cached table, made by ``make()`` and written first where it is missing or stale."""
    got = read_matrix(spark, path, rows)
    if got is None:
        write_matrix(make(), path)
        got = spark.read.parquet(path)
    return got


def load_settings(path: str, environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """``KEY=value`` lines of a file, set in the environment where they are not yet; comments and blank lines are passed over."""
    target = os.environ if environ is None else environ
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and not line.startswith("#") and "=" in line:
                    k, v = (x.strip() for x in line.split("=", 1))
                    found[k] = v.strip("\"'")
                    target.setdefault(k, found[k])
    return found
