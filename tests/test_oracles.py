"""Every query that has SQL, against DuckDB over the same tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, wanted = _rows(df.collect(), df.columns), _rows(want.fetchall(), want.columns)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-6)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_no_data_in_repository():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert not glob.glob(f"{root}/**/*.parquet", recursive=True)
