"""Array files by byte ranges, and answers asked for once."""

import glob
import json
import os

import numpy as np
import pytest

from cohortry.operators.extract import rule_client
from cohortry.sources import answers, arrays


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f8", "<i4", "<i8"])
def test_array_files(spark, tmp_path, kind):
    x = (np.random.default_rng(1).normal(size=(5000, 7)) * 100).astype(kind)
    path = str(tmp_path / "x.npy")
    np.save(path, x)
    df = arrays.read_array(spark, path, partition_bytes=30_000, batch_bytes=4000)
    rows = sorted(df.collect())
    assert [r["row"] for r in rows] == list(range(5000)) and np.allclose([r["v"] for r in rows], x)
    assert df.rdd.getNumPartitions() >= 5
    assert arrays.read_array(spark, f"file://{path}").count() == 5000


def test_members_of_archives(spark, tmp_path):
    a, b = np.arange(3000, dtype=np.int64), np.arange(12, dtype=np.float32).reshape(4, 3)
    stored, packed = str(tmp_path / "s.npz"), str(tmp_path / "c.npz")
    np.savez(stored, a=a, b=b), np.savez_compressed(packed, a=a, b=b)
    for path, parts in ((stored, 3), (packed, 1)):
        df = arrays.read_array(spark, path, "a", partition_bytes=8000, batch_bytes=1000)
        assert sorted(r["v"] for r in df.collect()) == a.tolist() and df.rdd.getNumPartitions() == parts
        assert [list(r["v"]) for r in sorted(arrays.read_array(spark, path, "b").collect())] == b.tolist()


def test_odd_arrays(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert arrays.read_array(spark, str(tmp_path / "none.npy")).count() == 0
    for bad in (np.zeros((2, 2, 2)), np.array(["x"]), np.asfortranarray(np.zeros((3, 2)))):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(Exception, match="type|ranges"):
            arrays.read_array(spark, str(tmp_path / "bad.npy")).count()


def client(calls, broken):
    def ask(prompt):
        with open(os.path.join(calls, f"{abs(hash(prompt))}-{os.urandom(8).hex()}"), "w") as f:
            f.write(prompt)
        if prompt == "bad":
            raise ValueError("no")
        if prompt == "die" and not os.path.exists(broken):
            open(broken, "w").close()
            os._exit(1)  # the worker is lost in the middle of its task
        return rule_client(prompt)

    return ask


def asked(calls):
    return sorted(open(f).read() for f in glob.glob(f"{calls}/*"))


def test_answers_are_asked_for_once(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    rows = [(1, "severe seizure"), (2, "severe seizure"), (3, "bad"), (4, None), (5, "mild nausea")]
    df = spark.createDataFrame(rows, "k long, p string")
    run = lambda d: {r["k"]: r for r in answers.extract_once(d, "k", "p", client(str(calls), "x"), log, buckets=3, pause=0.0).collect()}
    got = run(df)
    assert asked(calls) == ["bad", "mild nausea", "severe seizure"]
    assert got[1]["response"] == got[2]["response"] == rule_client("severe seizure") and got[3]["response"] is None and got[3]["error"] == "no"
    assert got[4]["response"] is None and got[4]["error"] is None and json.loads(got[5]["response"])
    again = run(df.union(spark.createDataFrame([(6, "headache")], "k long, p string")))
    assert asked(calls) == ["bad", "bad", "headache", "mild nausea", "severe seizure"] and again[1]["response"] == got[1]["response"]
    assert len(glob.glob(f"{log}/bucket=*/*.jsonl")) <= 3 and not glob.glob(f"{log}/bucket=*/*.tmp")


def test_a_lost_task_keeps_its_answers(spark, tmp_path):
    """The worker dies after some answers; the next run asks for what is left alone."""
    calls, log, broken = tmp_path / "calls", str(tmp_path / "log"), str(tmp_path / "broken")
    calls.mkdir()
    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)] + [(9, "die")], "k long, p string").coalesce(1)
    ask = client(str(calls), broken)
    with pytest.raises(Exception):  # noqa: B017  one process alone tries a task once
        answers.extract_once(df, "k", "p", ask, log, buckets=1, pause=0.0)
    before = asked(calls)
    got = answers.extract_once(df, "k", "p", ask, log, buckets=1, pause=0.0)
    assert got.where("response is null").count() == 0
    assert sorted(asked(calls)) == sorted([*before, *({f"p{i}" for i in range(6)} - set(before)), "die"])
