import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm.mixing import array_sums, mix, rake, scale_for
from cohortry.llm.queries import op6_mixing


def test_raking_meets_its_targets():
    cells = [(s, l, None) for s in "ab" for l in "xyz"]
    mass = np.array([5.0, 1, 1, 2, 8, 3])
    out = rake(cells, mass, [{"a": 0.7, "b": 0.3}, {"x": 0.2, "y": 0.5, "z": 0.3}, {None: 1.0}], 60)
    assert abs(out[:3].sum() / out.sum() - 0.7) < 1e-9 and abs(out[[0, 3]].sum() / out.sum() - 0.2) < 1e-9
    # cross ratios are kept: what raking does not need to change stays
    assert abs(out[0] * out[4] / (out[1] * out[3]) - mass[0] * mass[4] / (mass[1] * mass[3])) < 1e-9


def test_scale_meets_the_budget():
    rate, mass = np.array([4.0, 1.0, 0.1]), np.array([10.0, 50.0, 40.0])
    for budget in (1.0, 60.0, 61.5, 99.0):
        s = scale_for(array_sums(rate, mass), budget)
        assert abs((np.minimum(1, s * rate) * mass).sum() - budget) < 1e-9
    assert scale_for(array_sums(rate, mass), 100.5) == scale_for(array_sums(np.zeros(2), np.ones(2)), 1.0) == float("inf")


def test_probabilities_give_the_targets(small):
    targets = {"source": {f"src{i}": 1.0 for i in range(0, 20, 2)}}
    rows = mix(small, targets=targets, keep_share=0.1).collect()
    mass = {}
    for r in rows:
        mass[r["source"]] = mass.get(r["source"], 0) + r["tokens"] * r["probability"]
    even = [mass[f"src{i}"] for i in range(0, 20, 2)]
    assert max(even) < 1.05 * min(even) and all(mass.get(f"src{i}", 0) == 0 for i in range(1, 20, 2))


def test_sample_follows_the_ids(small):
    for r in mix(small).collect():
        u = int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48
        assert r["sampled"] == (u < r["probability"])


def test_cells_as_a_table_give_the_same(small):
    a = {r["doc_id"]: r["probability"] for r in mix(small, rounds=4).collect()}
    b = {r["doc_id"]: r["probability"] for r in mix(small, rounds=4, max_cells=1).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_odd_rows(odd, none):
    got = mix(odd)
    assert got.count() == odd.count() and mix(none).count() == 0
    assert got.where(F.col("probability").isNull() | F.col("sampled").isNull()).count() == 0
    clash = mix(odd.withColumn("topic", F.lit("mine")).withColumn("tokens", F.lit("t")))
    assert clash.count() == odd.count() and dict(clash.dtypes)["tokens"] == "bigint"


@pytest.mark.parametrize("targets", [None, {"source": {"a": 1}, "lang": {"en": 0.5, "fr": 0.5}}, {"source": {"b": 1.0, None: 2.0}}])
def test_odd_rows_by_both_ways(odd, targets):
    """Values without any mass, and targets that leave out more than the share to keep."""
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["source"] or "", r["lang"] or "")
    a, b = (sorted(mix(odd, targets=targets, rounds=3, max_cells=n).collect(), key=key) for n in (100, 1))
    assert len(a) == len(b) == odd.count()
    for x, y in zip(a, b):
        assert x["doc_id"] == y["doc_id"] and abs(x["probability"] - y["probability"]) < 1e-6 and x["sampled"] == y["sampled"], (x, y)
        if targets and any(not t.get(x[d]) for d, t in targets.items()):
            assert x["probability"] == 0 and not x["sampled"]
    assert any(r["probability"] > 0 for r in a)


def test_rows_without_ids_and_reserved_names(spark):
    rows = [(None, f"text number {i}", "a", "en", i, "x", "y", "z", "w") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, __source int, __lang string, __p string, p string, row string")
    got = mix(df, keep_share=0.5).collect()
    assert 60 < sum(r["sampled"] for r in got) < 140 and sorted(r["__source"] for r in got) == list(range(200)) and {r["row"] for r in got} == {"w"}
    assert [r["sampled"] for r in sorted(mix(df.union(df), keep_share=0.5).collect(), key=lambda r: r["__source"])][::2] == [r["sampled"] for r in sorted(got, key=lambda r: r["__source"])]


def test_query(spark, sf):
    got = op6_mixing(spark, sf)
    assert got.count() == 200 and 0 < got.where("sampled").count() < 200
    share = got.agg(F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens")).first()[0]
    assert share == pytest.approx(0.8, abs=1e-4)
