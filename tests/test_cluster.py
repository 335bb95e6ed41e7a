"""Clusterings and singular vectors by sums over the table, against plain and dense versions."""

import numpy as np
import pandas as pd
import pytest

from cohortry.operators import cluster, model


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


def blobs(seed, n=150, dim=2):
    r = np.random.default_rng(seed)
    return 4 * np.random.default_rng(1).normal(size=(3, dim))[np.arange(n) % 3] + r.normal(size=(n, dim))


def test_lloyd_is_a_fixed_point(spark):
    x = blobs(1)
    rows = frame(spark, x)
    got = cluster.lloyd(rows, 3, 13)
    own = ((x[:, None] - got.centers) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(got.centers, [x[own == c].mean(axis=0) for c in range(3)]) and np.isclose(got.cost, ((x - got.centers[own]) ** 2).sum())
    labels = {r["id"]: r["cluster"] for r in got.transform(rows, "v").collect()}
    assert [labels[i] for i in range(len(x))] == own.tolist()
    # starts are rows, all different, the same in any dealing
    first = cluster.seeds_of(rows, 3, 13)
    assert np.array_equal(first, cluster.seeds_of(rows.repartition(7), 3, 13)) and len({tuple(c) for c in first}) == 3


def test_few_and_equal_rows(spark):
    rows = frame(spark, [[1, 1]] * 5 + [[2, 2]])
    got = cluster.lloyd(rows, 4, 1)
    assert len(got.centers) == 2 and got.cost == 0
    assert cluster.lloyd(rows.limit(0), 3, 1).centers.size == 0


def test_mixture_as_a_plain_one(spark):
    x = blobs(2)
    rows = frame(spark, x)
    got = cluster.expectation_maximization(rows, 3, 7, rounds=6, tolerance=0.0)
    start = cluster.lloyd(rows, 3, 7).centers
    share = np.eye(3)[((x[:, None] - start) ** 2).sum(axis=2).argmin(axis=1)]
    for k in range(7):
        n = share.sum(axis=0)
        means = share.T @ x / n[:, None]
        covs = [(share[:, c, None] * (x - means[c])).T @ (x - means[c]) / n[c] + 1e-6 * np.eye(2) for c in range(3)]
        dens = np.stack([n[c] / len(x) * np.exp(-0.5 * np.einsum("nd,de,ne->n", x - means[c], np.linalg.inv(covs[c]), x - means[c])) / np.sqrt(np.linalg.det(covs[c])) for c in range(3)], axis=1)
        share = dens / dens.sum(axis=1, keepdims=True)
    assert np.allclose(got.means, means) and np.allclose(got.covs, covs) and np.isclose(got.weights.sum(), 1)
    labels = {r["id"]: r["cluster"] for r in got.transform(rows, "v").collect()}
    assert [labels[i] for i in range(len(x))] == share.argmax(axis=1).tolist()


@pytest.mark.parametrize("n,width,k", [(200, 60, 10), (30, 40, 40)])
def test_singular_values_as_a_dense_solver(spark, n, width, k):
    r = np.random.default_rng(3)
    dense = np.where(r.random((n, width)) < 0.2, r.random((n, width)), 0) * (1 + np.arange(width)) / width
    rows = spark.createDataFrame([([int(i) for i in np.flatnonzero(d)], [float(v) for v in d[d > 0]]) for d in dense], "i array<int>, x array<double>").repartition(3)
    values, vectors = cluster.right_singular(rows, width, k)
    _, want, vt = np.linalg.svd(dense)
    m = min(k, n)
    assert np.allclose(values[:m], want[:m], rtol=1e-6) and np.allclose(values[m:], 0, atol=1e-5)
    assert np.allclose(np.abs((vectors[:, :5] * vt[:5].T).sum(axis=0)), 1, atol=1e-6)
    assert (vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] > 0).all()


def test_text_embedding(spark):
    texts = ["red apple pie red", "blue sea wave", "red apple pie", "blue sea wave wave", None, "x y", "red sea"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "blue sea")], "k long, t string")
    rows, terms = cluster.term_rows(df.selectExpr("k + 100 * (case when t = 'blue sea' then 1 else 0 end) as id", "t"), "t")
    own = {r["term"]: r for r in terms.collect()}
    assert set(own) == {"red", "apple", "pie", "red apple", "apple pie", "blue", "sea", "wave", "blue sea", "sea wave"} and own["sea"]["df"] == 4
    assert np.isclose(own["sea"]["idf"], np.log(9 / 5) + 1)
    assert all(np.isclose((np.array(r["x"]) ** 2).sum(), 1) for r in rows.collect())
    got = [(r["k"], np.array(r["embedding"])) for r in model.tfidf_svd(df, "k", "t", components=3).collect()]
    assert len(got) == 8 and sorted(k for k, _ in got) == [0, 0, 1, 2, 3, 4, 5, 6]
    e = {k: v for k, v in got if k}
    assert not e[4].any() and not e[5].any() and e[1] @ e[3] > 0.9 and abs(np.linalg.norm(e[6]) - 1) < 1e-9


def test_sparse_rows_in_dense_blocks():
    """Blocks hold each entry at its place, repeated ones added up, and are bounded in size."""
    rows = [([0, 2], [1.0, 2.0]), ([], []), ([1, 1], [3.0, 4.0])]
    f = pd.DataFrame({"i": [np.array(i, np.int32) for i, _ in rows], "x": [np.array(x) for _, x in rows]})
    assert np.concatenate(list(cluster._parts(f, 3))).tolist() == [[1, 0, 2], [0, 0, 0], [0, 7, 0]]
    assert [m.shape for m in cluster._parts(f, 3 << 20)] == [(1, 3 << 20)] * 3
