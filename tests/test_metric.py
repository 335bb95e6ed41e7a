"""Nearest-neighbour joins and Ward's clustering by bounds, against all distances."""

import numpy as np
import pytest

from cohortry.operators import metric, model


def frame(spark, x, key="k"):
    return spark.createDataFrame([(i, None if v is None else [float(y) for y in v]) for i, v in enumerate(x)], f"{key} long, v array<double>")


def clustered(seed, n, dim, centers, spread=0.02):
    c = np.random.default_rng(dim).normal(size=(centers, dim))
    r = np.random.default_rng(seed)
    return c[r.integers(0, centers, n)] + spread * r.normal(size=(n, dim))


def brute_knn(q, f, k):
    return np.sort(np.sqrt(((q[:, None, :] - f[None, :, :]) ** 2).sum(axis=2)), axis=1)[:, :k]


@pytest.mark.parametrize("seed,centers,spread", [(1, 12, 0.02), (2, 1, 1.0), (3, 3, 0.0)])
def test_knn_join(spark, seed, centers, spread):
    """In clusters, without any, and with a third and more of the rows at one point."""
    fit, asked = clustered(seed, 600, 5, centers, spread), clustered(seed + 10, 150, 5, centers, 2 * spread)
    asked[:40] = fit[:40]
    got = {r["k"]: r for r in metric.knn_join(frame(spark, asked), frame(spark, fit), "k", "v", 7, block=20, pivots=40).collect()}
    want = brute_knn(asked, fit, 7)
    assert np.allclose([got[i]["distances"] for i in range(150)], want, atol=1e-12)
    if spread == 0.02:
        copies = np.mean([r["copies"] for r in got.values()])
        assert copies < 6, copies  # of 30 blocks and more


def test_knn_join_odd_rows(spark):
    fit = frame(spark, [[0, 0], [0, 0], [3, 4], None])
    got = {r["k"]: r["distances"] for r in metric.knn_join(frame(spark, [[0, 0], None, [6, 8]]), fit, "k", "v", 9).collect()}
    assert got == {0: [0.0, 0.0, 5.0], 1: None, 2: [5.0, 10.0, 10.0]}
    assert [r["distances"] for r in metric.knn_join(fit, fit.limit(0), "k", "v", 3).collect()] == [None] * 4
    assert metric.knn_join(fit.limit(0), fit, "k", "v", 3).count() == 0


def plain_ward(x, k):
    """Labels after merging, again and again, the two clusters whose union adds the least squared error."""
    n = len(x)
    size, alive = np.ones(n), np.ones(n, bool)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) / 2
    np.fill_diagonal(d, np.inf)
    member = np.arange(n)
    for _ in range(n - k):
        i, j = sorted(divmod(int(d.argmin()), n))
        rest = alive.copy()
        rest[[i, j]] = False
        s = size[rest]
        d[i, rest] = d[rest, i] = ((size[i] + s) * d[i, rest] + (size[j] + s) * d[j, rest] - s * d[i, j]) / (size[i] + size[j] + s)
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        member[member == j] = i
    first = {}
    return [first.setdefault(int(m), len(first)) for m in member]


@pytest.mark.parametrize("seed,n,k,local,spread", [(1, 120, 3, 30, 1.0), (2, 150, 7, 60, 0.1), (3, 60, 5, 2000, 1.0)])
def test_ward(spark, seed, n, k, local, spread):
    x = clustered(seed, n, 3, 9, spread)
    df = frame(spark, x)
    got = {r["k"]: r["cluster"] for r in metric.ward_clusters(df, "k", "v", k, local=local, block=16).collect()}
    assert [got[i] for i in range(n)] == plain_ward(x, k)


def test_ward_with_copies_and_nulls(spark):
    x = [[0, 0]] * 30 + [[1, 0]] * 2 + [[9, 9], [9, 8], None]
    got = {r["k"]: r["cluster"] for r in metric.ward_clusters(frame(spark, x), "k", "v", 2, local=2, block=2).collect()}
    assert [got[i] for i in range(35)] == [0] * 32 + [1, 1, None]
    many = {r["cluster"] for r in metric.ward_clusters(frame(spark, x), "k", "v", 50).collect()}
    assert many == {0, 1, 2, 3, None}
    assert metric.ward_clusters(frame(spark, x).limit(0), "k", "v", 3).count() == 0
    assert {r["cluster"] for r in model.ward(frame(spark, x), "k", "v", 2, local=2).collect()} == {0, 1, None}


def test_merges_of_rounds_are_those_of_one_piece(spark):
    x = clustered(5, 90, 2, 4, 0.5)
    pts = spark.createDataFrame([(i, [float(a) for a in v], 1.0) for i, v in enumerate(x)], "id long, v array<double>, w double")
    one, many = (sorted(round(r["height"], 9) for r in metric.ward_tree(pts, local, 16).collect()) for local in (500, 40))
    assert len(one) == 89 and one == many


def test_roots(spark):
    ways = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(100, 99)], "id long, up long")
    assert {r["id"]: r["root"] for r in metric.roots(ways).collect()} == {**{i: 0 for i in range(1, 40)}, 100: 99}


def test_vectors_without_clusters_meet_in_packs(spark, monkeypatch):
    """Bounds leave out nothing among random directions: rows are sent once a pack, not once a small block."""
    monkeypatch.setattr(metric, "PACK", 60_000)
    monkeypatch.setattr(metric, "TILE", 64)
    x = clustered(4, 1500, 24, 1, 1.0)
    got = {r["k"]: r for r in metric.knn_join(frame(spark, x), frame(spark, x), "k", "v", 5, block=16).collect()}
    assert np.allclose([got[i]["distances"] for i in range(1500)], brute_knn(x, x, 5), atol=1e-12)
    assert {r["copies"] for r in got.values()} == {5}  # of some 94 blocks


def test_smallest_in_tiles(monkeypatch):
    monkeypatch.setattr(metric, "TILE", 7)
    monkeypatch.setattr(metric, "TILE_Q", 5)
    r = np.random.default_rng(6)
    y, times = r.normal(size=(40, 3)), r.integers(1, 4, 40)
    x = np.concatenate([y[:6], r.normal(size=(7, 3))])
    got = metric.smallest(x, y, 9, times)
    assert np.allclose(got, brute_knn(x, np.repeat(y, times, axis=0), 9), atol=1e-12)
    assert np.isinf(metric.smallest(x, y[:2], 3)[:, 2]).all() and np.allclose(metric.smallest(x, y[:2], 3)[:, :2], brute_knn(x, y[:2], 2))


@pytest.mark.parametrize("pack", [0, 2_000])
def test_ward_by_bounds_and_by_packs(spark, monkeypatch, pack):
    """Few clusters take no bounds: the rings are used only above a pack, and give the same merges."""
    seen, plain = [], metric.Fitted
    monkeypatch.setattr(metric, "PACK", pack)
    monkeypatch.setattr(metric, "Fitted", lambda *a, **kw: seen.append(1) or plain(*a, **kw))
    x = clustered(7, 70, 2, 4, 0.3)
    if not pack:
        monkeypatch.setattr(metric, "_packs", lambda rows, width: 9)
    got = {r["k"]: r["cluster"] for r in metric.ward_clusters(frame(spark, x), "k", "v", 4, local=45, block=16).collect()}
    assert [got[i] for i in range(70)] == plain_ward(x, 4) and bool(seen) == (not pack)


def test_rows_sent_by_the_grid():
    """600,000 vectors of 64 numbers are sent some ten times a side, and up to 380,000 no more often than small tables."""
    from cohortry.operators import metric

    assert metric._packs(600_000, 64) <= 10 and metric._packs(380_000, 64) == 6 == metric._packs(50_000, 64)


@pytest.mark.parametrize("piece", [2 << 20, 0])
def test_ward_searches_few_clusters_again(spark, monkeypatch, piece):
    """Costs follow from the choices that are kept, in one task or over tasks: clusters meet others hardly more often than in the first search."""
    asked, plain = [], metric.grid
    monkeypatch.setattr(metric, "grid", lambda q, p, *a, **kw: asked.append(q.count() * p.count()) or plain(q, p, *a, **kw))
    monkeypatch.setattr(metric, "PIECE", piece, raising=False)
    monkeypatch.setattr(metric, "PAIRS", 40, raising=False)
    x = clustered(8, 400, 24, 1, 1.0)
    got = {r["k"]: r["cluster"] for r in metric.ward_clusters(frame(spark, x), "k", "v", 4, local=60).collect()}
    assert [got[i] for i in range(400)] == plain_ward(x, 4)
    assert sum(asked) < 2.2 * 400**2, sum(asked) / 400**2


@pytest.mark.parametrize("scale,offset,weights", [(1.0, 0.0, 1), (1e-4, 100.0, 3), (1.0, 1e6, 9), (1e20, 0.0, 2), (0.0, 1.0, 1)])
def test_cheapest_unions(monkeypatch, scale, offset, weights):
    """Single precision leaves out nothing: far from the origin, of any size, and of rounded vectors with many equal costs."""
    monkeypatch.setattr(metric, "TILE", 300)
    monkeypatch.setattr(metric, "TILE_Q", 50)
    r = np.random.default_rng(3)
    y = offset + scale * r.normal(size=(900, 5)) if scale else np.round(r.normal(size=(900, 5)))
    w, ids = r.integers(1, weights + 1, 900).astype(float), np.sort(r.choice(10**9, 900, replace=False))
    at = r.integers(0, 900, 120)
    q, f, c = metric.cheapest(y[at], w[at], ids[at], y, w, ids, 6, np.full(120, np.inf))
    for i, a in enumerate(at):
        cost = w[a] * w / (w[a] + w) * ((y[a] - y) ** 2).sum(axis=1)
        cost[a] = np.inf
        want = np.lexsort((ids, cost))[:6]
        assert f[q == i].tolist() == want.tolist() and c[q == i].tolist() == cost[want].tolist()


def test_costs_that_follow_from_choices():
    """After merges a choice has the cost that the centers give, and no other cluster costs less than the bound."""
    r = np.random.default_rng(9)
    x, w, ids = r.normal(size=(60, 3)), r.integers(1, 4, 60).astype(float), np.arange(60) * 2 + 1
    full = np.full(60, np.inf)
    q, f, c = metric.cheapest(x, w, ids, x, w, ids, 9, full)
    bound = c.reshape(60, 9)[:, -1]
    on = c < bound[q]
    near = (q[on], ids[f[on]], c[on], w[f[on]])
    for _ in range(4):
        kept, gone, height = metric.mutual(ids, near)
        assert len(kept)
        pairs = metric.merged_pairs(ids[kept], ids[gone], height, w[kept], w[gone])
        x[kept] = (w[kept, None] * x[kept] + w[gone, None] * x[gone]) / (w[kept] + w[gone])[:, None]
        left = np.delete(np.arange(len(ids)), gone)
        ids, w, bound, near = metric.merge_choices(ids, w, bound, near, pairs)
        x = x[left]
        row, other, c, size = near
        cost = w[:, None] * w / (w[:, None] + w) * ((x[:, None] - x) ** 2).sum(axis=2)
        to = np.searchsorted(ids, other)
        assert np.allclose(c, cost[row, to]) and (size == w[to]).all() and (np.diff(row) >= 0).all()
        cost[row, to] = np.inf
        np.fill_diagonal(cost, np.inf)
        assert (cost.min(axis=1) >= bound * (1 - 1e-12)).all()
