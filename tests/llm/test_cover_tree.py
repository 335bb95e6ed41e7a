import math
from collections import defaultdict

import numpy as np
import pytest

from cohortry.llm import cover_tree as cover_tree_module
from cohortry.llm.cover_tree import Levels, cover_tree, dual_links, embedding_links
from cohortry.llm.queries import op4_cover_tree


def brute(rows, cosine=0.93):
    """Rows of (id, vector, label) to (id, links, class) in order."""
    def unit(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            return None
        x = np.array(v, np.float64)
        n = np.sqrt(x @ x)
        return x / n if n > 0 else None

    units = [unit(v) for _, v, _ in rows]
    near = defaultdict(set)
    for i, (_, _, a) in enumerate(rows):
        for j, (_, _, b) in enumerate(rows):
            if i != j and a is not None and a == b and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= cosine:
                near[i].add(j)
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((k, len(near[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def got(df, **kw):
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_links(df, **kw).collect())


def clustered(n, d, seed):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(max(2, n // 12), d))
    x = centers[r.integers(len(centers), size=n)] + r.normal(size=(n, d)) * r.choice([0.02, 0.12, 0.4], size=(n, 1))
    return x.astype(np.float32)


@pytest.mark.parametrize("kw", [{}, {"block": 20}, {"block": 20, "max_pivots": 3}])
def test_matches_brute_force(spark, kw):
    x = clustered(260, 12, 1)
    rows = [(i, [float(v) for v in x[i]], int(i % 7 == 0)) for i in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    assert got(df, **kw) == want and sum(n for _, n, _ in want) > 100


def test_dual_traversal():
    x, y = (clustered(n, 6, s).astype(np.float64) for n, s in ((150, 2), (120, 2)))
    x, y = (a / np.linalg.norm(a, axis=1)[:, None] for a in (x, y))
    for t in (0.5, 0.93, 0.999):
        assert (dual_links(x, y, t) == (x @ y.T >= t)).all()


def test_tree_covers_and_halves():
    x = clustered(400, 3, 3).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    todo = [cover_tree(x)]
    assert todo[0].children
    while todo:
        n = todo.pop()
        assert np.sqrt(((x[n.points] - n.center) ** 2).sum(axis=1)).max() <= n.radius + 1e-12
        if n.children:
            assert sorted(np.concatenate([c.points for c in n.children])) == sorted(n.points)
            assert max(c.radius for c in n.children) <= n.radius
        todo += n.children


def test_upper_levels_lose_no_pair_of_cells():
    """Walks against all pairs of cells; with clusters most pairs are never looked at."""
    x = clustered(600, 8, 5).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    radii = np.abs(np.random.default_rng(6).normal(size=600)) * 0.1
    tree, reach = Levels(x, radii), math.sqrt(2 - 2 * 0.93)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = d <= radii[:, None] + radii[None] + reach
    for i in range(600):
        assert tree.near(i, reach).tolist() == [j for j in np.flatnonzero(want[i]) if j != i]


def test_null_ids_link(spark):
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (5, [0.0, 1.0], 1), (None, [0.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_links(df).collect()), key=repr)
    assert got == sorted([(None, 1, 4), (4, 1, 4), (5, 0, 5), (None, 0, None)], key=repr)


def test_many_pivots_on_a_small_driver():
    """4,096 pivots: the levels take a few MB, and pairs are made one cell at a time."""
    import tracemalloc

    x = np.random.default_rng(7).normal(size=(4096, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    tree = Levels(x, np.full(4096, 0.3))
    found = [len(tree.near(i, 0.38)) for i in range(0, 4096, 64)]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and len(found) == 64
    tracemalloc.stop()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.001], 2), (12, [1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, n_links string, p string")
    assert got(df) == brute(rows)
    assert embedding_links(df.limit(0)).count() == 0
    assert {r["kept"] for r in embedding_links(df).where("vec_id in (1, 3, 9)").collect()} == {True}


def test_copies_are_one_point(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(500)] + [(1000, [1.0, 2.01], 0), (1001, [-1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    r = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embedding_links(df, block=50).collect()}
    assert r[3] == (500, 0) and r[1000] == (500, 0) and r[1001] == (0, 1001)


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in op4_cover_tree(spark, sf).collect()) == brute(rows)


def test_points_of_tight_clusters_are_sent_once_or_twice(spark, monkeypatch):
    """Few cells of many clusters that no bound of cells can part: centers decide, and points stay in their block but for cut clusters."""
    r = np.random.default_rng(9)
    c = r.normal(size=(500, 24))
    x = c[np.arange(2000) % 500] + 0.002 * r.normal(size=(2000, 24))
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    sent, plain = [], cover_tree_module._near_points
    monkeypatch.setattr(cover_tree_module, "_near_points", lambda *a: sent.append(plain(*a)) or sent[-1])
    assert got(df, block=50, max_pivots=3) == brute(rows)
    assert sent[0].count() < 1.5 * 2000 and sent[0].select("x").distinct().count() >= 10
