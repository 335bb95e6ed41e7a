"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

On the unit sphere a cosine of at least t is a distance of at most sqrt(2 - 2t). Equal vectors are one point with a
multiplicity. Points of large labels fall into cells around pivots, a bounded sample; the upper levels of a label's cover tree are
nested nets over its pivots, with radii that cover the cells' points. Executors walk down these levels for each cell
and let out the pairs of cells that the bounds leave. Cells are split into
blocks of bounded size, and for every pair of blocks left a task builds two cover trees with nested levels of halving
radii and walks down both: node pairs farther apart than their radii and the threshold allow are pruned, pairs of leaves
compared in double precision. A task sends one row per linked point and a spanning forest, not the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written
from .components import components

#: A node of at most so many points is a leaf.
_LEAF = 48


class Node:
    """Points (indices) that lie within ``radius`` of ``center``."""

    __slots__ = ("center", "children", "points", "radius")

    def __init__(self, x: np.ndarray, center: int, points: np.ndarray):
        self.center, self.points = x[center], points
        self.radius = float(np.sqrt(((x[points] - self.center) ** 2).sum(axis=1).max())) if len(points) else 0.0
        self.children: list[Node] = []


def cover_tree(x: np.ndarray) -> Node:
    """Nested nets over unit vectors: a level's centers lie more than its radius apart, and radii halve from level to level.

    A node stays a leaf where halving would give nearly as many children as points, as in space without clusters.
    """
    root = Node(x, 0, np.arange(len(x)))
    todo = [(root, 2.0, 0)]
    while todo:
        node, radius, center = todo.pop()
        if len(node.points) <= _LEAF or node.radius <= 1e-7:
            continue
        while radius / 2 >= node.radius:
            radius /= 2
        radius /= 2
        left, parts = node.points, []
        # nested: the node's own center comes first
        nxt = center
        while len(left):
            near = ((x[left] - x[nxt]) ** 2).sum(axis=1) <= radius * radius
            parts.append((nxt, left[near]))
            left = left[~near]
            if len(parts) > max(2, len(node.points) // 4):
                parts = []
                break
            if len(left):
                nxt = int(left[0])
        for c, points in parts:
            child = Node(x, c, points)
            node.children.append(child)
            todo.append((child, radius, c))
    return root


def dual_links(x: np.ndarray, y: np.ndarray, cosine: float, tx: Node | None = None, ty: Node | None = None) -> np.ndarray:
    """A boolean matrix of the pairs of unit vectors with cosine at least ``cosine``."""
    out = np.zeros((len(x), len(y)), bool)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    todo = [(tx or cover_tree(x), ty or cover_tree(y))]
    while todo:
        a, b = todo.pop()
        if np.sqrt(((a.center - b.center) ** 2).sum()) > a.radius + b.radius + reach:
            continue
        if not a.children and not b.children:
            out[np.ix_(a.points, b.points)] = x[a.points] @ y[b.points].T >= cosine
        elif a.children and (not b.children or a.radius >= b.radius):
            todo += [(c, b) for c in a.children]
        else:
            todo += [(a, c) for c in b.children]
    return out


class Levels:
    """The upper levels over a label's cells: a cover tree of pivots whose nodes know how far the points below them reach."""

    def __init__(self, pivots: np.ndarray, radii: np.ndarray):
        self.pivots, self.radii = pivots, radii
        self.root = cover_tree(pivots)
        todo = [self.root]
        self.far: dict[int, float] = {}
        while todo:
            n = todo.pop()
            self.far[id(n)] = float((np.sqrt(((pivots[n.points] - n.center) ** 2).sum(axis=1)) + radii[n.points]).max())
            todo += n.children

    def near(self, cell: int, reach: float) -> np.ndarray:
        """Cells that may hold a point within ``reach`` of a point of ``cell``, itself left out."""
        x, r = self.pivots[cell], self.radii[cell]
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            if math.sqrt(float(((x - n.center) ** 2).sum())) > r + self.far[id(n)] + reach:
                continue
            if n.children:
                todo += n.children
            else:
                d = np.sqrt(((self.pivots[n.points] - x) ** 2).sum(axis=1))
                out.append(n.points[d <= r + self.radii[n.points] + reach])
        found = np.concatenate(out) if out else np.empty(0, np.int64)
        return np.sort(found[found != cell])


def _forest(m: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the bipartite matrix (columns numbered after rows), or of a symmetric one."""
    n = len(m)
    off = 0 if same else n
    t = m.T
    seen = np.zeros(n + (0 if same else m.shape[1]), bool)
    edges = []
    for start in np.flatnonzero(m.any(axis=1)):
        if seen[start]:
            continue
        seen[start] = True
        todo = [int(start)]
        while todo:
            u = todo.pop()
            row = np.flatnonzero(m[u]) + off if u < n else np.flatnonzero(t[u - n])
            new = row[~seen[row]]
            seen[new] = True
            edges += [(u, int(v)) for v in new]
            todo += new.tolist()
    return edges


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(center's place, distance to it) of each point: centers lie more than ``radius`` apart, and each point is within it of its own."""
    own, far, left = np.full(len(x), -1), np.zeros(len(x)), np.arange(len(x))
    while len(left):
        d = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(axis=1))
        on = d <= radius
        own[left[on]], far[left[on]] = left[0], d[on]
        left = left[~on]
    return own, far


def _near_points(placed: DataFrame, centers: dict[tuple, np.ndarray], reach: float, block: int, kind: str) -> DataFrame:
    """(label, d, x, y, second, p, m, v): the points that each pair of blocks has to compare, ``second`` those of ``y``; pairs of a block with itself have all its points.

    Cells are parted around pivots of their own, and each part has a net of centers, a level of small radius whose members lie close to their center.
    Bounds of whole blocks decide which centers meet, and bounds of centers which points do: a point goes to another block only if a center there may have a partner of its center.
    """
    spark = placed.sparkSession
    group = ["label", "d", "cell"]
    cells = Written(placed.groupBy(*group).agg(F.count("*").alias("n"), F.max("far").alias("r"), F.bool_or("own").alias("own")), "cells").df
    # one row a cell with a pivot, so that their number is that of the pivots at most
    radii = {k: np.full(len(c), -np.inf) for k, c in centers.items()}
    for r in cells.where("own").select("label", "d", "cell", "r").collect():
        radii[(r["label"], r["d"])][r["cell"]] = r["r"]

    def walk(frames):
        levels: dict[tuple, tuple[Levels, np.ndarray]] = {}
        for f in frames:
            for label, d, cell in zip(f["label"], f["d"], f["cell"]):
                k = (label, int(d))
                if k not in levels:
                    # pivots that no point is nearest to cover nothing
                    held = np.flatnonzero(radii[k] > -np.inf)
                    levels[k] = (Levels(centers[k][held], radii[k][held]), held)
                tree, held = levels[k]
                other = held[tree.near(int(np.searchsorted(held, cell)), reach)]
                if len(other):
                    yield pd.DataFrame({"label": [label] * len(other), "d": int(d), "cell": int(cell), "other": other})

    walked = cells.where("own").select(*group).repartition(max(1, sum(map(len, centers.values())) // 64))
    near = walked.mapInPandas(walk, f"label {kind}, d int, cell int, other int").union(cells.select(*group, F.col("cell").alias("other")))

    # pivots of large cells, some 1,024 at most, against parts of the cell
    h = F.pmod(F.xxhash64("k2", "k1"), F.lit(1 << 30))
    large = cells.where(F.col("n") > block).select(*group, "n", F.least(F.lit(1024), F.ceil(2 * F.col("n") / block)).alias("want"), F.ceil(F.col("n") / 16384).alias("times"))
    here = Written(placed.join(large, group, "left"), "here").df
    pivots = here.where(F.col("want").isNotNull() & (h < F.col("want") / F.col("n") * (1 << 30))).select(*group, "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("part"))
    points = here.where("want is not null").select(*group, F.pmod(F.hash("k1", "k2"), F.col("times")).alias("part"), "p", "m", "v")
    flat = f"label {kind}, d int, cell int, p long, m long, v array<double>"

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sub = (_unit(a["v"]) @ _unit(b["v"]).T).argmax(axis=1) if len(a) and len(b) else np.zeros(len(a))
        return a.drop(columns="part").assign(sub=sub.astype(np.int32))[[*group, "p", "m", "v", "sub"]]

    key = [*group, "part"]
    parted = points.groupBy(*key).cogroup(pivots.select(*key, "v").groupBy(*key)).applyInPandas(nearest, f"{flat}, sub int")
    parted = Written(parted.unionByName(here.where("want is null").select(*group, "p", "m", "v", F.lit(0).alias("sub"))), "parted").df
    many = parted.groupBy(*group, "sub").agg(F.ceil(F.count("*") / (2 * block)).alias("salts"))
    salted = parted.join(many, [*group, "sub"]).withColumn("block", F.xxhash64(*group, "sub", F.pmod(F.xxhash64("p"), F.col("salts"))))

    def net(f: pd.DataFrame) -> pd.DataFrame:
        x = _unit(f["v"])
        own, far = _net(x, reach / 4)
        middle = x.mean(axis=0)
        wide = float(np.sqrt(((x - middle) ** 2).sum(axis=1)).max())
        balls = [middle] + [None] * (len(f) - 1)
        rest = [None] * (len(f) - 1)
        return f[[*group, "block", "p", "m", "v"]].assign(c=f["p"].to_numpy()[own], far=far, middle=balls, wide=[wide, *rest], size=pd.array([len(f), *rest], "Int64"))

    netted = Written(salted.select(*group, "block", "p", "m", "v").groupBy(*group, "block").applyInPandas(net, f"label {kind}, d int, cell int, block long, p long, m long, v array<double>, c long, far double, middle array<double>, wide double, size long"), "netted").df
    # blocks of a cell side by side, some 4 * ``block`` points: fewer pairs, each over more centers
    tops = netted.where("middle is not null").select(*group, "block", "middle", "wide", "size")
    before = F.sum("size").over(Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    tops = Written(tops.withColumn("super", F.xxhash64(*group, F.floor(F.coalesce(before, F.lit(0)) / (4 * block)))), "tops").df
    gap = F.sqrt(F.aggregate(F.zip_with("middle", "first", lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t))
    firsts = tops.groupBy(*group, "super").agg(F.min_by("middle", "block").alias("first"))
    ball = tops.join(firsts, [*group, "super"]).groupBy(*group, F.col("super").alias("block"), F.col("first").alias("middle")).agg(F.max(gap + F.col("wide")).alias("wide"))
    netted = netted.join(tops.select("block", "super"), "block").drop("block").withColumnRenamed("super", "block")
    netted = Written(netted.select("label", "d", "block", "p", "m", "v", "c", "far"), "netted").df
    one, two = (ball.select("label", "d", F.col("cell").alias(c), F.col("block").alias(k), F.col("middle").alias(f"m{k}"), F.col("wide").alias(f"w{k}")) for c, k in (("cell", "x"), ("other", "y")))
    apart = F.sqrt(F.aggregate(F.zip_with("mx", "my", lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t))
    pairs = near.join(one, group).join(two, ["label", "d", "other"]).where(F.col("x") < F.col("y")).where(apart <= F.col("wx") + F.col("wy") + reach + 1e-9)
    pairs = Written(pairs.select("label", "d", "x", "y").distinct(), "blockpairs").df

    # centers of both blocks meet; of each the ones that may have a partner come back
    reps = netted.groupBy("label", "d", "block", "c").agg(F.max("far").alias("r")).join(netted.select("label", "d", "block", F.col("p").alias("c"), "v"), ["label", "d", "block", "c"])
    reps = Written(reps, "reps").df
    sent = [pairs.select("label", "d", "x", "y", F.col(k).alias("block"), F.lit(k == "y").alias("second")) for k in "xy"]
    meet = sent[0].union(sent[1]).join(reps, ["label", "d", "block"])

    def touch(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[~f["second"]], f[f["second"]]
        x, y = _unit(a["v"]), _unit(b["v"])
        d = np.sqrt(np.maximum(0.0, 2 - 2 * x @ y.T))
        on = d <= a["r"].to_numpy()[:, None] + b["r"].to_numpy()[None, :] + reach + 1e-7
        got = pd.concat([a[on.any(axis=1)], b[on.any(axis=0)]])
        return got[["label", "d", "x", "y", "block", "second", "c"]]

    touched = meet.groupBy("label", "d", "x", "y").applyInPandas(touch, f"label {kind}, d int, x long, y long, block long, second boolean, c long")
    across = touched.join(netted.select("label", "d", "block", "c", "p", "m", "v"), ["label", "d", "block", "c"]).select("label", "d", "x", "y", "second", "p", "m", "v")
    inside = netted.select("label", "d", F.col("block").alias("x"), F.col("block").alias("y"), F.lit(False).alias("second"), "p", "m", "v")
    return Written(across.union(inside), "nearpoints").df


def embedding_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, block: int = 1024, max_pivots: int = 4096
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` (smallest id reachable by links, itself included) and ``kept``.

    Two rows link if their labels are equal and not null, their vectors as long, and the cosine in double precision is
    at least ``cosine``. Vectors that are null, empty, zero, or hold nulls or non-finite numbers link with nothing; such
    rows, and rows with a null label, have no links and their own id as component. Repeated rows link with each other.
    A null id links but names no component. Of equal ids and of cosines that tie at the threshold nothing is left out. Other columns are not
    read and may have any names. Vectors of any length are compared whole. An empty table gives an empty one. ``max_pivots`` bounds the
    sample of pivots, over all labels; every point is in a cell, whatever the sample, and all links are found.
    """
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.when(sound, norm > 0).otherwise(False)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumns({"k1": F.xxhash64("label", "v"), "k2": F.hash("label", "v")})
    points = rows.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v"), F.first(F.struct("label", F.size("v").alias("d"))).alias("g"))
    points = Written(points.withColumn("p", F.col("k1")), "points")
    spark = vectors.sparkSession

    # pivots: only groups of over two blocks have any; their number follows the group, within the bound over all
    size = points.df.groupBy("g").count().where(F.col("count") > 2 * block)
    total = size.agg(F.sum("count")).first()[0] or 0
    pivots: dict[tuple, list] = {}
    if total:
        share = min(1.0, min(max_pivots, total // block) / total)
        some = points.df.join(F.broadcast(size.select("g")) if total <= 50_000_000 else size.select("g"), "g").where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        for r in some.select("g", "v").limit(2 * max_pivots).collect():
            pivots.setdefault(tuple(r["g"]), []).append(r["v"])
    centers = {k: _unit(x) for k, x in pivots.items()}

    def place(frames):
        for f in frames:
            cell, far, own = np.zeros(len(f), np.int32), np.zeros(len(f)), np.zeros(len(f), bool)
            for k, at in f.groupby(["label", "d"], sort=False).indices.items():
                x = _unit(f["v"].iloc[at])
                c = centers.get(tuple(k))
                if c is None:
                    far[at] = np.sqrt(np.maximum(0.0, 2 - 2 * x[:, 0]))  # one cell, around the first axis
                else:
                    nearest = (x @ c.T).argmax(axis=1)
                    cell[at], own[at] = nearest, True
                    far[at] = np.sqrt(((c[nearest] - x) ** 2).sum(axis=1))
            yield f.assign(cell=cell, far=far, own=own)

    kind = points.df.schema["g"].dataType["label"].dataType.simpleString()
    flat = points.df.select("p", "id", "m", "v", F.col("g.label").alias("label"), F.col("g.d").alias("d"), "k1", "k2")
    placed = Written(flat.mapInPandas(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema) + ", cell int, far double, own boolean"), "placed")
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    if total:
        mine = _near_points(placed.df, centers, reach, block, kind)
    else:
        # every group is a block of its own
        whole = F.xxhash64("label", "d")
        mine = placed.df.select("label", "d", whole.alias("x"), whole.alias("y"), F.lit(False).alias("second"), "p", "m", "v")

    def link(f: pd.DataFrame) -> pd.DataFrame:
        same = f["x"].iat[0] == f["y"].iat[0]
        one, two = f[~f["second"]], f[f["second"]]
        if same:
            two = one
        out = {"p": [], "links": [], "to": []}
        if len(one) and len(two):
            x = _unit(one["v"])
            y = x if same else _unit(two["v"])
            tx = cover_tree(x)
            m = dual_links(x, y, cosine, tx, tx if same else cover_tree(y))
            ids = one["p"].to_numpy() if same else np.concatenate([one["p"].to_numpy(), two["p"].to_numpy()])
            if same:
                np.fill_diagonal(m, False)
                counts = m.astype(np.int64) @ one["m"].to_numpy()
            else:
                counts = np.concatenate([m.astype(np.int64) @ two["m"].to_numpy(), m.T.astype(np.int64) @ one["m"].to_numpy()])
            on = np.flatnonzero(counts)
            edges = _forest(m, same)
            out["p"] = [*ids[on], *(ids[u] for u, _ in edges)]
            out["links"] = [*counts[on], *([0] * len(edges))]
            out["to"] = [*([None] * len(on)), *(ids[v] for _, v in edges)]
        return pd.DataFrame({"p": pd.array(out["p"], "Int64"), "links": pd.array(out["links"], "Int64"), "to": pd.array(out["to"], "Int64")})

    got = Written(mine.groupBy("label", "d", "x", "y").applyInPandas(link, "p long, links long, to long"), "embedlinks")
    count = got.df.groupBy("p").agg(F.sum("links").alias("links"))
    roots = components(got.df.where("to is not null").select("p", "to"))
    named = Written(points.df.select("p", "k1", "k2", "id", "m").join(count, "p", "left").join(roots.df.withColumnRenamed("node", "p"), "p", "left").withColumn("root", F.coalesce("root", "p")), "named")
    first = Written(named.df.groupBy("root").agg(F.min("id").alias("first")), "first")
    final = Written(named.df.join(first.df, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), "first"), "embedout")
    ok = rows.select("id", "ok", "k1", "k2").join(final.df.withColumn("ok", F.lit(True)), ["ok", "k1", "k2"], "left")
    component = F.coalesce("first", "id")
    return ok.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
