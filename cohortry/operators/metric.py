"""Exact nearest-neighbour joins: cells around pivots, rings of a cell, and bounds that decide which rings a query meets; a grid of packs where bounds leave most.

Sampled pivots part the fitted points into cells, and quantiles of the distance to the pivot part a cell into rings. A query first meets one
block of the ring that it lies in itself; the cost found there bounds what may be better. By the triangle inequality no point of a ring is nearer than the gap
between the query's distance to the pivot and the ring. So the query is sent to the rings whose gap allows something as good, and to no other.

Vectors without clusters are as good as equally far from each other, and no bound leaves out much: each query would be sent to each block. A sample of the queries tells
how many rows that would be. Where a grid moves fewer, queries and points are dealt into large packs, and each pack of queries meets each pack of points once.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rings of a cell at most, and pivots at most; the tables of both come to the driver and go to tasks, whatever the number of points.
RINGS, PIVOTS = 32, 2048


_OWN: dict[str, str] = {}


@contextlib.contextmanager
def cleaned(spark) -> Iterator[None]:
    """Shuffles of a query that runs here are deleted as it ends: what is written is read from its files."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the folder of ``spark.checkpoint.dir`` and read again: lost executors cost nothing, plans stay short, and nothing is worked
    out twice. Only in a session of one process that names no folder a temporary one stands in."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="cohortry-")
        base = _OWN[context.applicationId]
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances by the product, a bound of their error) of all pairs."""
    sizes = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    return np.maximum(sizes - 2 * x @ y.T, 0.0), sizes * (4e-16 * (x.shape[1] + 8))


@dataclass
class Rings:
    """Pivots, and of each ring its cell, its span of distances to the pivot, its least weight and its number of blocks."""

    pivots: np.ndarray
    cuts: dict[int, np.ndarray]
    cell: np.ndarray
    ring: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray
    parts: np.ndarray
    scale: float

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2, _ = squares(x, self.pivots)
        cell = d2.argmin(axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))

    def home(self, cell: np.ndarray, away: np.ndarray) -> np.ndarray:
        """The ring, by its place in the table, that a query lies in or nearest to; of a cell without points -1."""
        out = np.full(len(cell), -1)
        for c in np.unique(cell):
            own = np.flatnonzero(self.cell == c)
            if len(own):
                at = np.flatnonzero(cell == c)
                gap = np.maximum(np.maximum(away[at][:, None] - self.hi[own], self.lo[own] - away[at][:, None]), 0)
                out[at] = own[gap.argmin(axis=1)]
        return out

    def allowed(self, x: np.ndarray, weight: np.ndarray | None, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, ring) places of all pairs in which a point may cost as little as ``cost``."""
        d = np.sqrt(squares(x, self.pivots)[0])
        slack = 1e-7 * (np.sqrt((x * x).sum(axis=1)) + self.scale)
        q, r = [], []
        # by cells first, then by the rings of those that are left
        cells, start = np.unique(self.cell, return_index=True)
        last = np.r_[start[1:], len(self.cell)]
        lo, hi = np.minimum.reduceat(self.lo, start), np.maximum.reduceat(self.hi, start)
        least = np.minimum.reduceat(self.least, start)
        for lo, hi, least, at, pairs in ((lo, hi, least, cells, None), (self.lo, self.hi, self.least, self.cell, (q, r))):
            if pairs is None:
                i, j = np.divmod(np.arange(len(x) * len(cells)), len(cells))
            else:
                i, c = q[0], r[0]
                size = (last - start)[c]
                j = np.repeat(start[c] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                i = np.repeat(i, size)
            gap = np.maximum(np.maximum(d[i, at[j]] - hi[j], lo[j] - d[i, at[j]]) - slack[i], 0)
            w = 1.0 if weight is None else weight[i] * least[j] / (weight[i] + least[j])
            on = w * gap * gap <= cost[i] * (1 + 1e-9)
            q, r = [i[on]], [j[on]]
        return q[0], r[0]


#: Bytes of vectors of a pack; a task of the grid holds two packs and a few tiles of distances, whatever the number of rows.
PACK = 32 << 20


def _packs(rows: float, width: int) -> int:
    """Packs a side: of ``PACK`` bytes at most, and at least six, so that all cores have work, unless packs would be tiny."""
    return int(max(1, min(6, rows // 500), -(-rows * 8 * max(1, width) // PACK)))


def grid(queries: DataFrame, points: DataFrame, best: Callable, out: str, n_queries: int, n_points: int, width: int) -> DataFrame:
    """Rows of ``best`` for each pack of ``queries`` (id, v, w) and each pack of ``points`` (id, v, w).

    Each row is sent once a pack of the other side, so that the rows moved are the two numbers of rows times the packs: some hundred times fewer than pairs of a query and a small block.
    """
    a, b = _packs(n_queries, width), _packs(n_points, width)
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit("pack")), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("id", "v", "w", F.lit(float("inf")).alias("cost"), dealt(a).alias("i"), spread(b).alias("j"))
    # new names of columns, as both sides may be one table
    f = points.select(*[F.col(c).alias(c) for c in ("id", "v", "w")]).select("id", "v", "w", dealt(b).alias("j"), spread(a).alias("i"))
    empty = pd.DataFrame({c.split()[0]: [] for c in out.split(", ")})

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return best(x, y) if len(x) and len(y) else empty

    # a task a pair of packs, as adaptive execution would put many pairs of few bytes and much work into one
    q, f = q.repartition(a * b, "i", "j"), f.repartition(a * b, "i", "j")
    return q.groupBy("i", "j").cogroup(f.groupBy("i", "j")).applyInPandas(run, out)


class Fitted:
    """Points dealt to blocks of rings: ``points`` (id, v, w, ring, part) and the table of rings."""

    def __init__(self, points: DataFrame, block: int = 1024, pivots: int = PIVOTS):
        """``points`` has ``id``, ``v`` (array of double) and a weight ``w``; distinct ids."""
        spark = points.sparkSession
        n = points.count()
        take = max(1, min(pivots, -(-n // block)))
        chosen = matrix(r["v"] for r in points.orderBy(F.xxhash64("v"), "id").limit(take).select("v").collect())
        kind = points.schema["id"].dataType.simpleString()
        bare = Rings(chosen, {}, *[np.zeros(0)] * 6, 0.0)

        def place(frames):
            for f in frames:
                if len(f):
                    cell, away = bare.nearest(matrix(f["v"]))
                    yield f.assign(cell=cell.astype(np.int32), away=away)

        cells = scratch(points.select("id", "v", "w").mapInPandas(place, f"id {kind}, v array<double>, w double, cell int, away double"), "cells")
        shares = [(i + 1) / RINGS for i in range(RINGS - 1)]
        found = cells.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("away", shares, 1000).alias("cuts"))
        # a row a pivot: as many rings as the cell has blocks
        cuts = {}
        for r in found.collect():
            rings = min(RINGS, -(-r["n"] // block))
            cuts[r["cell"]] = sorted({r["cuts"][i * RINGS // rings - 1] for i in range(1, rings)})
        table = spark.createDataFrame(list(cuts.items()) or [(0, [])], "cell int, cuts array<double>")
        ringed = cells.join(F.broadcast(table), "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("away")))).drop("cuts")
        stats = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi"), F.min("w").alias("least"))
        rows = sorted(stats.collect(), key=lambda r: (r["cell"], r["ring"]))
        col = lambda k, t=np.float64: np.array([r[k] for r in rows], t)
        parts = -(-col("n", np.int64) // block)
        reach = float((np.sqrt((chosen * chosen).sum(axis=1))).max()) + float(col("hi").max()) if len(rows) else 0.0
        self.rings = Rings(chosen, cuts, col("cell", np.int64), col("ring", np.int64), col("lo"), col("hi"), col("least"), parts, reach)
        place_of = spark.createDataFrame([(r["cell"], r["ring"], i, int(p)) for i, (r, p) in enumerate(zip(rows, parts))] or [(0, 0, 0, 1)], "cell int, ring int, at int, parts int")
        self.points = ringed.join(F.broadcast(place_of), ["cell", "ring"]).select("id", "v", "w", F.col("at").alias("ring"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        self.n, self.width, self.whole, self.dense = n, chosen.shape[1] if n else 0, points, False

    def search(self, queries: DataFrame, best: Callable, out: str, bound: Callable | list[Callable], q_block: int = 4096, packed: Callable | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows of ``out``, copies) for ``queries`` (id, v, w).

        ``best(q, f)`` gives rows of ``out``, which starts with the query's ``id``, for queries (with ``cost``, infinite at first) and one block of points; ``bound(rows)`` gives (id, cost)
        of the queries by the rows of the first block met. Of several bounds the first that leaves little enough is taken (``known``). ``copies`` has the number of blocks that each query was sent to,
        or of packs where the grid is taken, with ``packed`` for ``best`` if given, as ``dense`` tells then.
        """
        rings = self.rings
        kind = queries.schema["id"].dataType.simpleString()
        sent = f"id {kind}, v array<double>, w double, cost double, ring int, part int"

        def first(frames):
            for f in frames:
                if len(f):
                    home = rings.home(*rings.nearest(matrix(f["v"])))
                    f = f.assign(cost=np.inf, ring=home.astype(np.int32))
                    f = f[home >= 0]
                    yield f.assign(part=(pd.util.hash_pandas_object(f["id"], index=False).to_numpy() % rings.parts[f["ring"]].astype(np.uint64)).astype(np.int32))

        def others(frames):
            for f in frames:
                for at in range(0, len(f), 256):
                    g = f.iloc[at : at + 256]
                    q, r = rings.allowed(matrix(g["v"]), g["w"].to_numpy(), g["cost"].to_numpy())
                    parts = rings.parts[r]
                    q, r, part = np.repeat(q, parts), np.repeat(r, parts), np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                    new = ~((g["ring"].to_numpy()[q] == r) & (g["part"].to_numpy()[q] == part))
                    got = g.iloc[q[new]]
                    yield got.assign(ring=r[new].astype(np.int32), part=part[new].astype(np.int32))

        def counts(frames):
            for f in frames:
                if len(f):
                    cell, away = rings.nearest(matrix(f["v"]))
                    for at in range(0, len(f), 256):
                        g, c = f.iloc[at : at + 256], f["cost"].to_numpy()[at : at + 256]
                        q, r = rings.allowed(matrix(g["v"]), g["w"].to_numpy(), c)
                        yield pd.DataFrame({"copies": np.bincount(q, rings.parts[r], len(g))})

        one = scratch(queries.select("id", "v", "w").mapInPandas(first, sent), "first")
        met = scratch(self._meet(one, best, out, q_block), "met")
        asked = one.count()
        a, b = _packs(asked, self.width), _packs(self.n, self.width)
        for limit in bound if isinstance(bound, list) else [bound]:
            self.known = limit(met)
            # a query whose first block held too little, or whose cell is empty, may go anywhere
            open_ = queries.select("id", "v", "w").join(one.select("id", "ring", "part"), "id", "left").join(self.known, "id", "left")
            open_ = open_.select("id", "v", "w", F.coalesce("cost", F.lit(float("inf"))).alias("cost"), F.coalesce("ring", F.lit(-1)).alias("ring"), F.coalesce("part", F.lit(-1)).alias("part"))
            sample = open_.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(max(1, asked // 1000))) == 0)
            mean = sample.mapInPandas(counts, "copies double").agg(F.avg("copies")).first()[0] or 0.0
            self.dense = mean * asked > asked * b + self.n * a
            if not self.dense:
                break
        if self.dense:
            rows = grid(queries, self.whole, packed or best, out, asked, self.n, self.width)
            return rows, queries.select("id", F.lit(b).cast("long").alias("copies"))
        two = scratch(open_.mapInPandas(others, sent), "others")
        rows = met.unionByName(self._meet(two, best, out, q_block))
        copies = one.select("id").union(two.select("id")).groupBy("id").agg(F.count("*").alias("copies"))
        return rows, copies

    def _meet(self, sent: DataFrame, best: Callable, out: str, q_block: int) -> DataFrame:
        """Queries and points by blocks; where many queries meet a block, parts of them meet copies of it."""
        asked = sent.groupBy("ring", "part").agg(F.ceil(F.count("*") / q_block).cast("int").alias("times"))
        q = sent.join(asked, ["ring", "part"]).withColumn("turn", F.pmod(F.xxhash64("id"), F.col("times")).cast("int")).drop("times")
        f = self.points.join(asked, ["ring", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")
        key = ["ring", "part", "turn"]

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return best(a, b) if len(a) and len(b) else empty

        empty = pd.DataFrame({c.split()[0]: [] for c in out.split(", ")})
        return q.groupBy(*key).cogroup(f.groupBy(*key)).applyInPandas(run, out)


#: Queries and points of a tile of distances: some 8 MB.
TILE_Q, TILE = 512, 2048


def smallest(x: np.ndarray, y: np.ndarray, k: int, times: np.ndarray | None = None, cost: np.ndarray | None = None) -> np.ndarray:
    """The ``k`` least distances of each row of ``x`` to rows of ``y``, ascending; infinite where there are fewer.

    A row of ``y`` counts ``times``; squared distances above ``cost`` may be left out. Tiles are compared one after the other, so that memory does not grow with either side: products first,
    then exact differences of the few that may be among the least so far.
    """
    found = np.full((len(x), k), np.inf)
    ys, share = (y * y).sum(axis=1), 4e-16 * (x.shape[1] + 8)
    for at in range(0, len(x), TILE_Q):
        own, have = x[at : at + TILE_Q], found[at : at + TILE_Q]
        xs = (own * own).sum(axis=1)
        limit = np.full(len(own), np.inf) if cost is None else cost[at : at + TILE_Q] * (1 + 1e-9)
        twice = -2 * own
        for to in range(0, len(y), TILE):
            part, size = y[to : to + TILE], ys[to : to + TILE]
            low = twice @ part.T
            low += (1 - share) * size
            top = limit - (1 - share) * xs
            if not np.isfinite(have[:, -1]).all():
                m = min(k, len(part)) - 1
                top = np.minimum(top, np.partition(low + 2 * share * size, m, axis=1)[:, m] + 2 * share * xs)
            q, f = np.nonzero(low <= top[:, None])
            if not len(q):
                continue
            exact = np.sqrt(((own[q] - part[f]) ** 2).sum(axis=1))
            if times is not None:
                n = times[to + f]
                q, exact = np.repeat(q, n), np.repeat(exact, n)
            rows = np.unique(q)
            q = np.concatenate([np.repeat(rows, k), q])
            exact = np.concatenate([have[rows].ravel(), exact])
            order = np.lexsort((exact, q))
            q, exact = q[order], exact[order]
            on = np.arange(len(q)) - np.searchsorted(q, q) < k
            have[rows] = exact[on].reshape(len(rows), k)
            limit = np.minimum(limit, have[:, -1] ** 2 * (1 + 1e-9))
    return found


def _nearest(k: int) -> Callable:
    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = smallest(matrix(a["v"]), matrix(b["v"]), k, np.minimum(b["w"].to_numpy(np.int64), k), a["cost"].to_numpy())
        on = np.isfinite(d)
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), on.sum(axis=1)), "d": d[on]})

    return best


def knn_join(queries: DataFrame, fit: DataFrame, key: str, vector: str, k: int, block: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """(key, distances, copies): the ``k`` smallest Euclidean distances of each query to rows of ``fit``, ascending, and the number of blocks of ``fit``
    that it was compared with.

    ``k`` is at most the number of fitted rows. Equal vectors are one point with a weight, on either side, so that copies cost nothing. Null vectors and keys, and
    queries where ``fit`` is empty, have null distances. Nothing but the sample of pivots and the table of rings comes to the driver.
    """
    vec = F.col(f"`{vector}`").cast("array<double>")
    points = scratch(fit.select(vec.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").cast("double").alias("w")).withColumn("id", F.xxhash64("v")), "points")
    total = points.agg(F.sum("w")).first()[0]
    asked = scratch(queries.select(F.col(f"`{key}`").alias("key"), vec.alias("v")), "asked")
    if not total:
        return asked.select(F.col("key").alias(key), F.lit(None).cast("array<double>").alias("distances"), F.lit(0).cast("long").alias("copies"))
    k = int(min(k, total))
    own = scratch(asked.where("v is not null").groupBy("v").agg(F.lit(1.0).alias("w")).withColumn("id", F.monotonically_increasing_id()), "queries")

    def bound(met: DataFrame) -> DataFrame:
        return met.groupBy("id").agg(F.count("*").alias("n"), F.max("d").alias("d")).where(F.col("n") >= k).select("id", (F.col("d") * F.col("d")).alias("cost"))

    rows, copies = Fitted(points, block, pivots).search(own, _nearest(k), "id long, d double", bound)
    place = F.row_number().over(Window.partitionBy("id").orderBy("d"))
    near = scratch(rows.withColumn("r", place).where(F.col("r") <= k).groupBy("id").agg(F.sort_array(F.collect_list("d")).alias("distances")), "near")
    named = own.select("id", "v").join(near, "id").join(copies, "id").select("v", "distances", "copies")
    return asked.join(named, "v", "left").select(F.col("key").alias(key), "distances", F.coalesce("copies", F.lit(0)).alias("copies"))


# ---- Ward's clustering


def ward_merges(size: np.ndarray, center: np.ndarray) -> list[tuple[int, int, float]]:
    """(kept, gone, height) of all merges of a few clusters, by chains of nearest neighbours."""
    size, center = size.astype(np.float64).copy(), center.copy()
    alive, chain, out = np.ones(len(size), bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            d = size[i] * size / (size[i] + size) * ((center - center[i]) ** 2).sum(axis=1)
            d[~alive] = np.inf
            d[i] = np.inf
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        a, b = min(i, j), max(i, j)
        out.append((a, b, float(d[j])))
        center[a] = (size[a] * center[a] + size[b] * center[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    return out


#: A cluster's choices that are kept, at least and at most; choices that one task takes; pairs that merge in one round over tasks; share of clusters without choices that a search
#: waits for, and share that a round over tasks merges at least before one.
CHOICES, PIECE, PAIRS, OPEN, FEW = (16, 64), 2 << 20, 500_000, 0.3, 0.005

#: Clusters with their choices in the order of cost and id; what a piece gives: those, merges (id, gone, height, step), or the roots of what merged; what a search gives.
LISTS = "id long, w double, bound double, others array<long>, costs array<double>, sizes array<double>"
DONE = f"{LISTS}, gone long, height double, step int, root long"
FOUND = "id long, w double, other long, c double, size double, upto double"


def cheapest(x: np.ndarray, s: np.ndarray, own: np.ndarray, y: np.ndarray, w: np.ndarray, other: np.ndarray, k: int, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``x``, row of ``y``, cost) of the ``k`` unions of each ``x`` with a ``y`` of another id that add the least squared error, in the order of cost and id; none above ``cost``.

    ``other`` ascends. What costs at most T is told by a product: |y|^2 - 2xy - T/w <= T/s - |x|^2. It is made in single precision with a bound of its error, in double precision where that leaves
    many; those left are worked out by differences. T falls as twice the rows are seen.
    """
    mean = y.mean(axis=0)
    yc, ends = y - mean, [512]
    while ends[-1] < len(y):
        ends.append(ends[-1] + min(ends[-1], 16 * TILE))
    ys, inverse = (yc * yc).sum(axis=1), 1 / w
    right = np.column_stack([yc, ys, inverse])
    small = right.astype(np.float32) if np.abs(right).max() < 1e15 else None
    out = []
    for at in range(0, len(x), TILE_Q):
        xo, so, name, top = x[at : at + TILE_Q], s[at : at + TILE_Q], own[at : at + TILE_Q], cost[at : at + TILE_Q] * (1 + 1e-9)
        xc = xo - mean
        xs = (xc * xc).sum(axis=1)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        begin = 0
        for end in ends:
            new = [held]
            for lo in range(begin, min(end, len(y)), TILE):
                hi = min(lo + TILE, end, len(y))
                known = np.isfinite(top)
                if not known.all():
                    # nothing to compare with yet: the k-th of these rows, where there are so many
                    d2 = np.maximum(xs[:, None] + ys[lo:hi] - 2 * xc @ yc[lo:hi].T, 0.0) + (xs[:, None] + ys[lo:hi]) * (4e-16 * (x.shape[1] + 8))
                    high = so[:, None] * w[lo:hi] / (so[:, None] + w[lo:hi]) * d2
                    high[name[:, None] == other[lo:hi]] = np.inf
                    if k <= hi - lo:
                        top = np.minimum(top, np.partition(high, k - 1, axis=1)[:, k - 1] * (1 + 1e-9))
                limit = np.where(np.isfinite(top), top, 0.0)
                left = np.column_stack([-2 * xc, np.ones(len(xc)), -limit])
                size = 2 * xs + 2 * ys[lo:hi].max() + limit * inverse[lo:hi].max() + limit / so
                for kind, part in ((np.float32, small), (np.float64, right)):
                    if part is None or (kind is np.float32 and not size.max() < 1e30):
                        continue
                    room = limit / so - xs + (x.shape[1] + 16) * (6e-8 if kind is np.float32 else 3e-16) * size
                    room[~np.isfinite(top)] = np.inf
                    on = left.astype(kind, copy=False) @ part[lo:hi].T <= room.astype(kind)[:, None]
                    if kind is np.float64 or np.count_nonzero(on) <= on.size // 32:
                        break
                q, f = np.divmod(np.flatnonzero(on), hi - lo)
                f += lo
                # differences of a bounded number of pairs at a time
                for i in range(0, len(q), 1 << 16):
                    a, b = q[i : i + (1 << 16)], f[i : i + (1 << 16)]
                    a, b = (z[name[a] != other[b]] for z in (a, b))
                    c = so[a] * w[b] / (so[a] + w[b]) * ((xo[a] - y[b]) ** 2).sum(axis=1)
                    keep = c <= top[a]
                    new.append([a[keep], b[keep], c[keep]])
            begin = end
            if len(new) > 1:
                q, f, c = (np.concatenate([n[i] for n in new]) for i in range(3))
                order = np.lexsort((f, c, q))
                q, f, c = q[order], f[order], c[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                held = q, f, c = q[keep], f[keep], c[keep]
                last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
                top[q[last]] = np.minimum(top[q[last]], c[last])
        out.append((held[0] + at, held[1], held[2]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _cheapest(k: int) -> Callable:
    """Rows of ``FOUND``; what a block does not give of a cluster costs at least ``upto``."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", ignore_index=True)
        own, s, other, w = a["id"].to_numpy(), a["w"].to_numpy(), b["id"].to_numpy(), b["w"].to_numpy()
        q, f, c = cheapest(matrix(a["v"]), s, own, matrix(b["v"]), w, other, k, a["cost"].to_numpy(np.float64))
        upto = np.full(len(a), np.inf)
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
        upto[q[last]] = c[last]
        return pd.DataFrame({"id": own[q], "w": s[q], "other": other[f], "c": c, "size": w[f], "upto": upto[q]})

    return best


def merge_choices(ids: np.ndarray, w: np.ndarray, bound: np.ndarray, near: tuple, pairs: tuple) -> tuple:
    """(ids, w, bound, near) after all ``pairs`` have merged; ``near`` has (row, other, c, size) of choices, rows of ``ids`` ascending and ids sorted.

    ``pairs`` has (member ascending, into, height, own size, size of the mate), each pair twice; both members are among ``ids`` or neither is. A cluster that is no choice of a row costs at least
    its ``bound``. By the formula of Lance and Williams the cost of a union follows from the costs of its parts: exactly if both are choices, else a bound that takes the place of the row's if it is lower.
    """
    member, into, height, mine, mate = pairs

    def place(name):
        p = np.minimum(np.searchsorted(member, name), len(member) - 1)
        return np.where(member[p] == name, p, -1)

    def united(key, name, c, size_a, size_b, size, h, missing):
        """(first places, costs, both known) of entries that meet, in the order of ``key`` and ``name``."""
        order = np.lexsort((name, key))
        k, n = key[order], name[order]
        start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])]) if len(k) else np.zeros(0, np.int64)
        both = np.diff(np.r_[start, len(k)]) == 2
        one = order[start]
        total = np.add.reduceat(((size_a + size) * c)[order], start) if len(k) else np.zeros(0)
        total = total + np.where(both, 0.0, (size_b[one] + size[one]) * missing[one])
        return one, (total - size[one] * h[one]) / (size_a[one] + size_b[one] + size[one]), both

    row, other, c, size = near
    p = place(ids)
    new, x = np.unique(np.where(p >= 0, into[p], ids), return_inverse=True)
    moved = np.flatnonzero(p >= 0)
    moved = moved[np.argsort(x[moved], kind="stable")]
    a, b = moved[::2], moved[1::2]
    partner = np.arange(len(ids))
    partner[a], partner[b] = b, a
    weight = np.bincount(x, w, len(new))
    least = np.empty(len(new))
    least[x] = bound
    least[x[a]] = np.minimum((w[a] * bound[a] + w[b] * bound[b]) / (w[a] + w[b]), bound[a] + bound[b] - height[p[a]])

    # choices of rows that merge
    on = p[row] >= 0
    go = on & (other != ids[partner[row]])
    r = row[go]
    one, cost, both = united(x[r], other[go], c[go], w[r], w[partner[r]], size[go], height[p[r]], np.maximum(bound[partner[r]], height[p[r]]))
    np.minimum.at(least, x[r][one[~both]], cost[~both])
    rows, others, costs, sizes = x[r][one[both]], other[go][one[both]], cost[both], size[go][one[both]]
    fresh = np.r_[np.zeros(len(row) - on.sum(), bool), np.ones(len(rows), bool)]
    row, other, c, size = (np.concatenate(z) for z in ((x[row[~on]], rows), (other[~on], others), (c[~on], costs), (size[~on], sizes)))

    # choices that merge
    q = place(other)
    on = q >= 0
    r, m = row[on], q[on]
    one, cost, both = united(r, into[m], c[on], mine[m], mate[m], weight[r], height[m], np.maximum(least[r], height[m]))
    np.minimum.at(least, r[one[~both]], cost[~both])
    rows, m = r[one[both]], m[one[both]]
    fresh = np.r_[fresh[~on], np.ones(len(rows), bool)]
    row, other, c, size = (np.concatenate(z) for z in ((row[~on], rows), (other[~on], into[m]), (c[~on], cost[both]), (size[~on], mine[m] + mate[m])))
    keep = c < least[row]
    row, other, c, size, fresh = row[keep], other[keep], c[keep], size[keep], fresh[keep]
    # rows without a new entry are in order
    touched = np.zeros(len(new), bool)
    touched[row[fresh]] = True
    on = touched[row]
    order = np.concatenate([np.flatnonzero(~on), np.flatnonzero(on)[np.lexsort((other[on], c[on], row[on]))]])
    order = order[np.argsort(row[order], kind="stable")]
    return new, weight, least, (row[order], other[order], c[order], size[order])


def _opened(t: pa.Table) -> tuple:
    """Rows of ``LISTS`` as (ids, w, bound, near) of ``merge_choices``."""
    t = t.take(pa.array(np.argsort(t["id"].to_numpy(), kind="stable")))
    flat = lambda c: pc.list_flatten(t[c]).to_numpy()
    row = np.repeat(np.arange(len(t)), pc.list_value_length(t["others"]).to_numpy())
    return t["id"].to_numpy(), t["w"].to_numpy(), t["bound"].to_numpy(), (row, flat("others"), flat("costs"), flat("sizes"))


def _closed(ids: np.ndarray, w: np.ndarray, bound: np.ndarray, near: tuple) -> pa.Table:
    cut = pa.array(np.searchsorted(near[0], np.arange(len(ids) + 1)).astype(np.int32))
    lists = {c: pa.ListArray.from_arrays(cut, pa.array(v)) for c, v in zip(("others", "costs", "sizes"), near[1:])}
    return pa.table({"id": ids, "w": w, "bound": bound, **lists})


def mutual(ids: np.ndarray, near: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row kept, row gone, height) of all clusters that are each other's first choice."""
    row, other, c, _ = near
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    to = np.full(len(ids), -1)
    to[row[first]] = np.searchsorted(ids, other[first])
    cost = np.zeros(len(ids))
    cost[row[first]] = c[first]
    kept = np.flatnonzero((to >= 0) & (to[to] == np.arange(len(ids))) & (np.arange(len(ids)) < to))
    return kept, to[kept], cost[kept]


def merged_pairs(kept, gone, height, w_kept, w_gone) -> tuple:
    """Pairs in the form that ``merge_choices`` takes."""
    member = np.concatenate([kept, gone])
    order = np.argsort(member)
    twice = lambda a, b: np.concatenate([a, b])[order]
    return member[order], twice(kept, kept), twice(height, height), twice(w_kept, w_gone), twice(w_gone, w_kept)


def _piece(local: int, step: int) -> Callable:
    """Rounds over lists that one task holds: until ``local`` clusters are left, no two chose each other, or too many have no choice left."""

    def run(batches):
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        ids, w, bound, near = _opened(pa.Table.from_batches(batches))
        own, root, at = ids, ids, step
        out = {"id": [], "gone": [], "height": [], "step": []}
        while len(ids) > local and len(ids) - len(np.unique(near[0])) <= OPEN * len(ids):
            kept, gone, height = mutual(ids, near)
            if not len(kept):
                break
            for name, v in (("id", ids[kept]), ("gone", ids[gone]), ("height", height), ("step", np.full(len(kept), at, np.int32))):
                out[name].append(v)
            pairs = merged_pairs(ids[kept], ids[gone], height, w[kept], w[gone])
            ids, w, bound, near = merge_choices(ids, w, bound, near, pairs)
            p = np.minimum(np.searchsorted(pairs[0], root), len(pairs[0]) - 1)
            root = np.where(pairs[0][p] == root, pairs[1][p], root)
            at += 1
        parts = [_closed(ids, w, bound, near)]
        if out["id"]:
            moved = np.isin(root, root[root != own])
            parts += [pa.table({k: np.concatenate(v) for k, v in out.items()}), pa.table({"id": own[moved], "root": root[moved]})]
        floats, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
        kinds = dict(id=pa.int64(), w=pa.float64(), bound=pa.float64(), others=longs, costs=floats, sizes=floats, gone=pa.int64(), height=pa.float64(), step=pa.int32(), root=pa.int64())
        for t in parts:
            t = pa.table({c: t[c] if c in t.column_names else pa.nulls(len(t), kind) for c, kind in kinds.items()})
            yield from t.to_batches(max_chunksize=20_000)

    return run


def _choices(todo: DataFrame, asked: int, clusters: DataFrame, n: int, width: int, k: int, block: int, dense: bool) -> tuple[DataFrame, bool]:
    """(rows of ``LISTS`` for the clusters of ``todo``, whether a grid was taken because bounds left most): some ``k`` of the cheapest unions of each, and what any other costs at least."""
    known = None
    # packs are dealt by hash, so that each holds a like share of the cheapest
    packed = _cheapest(-(-k // _packs(n, width)) + 3)
    if dense or 8 * width * n <= PACK:
        # centers of clusters that bounds did not part lie closer still; and few clusters cost less than the queries that find bounds
        rows = grid(todo, clusters, packed, FOUND, asked, n, width)
    else:
        fitted = Fitted(clusters, block)
        # all choices by bounds, or else the best one
        bounds = [lambda met, j=j: met.where(F.col("r") == j).select("id", F.col("c").alias("cost")) for j in (k + 1, 1)]
        order = F.row_number().over(Window.partitionBy("id").orderBy("c", "other"))
        rows, _ = fitted.search(todo, _cheapest(k + 1), FOUND, [lambda met, b=b: b(met.withColumn("r", order)) for b in bounds], packed=packed)
        dense, known = fitted.dense, None if fitted.dense else fitted.known
    near = F.array_sort(F.collect_list(F.struct("c", "other", "size")))
    found = rows.groupBy("id").agg(F.first("w").alias("w"), F.min("upto").alias("bound"), near.alias("near"))
    if known is not None:
        # what was not met costs more than the bound of the query
        found = found.join(known, "id", "left").withColumn("bound", F.least("bound", F.col("cost") * (1 + 2.3e-16)))
    below = F.filter("near", lambda e: e["c"] < F.col("bound"))
    # of equal costs at the bound the first one is known
    near = F.when(F.size(below) > 0, below).otherwise(F.slice("near", 1, 1))
    found = found.withColumn("near", near)
    return found.select("id", "w", "bound", F.col("near.other").alias("others"), F.col("near.c").alias("costs"), F.col("near.size").alias("sizes")), dense


def _round(lists: DataFrame, step: int, parts: int) -> tuple[DataFrame, DataFrame, int]:
    """(lists, merges, their number) after one round: of the pairs that chose each other ``PAIRS`` at most merge, which go to all tasks; others can wait, as no merge parts them."""
    spark = lists.sparkSession
    made = "kept long, gone long, height double, mine double, mate double"
    chosen = lists.where(F.size("others") > 0).select("id", F.col("others")[0].alias("other"), F.col("costs")[0].alias("c"), "w")
    back = chosen.select(F.col("other").alias("id"), F.col("id").alias("other"), F.col("w").alias("mate"))
    pairs = chosen.join(back, ["id", "other"]).where("id < other").select(F.col("id").alias("kept"), F.col("other").alias("gone"), F.col("c").alias("height"), F.col("w").alias("mine"), "mate")
    pairs = scratch(pairs.limit(PAIRS), "pairs")
    got = pairs.toPandas()
    merges = pairs.select("kept", "gone", "height", F.lit(step).alias("step"))
    if not len(got):
        return lists, merges, 0
    sent = spark.sparkContext.broadcast(merged_pairs(*(got[c.split()[0]].to_numpy() for c in made.split(", "))))

    def run(t: pa.Table) -> pa.Table:
        return _closed(*merge_choices(*_opened(t), sent.value))

    # both members of a pair come to one task
    named = lists.join(pairs.select(F.col("gone").alias("id"), "kept"), "id", "left").withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("kept", "id")), F.lit(parts))).drop("kept")
    after = scratch(named.groupBy("bucket").applyInArrow(run, LISTS), "lists")
    sent.destroy()
    return after, merges, len(got)


def _moved(clusters: DataFrame, roots_of: DataFrame, parts: int) -> DataFrame:
    """Clusters after merges: weighted means of those of one root; ``roots_of`` has (id, root) of all that merged, the roots too."""

    def mean(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["root", "id"], ignore_index=True)
        root, w = f["root"].to_numpy(), f["w"].to_numpy()
        start = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        total = np.add.reduceat(w, start)
        v = np.add.reduceat(matrix(f["v"]) * w[:, None], start) / total[:, None]
        return pd.DataFrame({"id": root[start], "v": list(v), "w": total})

    named = clusters.join(roots_of, "id", "left")
    united = named.where("root is not null").withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(parts)))
    united = united.groupBy("bucket").applyInPandas(lambda f: mean(f), "id long, v array<double>, w double")
    return scratch(named.where("root is null").select("id", "v", "w").unionByName(united), "clusters")


def ward_tree(points: DataFrame, local: int = 2000, block: int = 1024) -> DataFrame:
    """(kept, gone, height, step): all merges of Ward's clustering of ``points`` (id long, v, w), in rounds; a merge's parts have lower steps.

    In a search clusters find the others whose union adds the least squared error, by the same bounds as a nearest-neighbour join with the least weight of a ring or in a grid of packs, and keep
    some of them. In rounds all pairs that chose each other merge; as Ward's criterion is reducible, these are merges of the sequential algorithm. The costs of the new clusters to the choices that are left
    follow from the old ones, without vectors (``merge_choices``), so that only clusters that run out of choices are searched again, once ``OPEN`` of all have. Rounds are over tasks, or within one task where it holds
    all choices (``PIECE``). Once ``local`` clusters are left the rest is done in one piece.
    """
    spark = points.sparkSession
    clusters = scratch(points.select("id", "v", "w"), "clusters")
    n = clusters.count()
    first = clusters.select(F.size("v").alias("width")).first()
    width = first["width"] if first else 0
    lists, merged, dense, step, open_ = None, [], False, 0, n
    while n > local:
        todo = clusters if open_ == n else clusters.join(lists.where(F.size("others") == 0).select("id"), "id", "left_semi")
        k, whole = max(CHOICES[0], min(CHOICES[1], PIECE // n)), open_ == n
        found, dense = _choices(todo, open_, clusters, n, width, k, block, dense)
        lists = found if whole else found.unionByName(lists.where(F.size("others") > 0))
        before = n
        if n * CHOICES[0] <= PIECE:
            done = scratch(lists.repartition(1).mapInArrow(_piece(local, step), DONE), "lists")
            lists = done.where("height is null and root is null").select(*[c.split()[0] for c in LISTS.split(", ")])
            merged.append(done.where("height is not null").select(F.col("id").alias("kept"), "gone", "height", "step"))
            moved = done.where("root is not null").select("id", "root")
            gone, step = done.agg(F.count("height"), F.coalesce(F.max("step") + 1, F.lit(step))).first()
            n -= gone
            open_ = lists.where(F.size("others") == 0).count()
        else:
            lists, new, open_ = scratch(lists, "lists"), [], 0
            while n > local and open_ <= OPEN * n and n * CHOICES[0] > PIECE:
                lists, pairs, gone = _round(lists, step, _packs(n, 3 * CHOICES[1]))
                if not gone:
                    break
                new.append(pairs)
                n, step = n - gone, step + 1
                open_ = lists.where(F.size("others") == 0).count()
                if open_ and gone < n * FEW:
                    break  # a search of those without choices gives more pairs than another round
            merged += new
            if new:
                up = new[0]
                for m in new[1:]:
                    up = up.unionByName(m)
                ends = roots(up.select(F.col("gone").alias("id"), F.col("kept").alias("up")))
                moved = ends.unionByName(ends.select(F.col("root").alias("id"), "root").distinct())
        if n < before:
            clusters = _moved(clusters, moved, _packs(n, width))
        elif whole:
            raise RuntimeError(f"no two of {n} clusters chose each other")
        else:
            # costs that rounding made unequal on both sides: all choices are found anew
            open_ = n
    last = sorted(clusters.collect(), key=lambda r: r["id"])  # ``local`` rows at most
    ids = [r["id"] for r in last]
    rest = ward_merges(np.array([r["w"] for r in last]), matrix(r["v"] for r in last)) if last else []
    out = spark.createDataFrame([(ids[a], ids[b], h, step + i) for i, (a, b, h) in enumerate(rest)], "kept long, gone long, height double, step int")
    for m in merged:
        out = out.unionByName(m)
    return scratch(out, "merges")


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) of a forest of (id, up), one row an id: each step halves the ways that are left."""
    held = scratch(parents, "ways")
    while True:
        above = held.select(F.col("id").alias("up"), F.col("up").alias("next"))
        new = scratch(held.join(above, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "ways")
        held = new.select("id", "up")
        if new.where("moved").isEmpty():
            return held.withColumnRenamed("up", "root")


def ward_clusters(df: DataFrame, key: str, vector: str, k: int, local: int = 2000, block: int = 1024) -> DataFrame:
    """(key, cluster): Ward's clustering into ``k`` clusters, numbered from 0 in the order of their smallest keys.

    All merges but the k - 1 of the greatest heights are applied. Equal vectors are one point with a weight, so that there are no more clusters than distinct
    vectors. Of pairs of equal cost the one of smaller ids is taken. Rows with a null vector are in no cluster (null).
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    points = rows.where("v is not null").groupBy("v").agg(F.count("*").cast("double").alias("w"), F.min("key").alias("least"))
    points = scratch(points.withColumn("id", F.monotonically_increasing_id()), "points")
    merges = ward_tree(points.select("id", "v", "w"), local, block)
    highest = merges.orderBy(F.desc("height"), F.desc("step"), "gone").limit(k - 1).select("gone")  # k - 1 rows
    up = merges.join(F.broadcast(highest), "gone", "left_anti").select(F.col("gone").alias("id"), F.col("kept").alias("up"))
    named = scratch(points.join(roots(up), "id", "left").select("v", "least", F.coalesce("root", "id").alias("root")), "named")
    # k rows
    number = named.groupBy("root").agg(F.min("least").alias("least")).select("root", (F.row_number().over(Window.orderBy("least")) - 1).alias("cluster"))
    return rows.join(named.join(F.broadcast(number), "root").select("v", "cluster"), "v", "left").select(F.col("key").alias(key), "cluster")
