"""k-means and Gaussian mixtures whose steps are sums over the table, and singular vectors of sparse rows.

Each step sends what it has (centers, components, a block of vectors) to the tasks, a task gives one row of partial sums, and these are added up by place. So
what comes to the driver has the size of the model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metric import matrix, scratch
from .simulate import hashed_uniform


def summed(df: DataFrame, partial: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of ``partial(batch)``, an array of ``size`` numbers: a row a task, added up by place."""

    def run(frames):
        total = np.zeros(size)
        for f in frames:
            for at in range(0, len(f), 2048):
                total += partial(f.iloc[at : at + 2048])
        yield pd.DataFrame({"s": [total]})

    places = df.mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("p", "x")).where("x != 0").groupBy("p").agg(F.sum("x").alias("x"))
    out = np.zeros(size)
    got = places.toArrow()
    out[got.column("p").to_numpy()] = got.column("x").to_numpy()
    return out


def _literal(v: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def seeds_of(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """``k`` rows of (id, v) as first centers: each the first of all in a draw by a hash of id, seed and place, weighted by the squared distance to the centers so far.

    A weighted draw is the smallest of -ln(u) / weight. Fewer distinct rows give fewer centers.
    """
    chosen: list[np.ndarray] = []
    for j in range(k):
        u = hashed_uniform(F.col("id"), F.lit(f"{seed}|{j}"))
        if chosen:
            far = [F.aggregate(F.zip_with("v", _literal(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in chosen]
            d2 = F.least(*far) if len(far) > 1 else far[0]
            score = F.when(d2 > 0, -F.ln(u) / d2)
        else:
            score = u
        row = rows.select("id", "v", score.alias("s")).where("s is not null").agg(F.min_by("v", F.struct("s", "id")).alias("v")).first()
        if row["v"] is None:
            break
        chosen.append(np.array(row["v"]))
    return np.array(chosen)


def _sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


@dataclass
class Centers:
    centers: np.ndarray
    cost: float

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  as the library's model has it
        return list(self.centers)

    def transform(self, df: DataFrame, array: str, name: str = "cluster") -> DataFrame:
        """Adds the number of the nearest center (the first of equal ones)."""
        c = self.centers

        def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in frames:
                x = matrix(v) if len(v) else np.zeros((0, c.shape[1]))
                yield pd.Series(np.concatenate([_sq(x[i : i + 2048], c).argmin(axis=1) for i in range(0, len(x), 2048)] or [np.zeros(0)]).astype(np.int32))

        return df.withColumn(name, F.pandas_udf(run, "int")(F.col(array).cast("array<double>")))


def lloyd(rows: DataFrame, k: int, seed: int, rounds: int = 100) -> Centers:
    """k-means over (id, v): centers move to the mean of their rows until none moves or ``rounds`` are done. A center without rows stays."""
    centers = seeds_of(rows, k, seed)
    if not len(centers):
        return Centers(np.zeros((0, 0)), 0.0)
    k, d = centers.shape

    def partial(f: pd.DataFrame) -> np.ndarray:
        x = matrix(f["v"])
        d2 = _sq(x, centers)
        own = d2.argmin(axis=1)
        sums = np.zeros((k, d))
        np.add.at(sums, own, x)
        return np.concatenate([sums.ravel(), np.bincount(own, minlength=k), [d2[np.arange(len(x)), own].sum()]])

    done = 0
    while True:
        got = summed(rows, partial, k * d + k + 1)
        n = got[k * d : -1]
        moved = np.where(n[:, None] > 0, got[: k * d].reshape(k, d) / np.maximum(n, 1)[:, None], centers)
        if done == rounds or np.array_equal(moved, centers):
            return Centers(centers, float(got[-1]))
        centers, done = moved, done + 1


@dataclass
class Mixture:
    """Weights, means and full covariances of Gaussian components."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of weight times density, up to the constant of the dimension."""
        out = []
        for w, m, s in zip(self.weights, self.means, self.covs):
            low = np.linalg.cholesky(s)
            z = np.linalg.solve(low, (x - m).T)
            out.append(math.log(max(w, 1e-300)) - np.log(np.diag(low)).sum() - 0.5 * (z * z).sum(axis=0))
        return np.stack(out, axis=1)

    def transform(self, df: DataFrame, array: str, name: str = "cluster") -> DataFrame:
        def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in frames:
                yield pd.Series(self.log_shares(matrix(v)).argmax(axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32))

        return df.withColumn(name, F.pandas_udf(run, "int")(F.col(array).cast("array<double>")))


def expectation_maximization(rows: DataFrame, k: int, seed: int, rounds: int = 100, least: float = 1e-6, tolerance: float = 1e-3, start_rounds: int = 100) -> Mixture:
    """A mixture of ``k`` Gaussians over (id, v), from the clusters of ``lloyd``; ``least`` is added to each variance.

    A round works out each row's shares and sums them, the rows and their products by component; it ends when the mean log-likelihood gains less than ``tolerance``.
    """
    start = lloyd(rows, k, seed, start_rounds)
    k, d = start.centers.shape
    size = k * (1 + d + d * d) + 2

    def moved(got: np.ndarray, about: np.ndarray) -> Mixture:
        n = got[:k]
        n = np.maximum(n, 1e-10)
        shift = got[k : k + k * d].reshape(k, d) / n[:, None]
        covs = got[k + k * d : -2].reshape(k, d, d) / n[:, None, None] - shift[:, :, None] * shift[:, None, :] + least * np.eye(d)
        return Mixture(n / got[-1], about + shift, covs)

    def sums(x: np.ndarray, share: np.ndarray, about: np.ndarray, like: float) -> np.ndarray:
        z = x[:, None, :] - about
        return np.concatenate([share.sum(axis=0), np.einsum("nk,nkd->kd", share, z).ravel(), np.einsum("nk,nkd,nke->kde", share, z, z).ravel(), [like, len(x)]])

    def hard(f: pd.DataFrame) -> np.ndarray:
        x = matrix(f["v"])
        return sums(x, np.eye(k)[_sq(x, start.centers).argmin(axis=1)], start.centers, 0.0)

    mix, before = moved(summed(rows, hard, size), start.centers), -math.inf
    for _ in range(rounds):

        def soft(f: pd.DataFrame, mix=mix) -> np.ndarray:
            x = matrix(f["v"])
            logs = mix.log_shares(x)
            top = logs.max(axis=1, keepdims=True)
            share = np.exp(logs - top)
            total = share.sum(axis=1, keepdims=True)
            return sums(x, share / total, mix.means, float((np.log(total) + top).sum()))

        got = summed(rows, soft, size)
        mix, like = moved(got, mix.means), got[-2] / got[-1]
        if abs(like - before) < tolerance:
            break
        before = like
    return mix


def _flat(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of sparse rows (i, x)."""
    n = f["i"].map(len).to_numpy()
    empty = np.zeros(0)
    return np.repeat(np.arange(len(f)), n), np.concatenate([empty, *f["i"]]).astype(np.int64), np.concatenate([empty, *f["x"]])


def _parts(f: pd.DataFrame, width: int) -> Iterator[np.ndarray]:
    """Sparse rows as dense blocks of some 32 MB: a product with all columns takes less time than the sums of single entries."""
    step = max(1, min(2048, (4 << 20) // width))
    for at in range(0, len(f), step):
        g = f.iloc[at : at + step]
        row, col, val = _flat(g)
        yield np.bincount(row * width + col, val, len(g) * width).reshape(len(g), width)


def right_singular(rows: DataFrame, width: int, k: int, passes: int = 30, extra: int = 8, tolerance: float = 1e-11, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of sparse rows (i array<int>, x array<double>) of ``width`` columns: the ``k`` largest.

    A block of random directions is taken through the table again and again; of all blocks so far, made orthogonal to each other, the best combinations are found. A
    pass adds up ``width`` times the block's size numbers; it ends when the squared values gain less than ``tolerance`` of the greatest. The largest entry of each vector is positive.
    """
    k = min(k, width)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + extra))))[0]
    basis, images, before = np.zeros((width, 0)), np.zeros((width, 0)), None
    values = vectors = None
    for _ in range(passes):
        size = block.shape[1]

        def partial(f: pd.DataFrame, block=block) -> np.ndarray:
            out = np.zeros((width, block.shape[1]))
            for m in _parts(f, width):
                out += m.T @ (m @ block)
            return out.ravel()

        image = summed(rows, partial, width * size).reshape(width, size)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], basis @ mix[:, ::-1][:, :k]
        rest = image
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        q, r = np.linalg.qr(rest)
        keep = np.abs(np.diag(r)) > 1e-9 * max(1.0, float(values[0]))
        if before is not None and np.all(np.abs(values - before) <= tolerance * values[0]) or not keep.any() or basis.shape[1] >= width:
            break
        before, block = values, q[:, keep][:, : width - basis.shape[1]]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.sqrt(np.maximum(values, 0)), vectors * np.where(sign == 0, 1, sign)


def term_rows(df: DataFrame, text: str, min_df: int = 2, vocabulary: int = 12_000, pattern: str = r"(?U)\b\w\w+\b") -> tuple[DataFrame, DataFrame]:
    """((id, i, x), (term, i, df, idf)): words and word pairs by smoothed inverse frequency, ln((1 + n) / (1 + df)) + 1, rows of length 1.

    ``id`` is a column of ``df``. The vocabulary are the terms of the most occurrences that ``min_df`` texts have, of equal ones the first. Texts without a term have no row.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    n = df.count()
    # words are found once; terms are counted over the table first, so that only known ones are grouped by text
    every = scratch(df.select("id", words.alias("w")), "words").select("id", F.concat("w", pairs).alias("t"))
    each = every.select("id", F.explode("t").alias("term"))
    once = every.select(F.explode(F.array_distinct("t")).alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))
    known = each.select("term", F.lit(1).alias("tf"), F.lit(0).alias("df")).unionAll(once).groupBy("term").agg(F.sum("tf").alias("all"), F.sum("df").alias("df")).where(F.col("df") >= min_df).orderBy(F.desc("all"), "term").limit(vocabulary)
    listed = sorted(known.collect(), key=lambda r: r["term"])  # ``vocabulary`` rows at most
    terms = df.sparkSession.createDataFrame([(r["term"], i, r["df"], math.log((1 + n) / (1 + r["df"])) + 1) for i, r in enumerate(listed)], "term string, i int, df long, idf double")
    counts = each.join(F.broadcast(terms), "term").groupBy("id", "i", "idf").agg(F.count("*").alias("tf"))
    own = counts.select("id", F.struct("i", (F.col("tf") * F.col("idf")).alias("x")).alias("p"))
    rows = own.groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    x = F.transform("p", lambda s: s["x"])
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    # as an array of its own, as inside a function it would be worked out again for each entry
    lengths = F.array_repeat(length, F.size("p"))
    return scratch(rows.select("id", F.transform("p", lambda s: s["i"]).alias("i"), F.zip_with(x, lengths, lambda v, n: v / n).alias("x")), "rows"), terms


def text_embedding(df: DataFrame, key: str, text: str, components: int = 128, min_df: int = 2, vocabulary: int = 12_000, name: str = "embedding") -> DataFrame:
    """(key, embedding): rows of ``term_rows`` along their first right singular vectors, of length 1; zeros for a text without a known term."""
    held = scratch(df.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("id", F.monotonically_increasing_id()), "texts")
    rows, terms = term_rows(held.select("id", "t"), "t", min_df, vocabulary)
    width = terms.count()
    k = max(1, min(components, width, held.count()))
    v = right_singular(rows, width, k)[1] if width else np.zeros((0, k))
    sent = df.sparkSession.sparkContext.broadcast(v)

    def project(frames):
        for f in frames:
            for at in range(0, len(f), 2048):
                g = f.iloc[at : at + 2048]
                e = np.concatenate([m @ sent.value for m in _parts(g, len(sent.value))])
                n = np.sqrt((e * e).sum(axis=1, keepdims=True))
                yield pd.DataFrame({"id": g["id"], "e": list(e / np.where(n > 0, n, 1))})

    placed = rows.mapInPandas(project, "id long, e array<double>")
    return held.select("id", "k").join(placed, "id", "left").select(F.col("k").alias(key), F.coalesce("e", F.array_repeat(F.lit(0.0), k)).alias(name))
