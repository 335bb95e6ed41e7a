"""Distances between rows of vectors: nearest neighbours, centroids, prototypes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cosine, euclidean, softmax
from .metric import knn_join, matrix, scratch, smallest
from .quantiles import column_quantiles

#: Fitted vectors of up to so many bytes are sent to all tasks and searched there.
MAX_SENT = 32 << 20


def knn_mean_distance(queries: DataFrame, fit: DataFrame, key: str, vector: str, k: int, name: str = "knn_distance", block: int = 512) -> DataFrame:
    """Mean Euclidean distance of each query to its ``k`` nearest rows of ``fit`` (itself included, if it is one).

    ``k`` is at least 2 and at most the number of fitted rows. Fitted vectors of up to ``MAX_SENT`` bytes, which are counted first, go to all tasks, and
    queries stream past them in blocks. Beyond that ``knn_join`` deals both sides to cells and compares only those that bounds leave. Null vectors
    are no neighbours and have no distance.
    """
    size = fit.where(F.col(vector).isNotNull()).agg(F.count("*").alias("n"), F.sum(8 * F.size(vector)).alias("bytes")).first()
    n = size["n"]
    if not n:
        return queries.select(key, F.lit(None).cast("double").alias(name))
    k = max(2, min(k, n))
    if size["bytes"] > MAX_SENT:
        near = knn_join(queries, fit, key, vector, k)
        return near.select(key, (F.aggregate("distances", F.lit(0.0), lambda s, x: s + x) / F.size("distances")).alias(name))
    kind = queries.schema[key].dataType.simpleString()
    held = fit.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").toArrow().column("v").combine_chunks()
    y = held.values.to_numpy(zero_copy_only=False).reshape(n, -1)
    sent = queries.sparkSession.sparkContext.broadcast(y)
    k = min(k, n)

    def run(frames):
        y = sent.value
        for f in frames:
            out = np.full(len(f), np.nan)
            has = np.flatnonzero(f["v"].notna().to_numpy())
            for at in range(0, len(has), block):
                out[has[at : at + block]] = smallest(matrix(f["v"].iloc[has[at : at + block]]), y, k).sum(axis=1) / k
            yield pd.DataFrame({key: f["k"], name: pd.Series(out).where(f["v"].notna().to_numpy(), None)})

    return queries.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"`{key}` {kind}, `{name}` double")


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """The mean vector of each label, by position with partial sums."""
    long = df.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = long.groupBy(label, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c")).select(label, F.transform("c", lambda s: s["x"]).alias("centroid"))


def dense_centroids(df: DataFrame, label: str, vector: str, labels: list) -> list[list[float]]:
    """Of each of ``labels`` in order; one that no row has gets the mean of all."""
    own = {r[0]: r[1] for r in centroids(df, label, vector).collect()}
    whole = centroids(df.withColumn("__all", F.lit(0)), "__all", vector).first()["centroid"]
    return [own.get(x, whole) for x in labels]


def _literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def distances(vector: Column, centers: list[list[float]]) -> Column:
    """To each of a few centers, as an array."""
    return F.array(*[euclidean(vector, _literal(c)) for c in centers])


def similarities(vector: Column, prototypes: list[list[float]]) -> Column:
    """Cosines with each of a few prototypes; 0 for a zero vector."""
    return F.array(*[cosine(vector, _literal(p)) for p in prototypes])


def affinity(df: DataFrame, vector: str, centers: list[list[float]], name: str = "affinity") -> DataFrame:
    """Softmax of the negative distances to centers over the median of all distances (1 if that is 0). Distances are written once."""
    with_d = scratch(df.withColumn("__d", distances(F.col(vector), centers)), "distances")
    t = column_quantiles(with_d.select(F.explode("__d").alias("d")), ["d"], [0.5]).get("d", [0.0])[0] or 1.0
    return with_d.withColumn(name, softmax(F.transform("__d", lambda x: -x), t)).drop("__d")
