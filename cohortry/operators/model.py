"""Clusterings, projections and classifiers of Spark ML, composed as the pipelines need them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import expectation_maximization, lloyd, text_embedding
from .metric import scratch, ward_clusters


def with_vector(df: DataFrame, array: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(array).cast("array<double>")))


def _keyed(df: DataFrame, array: str, key: str | None) -> DataFrame:
    """(id, v), written; without a key the vector itself stands for it."""
    v = F.col(array).cast("array<double>")
    return scratch(df.select((F.col(key) if key else F.to_json(F.struct(v))).alias("id"), v.alias("v")).where("v is not null"), "vectors")


def kmeans(df: DataFrame, array: str, k: int, seeds: tuple[int, ...] = (13, 47, 97), name: str = "cluster", key: str | None = None, rounds: int = 100):
    """The best of several starts by the summed squared distance: (centers, rows with ``name``). Starts are drawn by hashes of ``key``."""
    rows = _keyed(df, array, key)
    best = min((lloyd(rows, k, s, rounds) for s in seeds), key=lambda m: m.cost)
    return best, best.transform(df, array, name)


def pca(df: DataFrame, array: str, k: int, name: str = "projected") -> DataFrame:
    rows = with_vector(df, array)
    model = PCA(k=k, inputCol="features", outputCol="__p").fit(rows)
    return model.transform(rows).withColumn(name, vector_to_array("__p")).drop("features", "__p")


def gaussian_mixture(df: DataFrame, array: str, k: int, seed: int = 42, name: str = "cluster", key: str | None = None, rounds: int = 100) -> DataFrame:
    """Rows with the most likely component of a mixture of full covariances."""
    return expectation_maximization(_keyed(df, array, key), k, seed, rounds).transform(df, array, name)


def bisecting(df: DataFrame, key: str, array: str, k: int, seed: int = 42, name: str = "cluster") -> DataFrame:
    """Divisive clustering by repeated two-means, distributed, for any number of rows."""
    rows = with_vector(df, array)
    return BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol=name).fit(rows).transform(rows).drop("features")


def ward(df: DataFrame, key: str, array: str, k: int, name: str = "cluster", local: int = 2000) -> DataFrame:
    """Agglomerative clustering by Ward's criterion, for any number of rows: rounds in which all clusters that choose each other merge.

    See ``metric.ward_clusters``; ``local`` clusters at most are merged in one piece at the end.
    """
    got = ward_clusters(df, key, array, k, local)
    return df.join(got.withColumnRenamed("cluster", name), key)


def tfidf_svd(df: DataFrame, key: str, text: str, components: int = 128, min_df: int = 2, vocabulary: int = 12_000, name: str = "embedding") -> DataFrame:
    """Words and word pairs by smoothed inverse frequency, unit rows, projected to the first singular vectors, unit again; see ``cluster``."""
    return text_embedding(df, key, text, components, min_df, vocabulary, name)


def classifier(kind: str = "mlp", inputs: int = 0, classes: int = 2, seed: int = 42, weight: str | None = None):
    """An unfitted classifier over ``features`` and ``label``: "mlp", "logistic" (takes weights) or "forest"."""
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[inputs, 64, 64, classes], seed=seed, maxIter=60, featuresCol="features", labelCol="label")
    if kind == "logistic":
        m = LogisticRegression(featuresCol="features", labelCol="label", maxIter=100, regParam=1e-3, family="multinomial")
        return m.setWeightCol(weight) if weight else m
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=50, seed=seed)


def cross_validate(df: DataFrame, array: str, label: str, fold: str, make) -> DataFrame:
    """Out-of-fold rows with ``probs`` and ``prediction``: a model for each fold, fitted on the others."""
    rows = with_vector(df, array).withColumn("label", F.col(label).cast("double"))
    out = None
    for (k,) in sorted(rows.select(fold).distinct().collect()):
        fitted = make().fit(rows.where(F.col(fold) != k))
        one = fitted.transform(rows.where(F.col(fold) == k)).withColumn("probs", vector_to_array("probability"))
        one = one.withColumn("prediction", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "label")
        out = one if out is None else out.unionByName(one)
    return out


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


__all__ = ["bisecting", "classifier", "cross_validate", "gaussian_mixture", "kmeans", "load", "pca", "save", "tfidf_svd", "ward", "with_vector"]
