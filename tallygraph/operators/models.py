"""Trainable counterparts on pyspark.ml: forest importances, clusters and their quality, and a perceptron."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def balanced_weights(df: DataFrame) -> DataFrame:
    """df with w: n / (2 * rows of the label)."""
    n = df.groupBy("label").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    return df.join(F.broadcast(n.crossJoin(total).withColumn("w", F.col("_t") / (2.0 * F.col("_n"))).select("label", "w")), "label")


def forest_importance(df: DataFrame, columns: list[str], trees: int = 300, depth: int = 10, seed: int = 42) -> DataFrame:
    """feature, importance, most important first, of a forest on balanced weights."""
    model = RandomForestClassifier(labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors(balanced_weights(df), columns))
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def perceptron_scores(train: DataFrame, test: DataFrame, columns: list[str], hidden: int = 16, seed: int = 42) -> DataFrame:
    """edge_id, label, score of a trained perceptron."""
    model = MultilayerPerceptronClassifier(layers=[len(columns), hidden, 2], seed=seed, maxIter=50).fit(vectors(train, columns))
    return model.transform(vectors(test, columns)).select("edge_id", "label", vector_to_array("probability")[1].alias("score"))


def cluster_quality(df: DataFrame, columns: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """k, n, Calinski-Harabasz and Davies-Bouldin of k-means clusters (Euclidean), and silhouette by distance to centres."""
    data = vectors(df, columns)
    n = data.count()
    k = min(k, n - 1)
    model = KMeans(k=k, seed=seed).fit(data)
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    x = vector_to_array(F.col("features"))
    d = lambda c: F.sqrt(F.aggregate(F.zip_with(F.col("x"), F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    rows = model.transform(data).select(x.alias("x"), F.col("prediction").alias("c")).withColumn("d", F.array(*[d(c) for c in centres]))
    own = F.get("d", F.col("c"))
    other = F.array_min(F.filter(F.col("d"), lambda v, i: i != F.col("c")))
    per = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum(own * own).alias("w"), F.avg(own).alias("s"), F.avg(F.coalesce(F.try_divide(other - own, F.greatest(other, own)), F.lit(0.0))).alias("sil")).collect()
    import numpy as np

    c = np.array(centres)
    size, spread = np.array([next((r["n"] for r in per if r["c"] == j), 0) for j in range(k)]), np.array([next((r["s"] for r in per if r["c"] == j), 0.0) for j in range(k)])
    mean = (size[:, None] * c).sum(axis=0) / n
    between, within = float((size * ((c - mean) ** 2).sum(axis=1)).sum()), sum(r["w"] for r in per)
    ch = between / (k - 1) / (within / (n - k)) if k > 1 and within and n > k else None
    gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) + np.eye(k)
    db = float(np.mean([max((spread[i] + spread[j]) / gap[i, j] for j in range(k) if j != i) for i in range(k)])) if k > 1 else None
    sil = sum(r["sil"] * r["n"] for r in per) / n
    return df.sparkSession.createDataFrame([(k, n, ch, db, float(sil))], "k int, n long, calinski_harabasz double, davies_bouldin double, centre_silhouette double")
