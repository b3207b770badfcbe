"""Clusterings by restarts, their robustness, and vectors made for them: whitened and fused ones.

The silhouette is the one of squared distances, which takes one pass; trials are a loop over jobs, nothing of the data comes to the driver but scores.
Null vectors are left out; without any vectors the results are empty. Repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import cut


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def trials(df: DataFrame, key: str, vector: str, ks: list[int], seeds: list[int]) -> list[dict]:
    """For each k and seed the sizes of the clusters, the silhouette and the model; those that end with one cluster have silhouette -1."""
    x, out = cut(df.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))), []
    if x.isEmpty():
        return []
    x = _vectors(x, key, "v")
    for k in ks:
        for seed in seeds:
            model = KMeans(k=k, seed=seed, maxIter=20).fit(x)
            sizes = [n for n in model.summary.clusterSizes if n]
            score = ClusteringEvaluator().evaluate(model.transform(x)) if len(sizes) > 1 else -1.0
            out.append({"k": k, "seed": seed, "sizes": sizes, "silhouette": score, "model": model})
    return out


def balanced(df: DataFrame, key: str, vector: str, k: int, seeds: list[int], divisor: int = 3, most: float = 1.0) -> DataFrame:
    """(key, cluster) of the trial with the best silhouette among those whose clusters all have at least max(2, n // (divisor k)) rows and at most the share most;
    among all if none is so."""
    runs = trials(df, key, vector, [k], seeds)
    if not runs:
        return df.filter(F.col(vector).isNotNull()).select(key, F.lit(0).alias("cluster"))
    n = sum(runs[0]["sizes"])
    fair = [r for r in runs if len(r["sizes"]) == k and min(r["sizes"]) >= max(2, n // (divisor * k)) and max(r["sizes"]) <= most * n]
    best = max(fair or runs, key=lambda r: (r["silhouette"], -r["seed"]))
    return best["model"].transform(_vectors(df, key, vector)).select(key, F.col("prediction").alias("cluster"))


def robustness(df: DataFrame, key: str, vector: str, ks: list[int], seeds: list[int]) -> DataFrame:
    """(k, runs, mean, std, least, most) of the silhouette over the seeds, for each k."""
    rows = [(r["k"], r["seed"], float(r["silhouette"])) for r in trials(df, key, vector, ks, seeds)]
    t = df.sparkSession.createDataFrame(rows, "k int, seed int, s double")
    return t.groupBy("k").agg(F.count("*").alias("runs"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("least"), F.max("s").alias("most"))


def whiten(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, whitened): k principal components, each with mean 0 and variance 1 (n - 1). The sign of a component is arbitrary."""
    x = _vectors(df, key, vector)
    if x.isEmpty():
        return x.select(key, F.array().cast("array<double>").alias("whitened"))
    model = PCA(k=k, inputCol="features", outputCol="p").fit(x)
    scaled = StandardScaler(inputCol="p", outputCol="w", withMean=True, withStd=True).fit(p := model.transform(x)).transform(p)
    return scaled.select(key, vector_to_array("w").alias("whitened"))


def fused(parts: list[tuple[DataFrame, str, float]], key: str) -> DataFrame:
    """(key, fused): the vectors of all parts (table, column, weight) side by side, each coordinate standardised and weighted; keys that lack a part are left out."""
    out = None
    for n, (df, vector, weight) in enumerate(parts):
        x = _vectors(df, key, vector)
        if x.isEmpty():
            return x.select(key, F.array().cast("array<double>").alias("fused"))
        s = StandardScaler(inputCol="features", outputCol="s", withMean=True, withStd=True).fit(x).transform(x)
        s = s.withColumn("w", F.lit(float(weight))).select(key, F.transform(vector_to_array("s"), lambda v: v * F.col("w")).alias(f"__v{n}"))
        out = s if out is None else out.join(s, key)
    columns: list[Column] = [F.col(f"__v{n}") for n in range(len(parts))]
    return out.select(key, F.concat(*columns).alias("fused"))
