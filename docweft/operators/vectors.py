"""Operators on vectors (array<double> or array<float>): normal forms, nearest neighbours, centroids and cluster validity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are held in a worker at once; more are searched in further blocks.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors and for unequal lengths."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(F.coalesce(ok, F.lit(False)), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def l2_normalise(a: Column) -> Column:
    n = norm(a) + 1e-8
    return F.transform(a, lambda x: x / n)


def standardise(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, value): each coordinate less its mean, over its population deviation plus 1e-8."""
    long = df.select(key, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    stats = long.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))  # one row a coordinate
    return long.join(F.broadcast(stats), "pos").select(key, "pos", ((F.col("x") - F.col("m")) / (F.col("s") + 1e-8)).alias("value"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid, n): means of the vectors of a label, summed before the shuffle."""
    long = df.filter(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("pos", "x"))
    m = long.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return m.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("centroid"), F.max("n").alias("n"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def _against(ids: np.ndarray, q: np.ndarray, k: int, unit: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top_s, top_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            keys, x = pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64)
            if unit:
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
                s = q @ x.T
            else:
                s = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0))
            s = np.round(s, 9)
            s[ids[:, None] == keys[None, :]] = -np.inf
            s, i = np.concatenate([top_s, s], 1), np.concatenate([top_i, np.broadcast_to(keys, (len(ids), len(keys)))], 1)
            best = np.lexsort((i, -s), axis=1)[:, :k]
            top_s, top_i = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        q_at, slot = np.nonzero(top_s > -np.inf)
        yield pd.DataFrame({"query_id": ids[q_at], "id": top_i[q_at, slot], "score": top_s[q_at, slot]})

    return run


def nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, measure: str = "cosine") -> DataFrame:
    """(query_id, id, score, rank): the k nearest of all rows for each query, itself left out; ties by id.

    Exact: blocks of queries go to all partitions, which keep k candidates a query each. measure: cosine, or euclidean (score is minus the distance).
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    out, unit = None, measure == "cosine"
    held: list = []

    def search(block: list) -> DataFrame:
        ids, x = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
        if unit:
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return rows.mapInPandas(_against(ids, x, k, unit), "query_id long, id long, score double")

    for r in q.toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            out, held = (search(held) if out is None else out.unionByName(search(held))), []
    if held or out is None:
        part = search(held) if held else rows.limit(0).selectExpr("id as query_id", "id", "0.0D as score")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _label_sums(ids: np.ndarray, q: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for label, part in pdf.groupby("label", dropna=False):
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)).sum(1)
                label = None if pd.isna(label) else label
                total, n = sums.get(label, (0.0, 0))
                sums[label] = (total + d, n + len(part))
        for label, (total, n) in sums.items():
            yield pd.DataFrame({"query_id": ids, "label": [label] * len(ids), "total": total, "n": n})

    return run


def label_distances(df: DataFrame, queries: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(query_id, label, mean, n): the mean Euclidean distance of each query to all rows of each label, itself included.

    Blocks of queries go to all partitions, which send one sum for each query and label; no pair leaves a task. Null vectors are left out.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).alias("v"))
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    schema = f"query_id long, label {dict(rows.dtypes)['label']}, total double, n long"
    out, held = None, []

    def flush() -> None:
        nonlocal out, held
        ids, x = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)
        part = rows.mapInPandas(_label_sums(ids, x), schema)
        out, held = (part if out is None else out.unionByName(part)), []

    for r in q.toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            flush()
    if held:
        flush()
    if out is None:
        out = rows.limit(0).select(F.lit(0).cast("long").alias("query_id"), "label", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"))
    return out.groupBy("query_id", "label").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def davies_bouldin(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row (n_clusters, index): the mean over clusters of the worst ratio of scatter to centroid distance. Clusters are few."""
    c = centroids(df, label, vector)
    s = df.join(F.broadcast(c), label).groupBy(label).agg(F.avg(distance(F.col(vector), F.col("centroid"))).alias("s"), F.first("centroid").alias("c"))
    a, b = s.select(F.col(label).alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca")), s.select(F.col(label).alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb"))
    pairs = a.join(F.broadcast(b), F.col("a") != F.col("b")).groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / distance(F.col("ca"), F.col("cb"))).alias("r"))
    return pairs.agg(F.count("*").alias("n_clusters"), F.avg("r").alias("index"))
