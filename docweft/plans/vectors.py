"""Queries on embeddings (survey F5, F31, A25-A27, W8, W15, W16, M1-M7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.operators import vectors
from docweft.session import table

CENTROIDS = "l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY 1, 2)"
DIST = f"{CENTROIDS}, t AS (SELECT vec_id, label, sqrt(sum((l.x - c.x) * (l.x - c.x))) AS dist FROM l JOIN c USING (label, pos) GROUP BY 1, 2)"


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 9) AS s FROM q JOIN e ON q.vec_id <> e.vec_id)
    SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 10
""")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all rows for every row whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    n = vectors.nearest(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return n.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CENTROIDS} SELECT label, pos::BIGINT AS pos, round(x, 6) AS x FROM c")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {DIST} SELECT label, vec_id, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(dist, 9), vec_id) AS rank FROM t) WHERE rank <= 3")
def nearest_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    t = e.join(F.broadcast(vectors.centroids(e, "label", "embedding")), "label").select("label", "vec_id", vectors.distance(F.col("embedding"), F.col("centroid")).alias("dist"))
    w = Window.partitionBy("label").orderBy(F.round("dist", 9), "vec_id")
    return t.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("label", "vec_id", F.round("dist", 6).alias("dist"), "rank")


@query(f"WITH {DIST}, q AS (SELECT label, quantile_cont(dist, 0.25) AS q25, quantile_cont(dist, 0.75) AS q75 FROM t GROUP BY 1) SELECT label, count(*) FILTER (dist > q75) AS far, count(*) FILTER (dist < q25) AS near, round(any_value(q75), 6) AS q75 FROM t JOIN q USING (label) GROUP BY 1")
def quartile_borderline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    t = e.join(F.broadcast(vectors.centroids(e, "label", "embedding")), "label").select("label", vectors.distance(F.col("embedding"), F.col("centroid")).alias("dist"))
    q = t.groupBy("label").agg(F.percentile("dist", 0.25).alias("q25"), F.percentile("dist", 0.75).alias("q75"))
    return t.join(F.broadcast(q), "label").groupBy("label").agg(F.count_if(F.col("dist") > F.col("q75")).alias("far"), F.count_if(F.col("dist") < F.col("q25")).alias("near"), F.round(F.first("q75"), 6).alias("q75"))


@query(f"""
    WITH {DIST}, s AS (SELECT label, avg(dist) AS s FROM t GROUP BY 1), m AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS m FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY 1, 2),
    r AS (SELECT a, max((p.s + q.s) / m) AS r FROM m JOIN s p ON p.label = a JOIN s q ON q.label = b GROUP BY 1) SELECT count(*) AS n_clusters, round(avg(r), 6) AS index FROM r
""")
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return vectors.davies_bouldin(table(spark, d, "embeddings"), "label", "embedding").select("n_clusters", F.round("index", 6).alias("index"))


@query("""
    WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY 1) SELECT vec_id, pos::BIGINT AS pos, round((x - m) / (sd + 1e-8), 5) AS value FROM l JOIN s USING (pos)
""")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    return vectors.standardise(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value"))


@query("""
    WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id, q.label AS own, e.label, avg(list_distance(q.v, e.v)) AS m FROM q, e GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, max(m) FILTER (label = own) AS a, min(m) FILTER (label <> own) AS b FROM p GROUP BY 1) SELECT vec_id, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) AS silhouette FROM s
""")
def silhouettes(spark: SparkSession, d: str) -> DataFrame:
    """Silhouettes of the rows whose id is divisible by 100 against all rows; a includes the row itself."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0")
    m = vectors.label_distances(e, q, "vec_id", "embedding", "label").select(F.col("query_id").alias("vec_id"), "label", F.col("mean").alias("m"))
    m = m.join(q.select("vec_id", F.col("label").alias("own")).distinct(), "vec_id")
    s = m.groupBy("vec_id").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("m"))).alias("a"), F.min(F.when(F.col("label") != F.col("own"), F.col("m"))).alias("b"))
    return s.select("vec_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round((F.col("b") - F.col("a")) / F.greatest("a", "b"), 6).alias("silhouette"))


@query(f"WITH {CENTROIDS}, a AS (SELECT l.vec_id, c.label, sum((l.x - c.x) * (l.x - c.x)) AS q FROM l JOIN c USING (pos) GROUP BY 1, 2), n AS (SELECT vec_id, arg_min(label, (round(q, 9), label)) AS nearest FROM a GROUP BY 1) SELECT label, nearest, count(*) AS n FROM n JOIN embeddings USING (vec_id) GROUP BY 1, 2")
def assignment_step(spark: SparkSession, d: str) -> DataFrame:
    """One assignment of k-means from the labels' centroids."""
    e = table(spark, d, "embeddings")
    c = vectors.centroids(e, "label", "embedding").select(F.col("label").alias("k"), "centroid")
    best = c.agg(F.sort_array(F.collect_list(F.struct("k", "centroid"))).alias("cs"))  # as many as there are labels
    dist = F.transform("cs", lambda x: F.struct(F.round(F.pow(vectors.distance(F.col("embedding"), x["centroid"]), 2), 9).alias("q"), x["k"].alias("k")))
    return e.crossJoin(F.broadcast(best)).select("label", F.array_min(dist)["k"].alias("nearest")).groupBy("label", "nearest").agg(F.count("*").alias("n"))


@query()
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by k-means with ten centres, and their sizes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=10, seed=7, maxIter=20).fit(x).transform(x).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query()
def pca(spark: SparkSession, d: str) -> DataFrame:
    """Eight principal components of each vector."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return PCA(k=8, inputCol="features", outputCol="p").fit(x).transform(x).select("vec_id", vector_to_array("p").alias("components"))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.v, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS k FROM q JOIN e ON q.vec_id <> e.vec_id),
    u AS (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1)::BIGINT - 1 AS pos FROM s WHERE k <= 5) SELECT query_id, pos, round(avg(x), 6) AS x FROM u GROUP BY 1, 2
""")
def neighbour_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of the five nearest neighbours of each query row."""
    e = table(spark, d, "embeddings")
    n = vectors.nearest(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    x = n.join(e.select(F.col("vec_id").alias("id"), "embedding"), "id").select("query_id", F.posexplode("embedding").alias("pos", "x"))
    return x.groupBy("query_id", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
