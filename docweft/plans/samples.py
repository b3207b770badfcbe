"""Queries that build data sets: vocabularies, weights, similar pairs, triplets (survey A23, A24, J13, J17, J18, W17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.functions import text as T
from docweft.operators import pairs
from docweft.session import table


@query("""
    WITH t AS (SELECT DISTINCT doc_id, event_type AS v, 'event' AS kind FROM ekg_events WHERE event_type IS NOT NULL UNION SELECT DISTINCT doc_id, kind, 'entity' FROM entities WHERE kind IS NOT NULL UNION SELECT DISTINCT doc_id, canonical_role, 'role' FROM entities WHERE canonical_role IS NOT NULL),
    f AS (SELECT kind, left(v, 96) AS label, count(DISTINCT doc_id) AS df FROM t GROUP BY 1, 2) SELECT kind, label, df, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY df DESC, label) AS rank FROM f) WHERE rank <= 5
""")
def vocabulary_topk(spark: SparkSession, d: str) -> DataFrame:
    """The labels that most documents have, five of each kind."""
    e, n = table(spark, d, "ekg_events"), table(spark, d, "entities")
    part = lambda x, c, k: x.filter(F.col(c).isNotNull()).select("doc_id", F.left(F.col(c), F.lit(96)).alias("label"), F.lit(k).alias("kind"))
    f = part(e, "event_type", "event").unionByName(part(n, "kind", "entity")).unionByName(part(n, "canonical_role", "role")).groupBy("kind", "label").agg(F.count_distinct("doc_id").alias("df"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("df"), "label")).cast("long")).filter("rank <= 5")


@query("""
    WITH w AS (SELECT idx, unnest(regexp_extract_all(lower(gold_passage), '[a-z][a-z0-9_]{2,}')) AS word FROM qa_items), c AS (SELECT idx, word, count(*) AS tf FROM w GROUP BY 1, 2), v AS (SELECT word, count(*) AS df FROM c GROUP BY 1 ORDER BY df DESC, word LIMIT 3000),
    x AS (SELECT idx, word, tf * ln((SELECT count(*) FROM qa_items) / df) AS w FROM c JOIN v USING (word)), s AS (SELECT idx, sqrt(sum(w * w)) AS size FROM x GROUP BY 1) SELECT idx, word, round(CASE WHEN size > 0 THEN w / size ELSE 0 END, 6) AS weight FROM x JOIN s USING (idx)
""")
def tf_idf_weights(spark: SparkSession, d: str) -> DataFrame:
    return pairs.tf_idf(table(spark, d, "qa_items"), "idx", "gold_passage").select("idx", "word", F.round("weight", 6).alias("weight"))


@query("""
    WITH e AS (SELECT event_id, list_sort(list_distinct(regexp_extract_all(lower(max(evidence_text)), '[a-z0-9_]+'))) AS t FROM ekg_events GROUP BY 1), k AS (SELECT * FROM e WHERE len(t) > 0), g AS (SELECT t, min(event_id) AS rep, count(*) AS copies FROM k GROUP BY 1),
    w AS (SELECT rep, len(t) AS n, unnest(t) AS w FROM g), o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS bo, any_value(a.n) AS na, any_value(b.n) AS nb FROM w a JOIN w b ON a.w = b.w AND a.rep < b.rep GROUP BY 1, 2),
    l AS (SELECT a, b FROM o WHERE bo / (na + nb - bo) >= 0.8 - 1e-12), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), n AS (SELECT a AS rep, sum(copies) AS others FROM u JOIN g ON g.rep = u.b GROUP BY 1)
    SELECT k.event_id, (coalesce(others, 0) + copies - 1)::BIGINT AS n_links FROM k JOIN g ON g.t = k.t LEFT JOIN n ON n.rep = g.rep
""")
def similar_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Links of each event to others whose evidence has four fifths of the words in common."""
    e = table(spark, d, "ekg_events").groupBy("event_id").agg(F.max("evidence_text").alias("x"))
    return pairs.jaccard_classes(e, "event_id", T.tokens(F.col("x"))).select("event_id", "n_links")


@query()
def similar_evidence_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of each event under the same links."""
    e = table(spark, d, "ekg_events").groupBy("event_id").agg(F.max("evidence_text").alias("x"))
    return pairs.jaccard_classes(e, "event_id", T.tokens(F.col("x")))


@query("""
    WITH e AS (SELECT doc_id, event_type AS item FROM ekg_events WHERE doc_id IS NOT NULL AND event_type IS NOT NULL), c AS (SELECT doc_id, item, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT doc_id, sum(n) AS tot FROM c GROUP BY 1),
    b AS (SELECT p.doc_id AS query_id, q.doc_id AS id, sum(least(p.n, q.n)) AS bo FROM c p JOIN c q ON p.item = q.item AND p.doc_id <> q.doc_id WHERE CAST(right(p.doc_id, 8) AS BIGINT) % 100 = 0 GROUP BY 1, 2)
    SELECT query_id, id, round(bo / (x.tot + y.tot - bo), 6) AS score FROM b JOIN t x ON x.doc_id = query_id JOIN t y ON y.doc_id = id
""")
def case_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Weighted overlap of event types of the cases whose number is divisible by 100 with all cases."""
    e = table(spark, d, "ekg_events").filter("doc_id is not null and event_type is not null").select("doc_id", "event_type")
    s = pairs.multiset_jaccard(e.filter(F.right("doc_id", F.lit(8)).cast("long") % 100 == 0), e, "doc_id", "event_type")
    return s.select("query_id", "id", F.round("score", 6).alias("score"))


@query("""
    WITH m AS (SELECT DISTINCT pair_id, upper(trim(event_a)) AS a, upper(trim(event_b)) AS b, similarity, same_event FROM event_matches WHERE similarity IS NOT NULL AND same_event IS NOT NULL), d AS (SELECT a, b, max(similarity) AS s, bool_or(same_event) AS y FROM m WHERE a <> b GROUP BY 1, 2)
    SELECT a, arg_max(b, (s, b)) FILTER (y) AS positive, arg_max(b, (s, b)) FILTER (NOT y) AS negative FROM d GROUP BY 1 HAVING count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0
""")
def triplets(spark: SparkSession, d: str) -> DataFrame:
    """For each event its most similar match and its most similar other event: anchor, positive and hardest negative."""
    a, b = F.upper(F.trim("event_a")), F.upper(F.trim("event_b"))
    m = table(spark, d, "event_matches").filter("similarity is not null and same_event is not null").select(a.alias("a"), b.alias("b"), "similarity", "same_event").filter("a <> b")
    m = m.groupBy("a", "b").agg(F.max("similarity").alias("s"), F.bool_or("same_event").alias("y"))
    pick = lambda y: F.max(F.when(F.col("y") == y, F.struct("s", "b")))["b"]
    return m.groupBy("a").agg(pick(True).alias("positive"), pick(False).alias("negative")).filter("positive is not null and negative is not null")


@query("""
    WITH m AS (SELECT pair_id, max(similarity) AS s, max(CASE WHEN similarity >= 0.7 THEN 1 ELSE 0 END) AS dup FROM event_matches WHERE similarity IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY dup ORDER BY s DESC, pair_id) AS k, count(*) OVER (PARTITION BY dup) AS n FROM m),
    q AS (SELECT least(67, (SELECT count(*) FROM m WHERE dup = 0)) AS rel, least(33, (SELECT count(*) FROM m WHERE dup = 1)) AS dup) SELECT pair_id, CASE WHEN r.dup = 1 THEN 'duplicate' ELSE 'relation' END AS bucket FROM r, q WHERE (r.dup = 1 AND k <= q.dup + (100 - q.rel - q.dup)) OR (r.dup = 0 AND k <= q.rel + CASE WHEN q.dup < 33 THEN 100 - q.rel - q.dup ELSE 0 END)
""")
def quota_selection(spark: SparkSession, d: str) -> DataFrame:
    """A hundred pairs, 67 for relations and 33 for duplicates, refilled from the other bucket where one runs short."""
    m = table(spark, d, "event_matches").filter("similarity is not null").groupBy("pair_id").agg(F.max("similarity").alias("s"), F.max((F.col("similarity") >= 0.7).cast("int")).alias("dup"))
    n = F.broadcast(m.agg(F.least(F.lit(67), F.count_if(F.col("dup") == 0)).alias("rel"), F.least(F.lit(33), F.count_if(F.col("dup") == 1)).alias("dups")))
    k = F.row_number().over(Window.partitionBy("dup").orderBy(F.desc("s"), "pair_id"))
    spare = 100 - F.col("rel") - F.col("dups")
    x = m.withColumn("k", k).filter("k <= 100").crossJoin(n)
    keep = F.when(F.col("dup") == 1, F.col("k") <= F.col("dups") + spare).otherwise(F.col("k") <= F.col("rel") + F.when(F.col("dups") < 33, spare).otherwise(0))
    return x.filter(keep).select("pair_id", F.when(F.col("dup") == 1, "duplicate").otherwise("relation").alias("bucket"))
