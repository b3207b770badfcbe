"""Further queries: multi-label scores, linking, profiles and splits (survey A9, A13, A14, A26, A31, A32, F6, F7, F22, J13-J16, J24, M8, W11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.functions import text as T
from docweft.operators import linking, metrics, ranking
from docweft.plans.metrics import JUDGED, judged
from docweft.session import cut, table

MATCHED = """m AS (SELECT least(upper(trim(event_a)), upper(trim(event_b))) AS a, greatest(upper(trim(event_a)), upper(trim(event_b))) AS b, max(similarity) AS s FROM event_matches WHERE similarity IS NOT NULL AND upper(trim(event_a)) <> upper(trim(event_b)) GROUP BY 1, 2)"""


def matched(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.upper(F.trim("event_a")), F.upper(F.trim("event_b"))
    m = table(spark, d, "event_matches").filter("similarity is not null").filter(a != b)
    return m.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max("similarity").alias("similarity"))


@query(f"WITH {MATCHED}, u AS (SELECT a, b, s FROM m UNION ALL SELECT b, a, s FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM u) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, s AS similarity FROM r WHERE k <= 2")
def top_pairs_of_either(spark: SparkSession, d: str) -> DataFrame:
    """Pairs among the two most similar of either event."""
    return linking.top_k_either(matched(spark, d), 2)


EVENT1 = "e AS (SELECT event_id, lower(trim(main_verb)) AS verb, upper(event_type) AS type, lower(trim(regexp_replace(trigger_text, '\\s+', ' ', 'g'))) AS trig, CASE WHEN trim(time_normalized) <> '' THEN trim(time_normalized) END AS t FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at, md5(coalesce(evidence_text, ''))) AS k FROM ekg_events) WHERE k = 1)"


@query(f"""
    WITH {MATCHED}, {EVENT1} SELECT a, b, coalesce(x.verb = y.verb, false) AS same_verb, coalesce(x.type = y.type, false) AS same_type, coalesce(x.trig = y.trig, false) AS same_trigger, coalesce(x.t = y.t, false) AS same_time
    FROM m LEFT JOIN e x ON x.event_id = a LEFT JOIN e y ON y.event_id = b
""")
def shared_features(spark: SparkSession, d: str) -> DataFrame:
    """What the two events of each pair share."""
    e = table(spark, d, "ekg_events").withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("created_at", F.md5(F.coalesce("evidence_text", F.lit("")))))).filter("k = 1")
    return linking.pair_features(matched(spark, d), e).select("a", "b", "same_verb", "same_type", "same_trigger", "same_time")


@query()
def link_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Bucket and priority of each pair."""
    e = table(spark, d, "ekg_events").withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("created_at", F.md5(F.coalesce("evidence_text", F.lit("")))))).filter("k = 1")
    return linking.buckets(linking.pair_features(matched(spark, d), e)).select("a", "b", "bucket", "priority")


@query()
def degree_capped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of events of one document, accepted by similarity while both have fewer than two."""
    doc = table(spark, d, "ekg_events").groupBy("event_id").agg(F.min("doc_id").alias("doc_id"))
    m = matched(spark, d).join(doc.select(F.col("event_id").alias("a"), F.coalesce("doc_id", F.lit("")).alias("doc_id")), "a")
    return linking.cap_degrees(m.select("doc_id", "a", "b", "similarity"), "doc_id", 2)


@query(f"""
    WITH {JUDGED}, n AS (SELECT dataset_id, sum(CASE WHEN gold = 1 THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM j GROUP BY 1) SELECT dataset_id, round(CASE WHEN pos = 0 THEN 1 ELSE greatest(1, least(100, (n - pos) / pos)) END, 6) AS pos_weight FROM n
""")
def positive_weights(spark: SparkSession, d: str) -> DataFrame:
    n = judged(spark, d).groupBy("dataset_id").agg(F.count_if(F.col("gold") == 1).alias("pos"), F.count("*").alias("n"))
    return n.select("dataset_id", F.round(F.when(F.col("pos") == 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(100.0), (F.col("n") - F.col("pos")) / F.col("pos")))), 6).alias("pos_weight"))


KINDS_SQL = """g AS (SELECT DISTINCT doc_id, upper(event_type) AS label FROM ekg_events WHERE doc_id IS NOT NULL AND event_type IS NOT NULL), p AS (SELECT DISTINCT doc_id, CASE WHEN main_verb = 'fired' THEN 'TERMINATION' WHEN main_verb = 'hired' THEN 'HIRING' WHEN main_verb = 'paid' THEN 'PAYMENT' ELSE 'MEETING' END AS label FROM ekg_events WHERE doc_id IS NOT NULL AND main_verb IS NOT NULL)"""


@query(f"""
    WITH {KINDS_SQL}, x AS (SELECT coalesce(g.label, p.label) AS label, g.label IS NOT NULL AS y, p.label IS NOT NULL AS z FROM g FULL OUTER JOIN p ON g.doc_id = p.doc_id AND g.label = p.label), c AS (SELECT label, count(*) FILTER (y AND z) AS tp, count(*) FILTER (NOT y) AS fp, count(*) FILTER (NOT z) AS fn FROM x GROUP BY 1)
    SELECT label, tp, fp, fn, tp + fn AS support, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c
""")
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each label in a multi-label task: types of a document's events told from its verbs."""
    e = table(spark, d, "ekg_events").filter("doc_id is not null")
    g = e.filter("event_type is not null").select("doc_id", F.upper("event_type").alias("label")).distinct().withColumn("y", F.lit(True))
    rule = F.when(F.col("main_verb") == "fired", "TERMINATION").when(F.col("main_verb") == "hired", "HIRING").when(F.col("main_verb") == "paid", "PAYMENT").otherwise("MEETING")
    p = e.filter("main_verb is not null").select("doc_id", rule.alias("label")).distinct().withColumn("z", F.lit(True))
    c = g.join(p, ["doc_id", "label"], "full_outer").groupBy("label").agg(F.count_if(F.col("y") & F.col("z")).alias("tp"), F.count_if(F.col("y").isNull()).alias("fp"), F.count_if(F.col("z").isNull()).alias("fn"))
    pr, rc = metrics.share(F.col("tp"), F.col("tp") + F.col("fp")), metrics.share(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(metrics.f1(pr, rc), 6).alias("f1"))


@query("""
    WITH f AS (SELECT a, list(b ORDER BY s DESC, b)[1:3] AS top FROM (SELECT upper(trim(event_a)) AS a, upper(trim(event_b)) AS b, max(similarity) AS s FROM event_matches WHERE similarity IS NOT NULL AND event_a IS NOT NULL AND event_b IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    e AS (SELECT upper(trim(event_a)) AS a, list_distinct(list(upper(trim(event_b)))) AS want FROM event_matches WHERE same_event AND event_b IS NOT NULL GROUP BY 1), x AS (SELECT f.a, len(list_intersect(top, coalesce(want, []))) AS hit, len(top) AS n, len(coalesce(want, [])) AS w FROM f LEFT JOIN e USING (a))
    SELECT count(*) AS questions, round(avg(hit / n), 6) AS precision, round(avg(CASE WHEN w = 0 THEN 0 ELSE hit / w END), 6) AS recall, round(avg(CASE WHEN hit = w THEN 1 ELSE 0 END), 6) AS full_match FROM x
""")
def retrieval_at_3(spark: SparkSession, d: str) -> DataFrame:
    """How many confirmed matches are among the three most similar; no matches to find give recall 0 but a full match."""
    m = table(spark, d, "event_matches").filter("event_a is not null and event_b is not null").select(F.upper(F.trim("event_a")).alias("a"), F.upper(F.trim("event_b")).alias("b"), "similarity", "same_event")
    best = m.filter("similarity is not null").groupBy("a", "b").agg(F.max("similarity").alias("s")).withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).filter("k <= 3")
    f = best.groupBy("a").agg(F.collect_list("b").alias("top"))
    e = m.filter("same_event").groupBy("a").agg(F.collect_set("b").alias("want"))
    x = f.join(e, "a", "left").select(F.size(F.array_intersect("top", F.coalesce("want", F.array().cast("array<string>")))).alias("hit"), F.size("top").alias("n"), F.coalesce(F.size("want"), F.lit(0)).alias("w"))
    x = x.withColumn("w", F.greatest("w", F.lit(0)))
    return x.agg(F.count("*").alias("questions"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("precision"), F.round(F.avg(metrics.share(F.col("hit"), F.col("w"))), 6).alias("recall"), F.round(F.avg((F.col("hit") == F.col("w")).cast("double")), 6).alias("full_match"))


@query("""
    WITH c AS (SELECT e.*, CAST(right(e.doc_id, 8) AS BIGINT) % 4 AS cluster FROM ekg_events e WHERE doc_id IS NOT NULL), t AS (SELECT cluster, event_type, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, event_type) AS k FROM c WHERE event_type IS NOT NULL GROUP BY 1, 2)
    SELECT c.cluster, count(DISTINCT doc_id) AS docs, count(*) AS n, round(avg(CASE WHEN length(trim(coalesce(time_raw, ''))) > 0 THEN 1 ELSE 0 END), 6) AS timed, bool_or(coalesce(is_supporting_fact, false)) AS support, any_value(l.types) AS types
    FROM c JOIN (SELECT cluster, list(event_type ORDER BY k) AS types FROM t WHERE k <= 3 GROUP BY 1) l ON l.cluster = c.cluster GROUP BY 1
""")
def cluster_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Size, temporal share and commonest types of four groups of cases."""
    c = table(spark, d, "ekg_events").filter("doc_id is not null").withColumn("cluster", F.right("doc_id", F.lit(8)).try_cast("long") % 4)
    t = c.filter("event_type is not null").groupBy("cluster", "event_type").agg(F.count("*").alias("n"))
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "event_type"))).filter("k <= 3").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("k", "event_type"))).alias("l"))
    timed = F.when(T.missing(F.col("time_raw")).isNotNull(), 1).otherwise(0)
    p = c.groupBy("cluster").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n"), F.round(F.avg(timed), 6).alias("timed"), F.bool_or(F.coalesce("is_supporting_fact", F.lit(False))).alias("support"))
    return p.join(t, "cluster").select("cluster", "docs", "n", "timed", "support", F.col("l.event_type").alias("types"))


@query("""
    WITH s AS (SELECT case_id, sum(n_chars)::BIGINT AS n FROM documents WHERE case_id IS NOT NULL GROUP BY 1), o AS (SELECT *, sum(n) OVER (ORDER BY md5(case_id), case_id ROWS UNBOUNDED PRECEDING) - coalesce(n, 0) AS before, sum(n) OVER () AS tot FROM s)
    SELECT case_id, CASE WHEN before < 0.8 * tot THEN 'train' ELSE 'holdout' END AS split FROM o WHERE n IS NOT NULL
""")
def size_balanced_split(spark: SparkSession, d: str) -> DataFrame:
    """Cases in hash order to train until it has four fifths of the characters.

    Running totals are taken in 256 hash ranges first, so no window spans all cases.
    """
    s = table(spark, d, "documents").filter("case_id is not null").groupBy("case_id").agg(F.sum("n_chars").alias("n")).withColumn("h", F.md5("case_id")).withColumn("b", F.left("h", F.lit(2)))
    ranges = s.groupBy("b").agg(F.sum("n").alias("part"))
    w = Window.orderBy("b")
    ranges = ranges.select("b", F.coalesce(F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("tot"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("h", "case_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("own", own).join(F.broadcast(ranges), "b").filter("n is not null").select("case_id", F.when(F.col("base") + F.col("own") < 0.8 * F.col("tot"), "train").otherwise("holdout").alias("split"))


@query()
def hashed_bags(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of the questions in 64 cells."""
    return table(spark, d, "qa_items").select("idx", linking.hashed_bag(F.col("question"), 64).alias("bag"))


@query("""
    WITH n AS (SELECT doc_id, list(name ORDER BY length(name) DESC, name DESC) AS names FROM (SELECT DISTINCT doc_id, trim(name) AS name FROM entities WHERE length(trim(name)) > 3 AND doc_id IS NOT NULL) GROUP BY 1)
    SELECT DISTINCT c.chunk_id, len(list_filter(names, lambda x: contains(c.text, x))) AS n_names FROM chunks c JOIN n USING (doc_id) WHERE c.chunk_id IS NOT NULL AND c.text IS NOT NULL
""")
def names_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """How many of a case's names each of its chunks mentions."""
    n = table(spark, d, "entities").filter("length(trim(name)) > 3 and doc_id is not null").groupBy("doc_id").agg(F.collect_set(F.trim("name")).alias("names"))
    c = table(spark, d, "chunks").filter("chunk_id is not null and text is not null").select("doc_id", "chunk_id", "text")
    return c.join(n, "doc_id").select("chunk_id", F.size(F.filter("names", lambda x: F.contains("text", x))).cast("long").alias("n_names")).distinct()


@query()
def anonymised_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the names of their case as tags."""
    n = table(spark, d, "entities").filter("length(trim(name)) > 3 and doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.trim("name"))).alias("names"))
    c = table(spark, d, "chunks").filter("chunk_id is not null and text is not null").select("doc_id", "chunk_id", "text")
    return c.join(n, "doc_id").select("chunk_id", linking.anonymise(F.col("text"), F.col("names")).alias("text"))


@query("""
    WITH b AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS k FROM (SELECT DISTINCT chunk_id FROM chunks WHERE start_sentence_id = 1 AND chunk_id IS NOT NULL)), a AS (SELECT DISTINCT chunk_id FROM chunks WHERE theme IS NOT NULL AND chunk_id IS NOT NULL)
    SELECT coalesce(b.chunk_id, a.chunk_id) AS chunk_id, b.chunk_id IS NOT NULL AS in_first, a.chunk_id IS NOT NULL AS in_second FROM b FULL OUTER JOIN a ON a.chunk_id = b.chunk_id
""")
def chunk_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The union of two sets of chunks, with where each occurs."""
    c = table(spark, d, "chunks").filter("chunk_id is not null")
    b, a = c.filter("start_sentence_id = 1").select("chunk_id").distinct().withColumn("x", F.lit(True)), c.filter("theme is not null").select("chunk_id").distinct().withColumn("y", F.lit(True))
    return b.join(a, "chunk_id", "full_outer").select("chunk_id", F.col("x").isNotNull().alias("in_first"), F.col("y").isNotNull().alias("in_second"))


@query()
def spectral_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Four clusters of confirmed events by power iteration on their similarities."""
    from pyspark.ml.clustering import PowerIterationClustering

    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("long")
    g = matched(spark, d).select(number("a").alias("src"), number("b").alias("dst"), "similarity").filter("src is not null and dst is not null and similarity > 0 and src <> dst")
    if g.isEmpty():
        return spark.createDataFrame([], "cluster int, n long")
    return PowerIterationClustering(k=4, maxIter=10, weightCol="similarity").assignClusters(g).groupBy("cluster").agg(F.count("*").alias("n"))


def _event_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Events with what candidate pairs are told by: a bag of their words, who is named in their evidence, and where it stands."""
    from docweft.plans import retrieval as R

    e = ranking.latest(table(spark, d, "ekg_events").filter("doc_id is not null and event_id is not null"), ["doc_id", "event_id"], F.col("created_at"))
    e = e.select(
        "doc_id", "event_id", "evidence_text", F.lower(T.strip(F.col("main_verb"))).alias("main_verb"), F.upper("event_type").alias("event_type"), T.norm_text(F.col("trigger_text")).alias("trigger_text"), "time_normalized",
        linking.hashed_bag(F.concat_ws(" ", "event_type", "main_verb", "trigger_text", "evidence_text"), 64).alias("vector"), T.sentence_numbers(F.col("evidence_sentence_ids_json")).alias("sentences"),
    )
    people = R._mentions(e, table(spark, d, "entities").filter("doc_id is not null")).groupBy("doc_id", "event_id").agg(F.collect_set("entity_id").alias("participants"))
    # As event_chunks, by hashes of sentences and chunks: only whether two events share a chunk counts.
    ids = F.transform(F.regexp_extract_all("evidence_sentence_ids_json", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    at = table(spark, d, "ekg_events").filter("doc_id is not null and event_id is not null").select("event_id", "doc_id", F.explode(F.array_distinct(ids)).alias("sid"))
    stretch = lambda c: F.floor(F.col(c) / 16)  # noqa: E731  a row for 16 sentences of a chunk
    c = table(spark, d, "chunks").filter("doc_id is not null and chunk_id is not null and start_sentence_id <= end_sentence_id").select("doc_id", F.xxhash64("chunk_id").alias("chunk"), F.col("start_sentence_id").alias("first"), F.col("end_sentence_id").alias("last"))
    c = c.withColumn("stretch", F.explode(F.sequence(stretch("first"), stretch("last")))).select(F.xxhash64("doc_id", "stretch").alias("at"), "chunk", "first", "last")
    chunks = at.select("event_id", "sid", F.xxhash64("doc_id", stretch("sid")).alias("at")).join(c, "at").filter("sid between first and last").groupBy("event_id").agg(F.collect_set("chunk").alias("chunks"))
    return e.drop("evidence_text").join(people, ["doc_id", "event_id"], "left").join(chunks, "event_id", "left")


@query()
def event_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of events of a document that may be the same or related, from a self-join of each document's events. No SQL; tested against brute force."""
    return linking.candidate_pairs(_event_profiles(spark, d))


@query()
def rescued_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Further pairs by a lower floor, with an anchor and alike vectors."""
    e = cut(_event_profiles(spark, d))
    return linking.rescue_pairs(e, linking.candidate_pairs(e))
