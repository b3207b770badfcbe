"""Queries of smaller operators (survey S18, A33-A36, F13, F33, F34, W19, M2, M5, M6, M12, U11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.functions import text as T
from docweft.operators import chunking, clusters, prompts
from docweft.session import table


@query("""
    WITH c AS (SELECT doc_id, chunk_id, max(text) AS t, max(start_sentence_id) AS s FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT doc_id, string_agg(t, ' ' ORDER BY s NULLS FIRST, chunk_id) AS t FROM c GROUP BY 1) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM d WHERE length(trim(t)) >= 100
""")
def texts_with_floor(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each document joined by blanks, documents under 100 characters left out."""
    c = table(spark, d, "chunks").filter("doc_id is not null and chunk_id is not null and text is not null").groupBy("doc_id", "chunk_id").agg(F.max("text").alias("t"), F.max("start_sentence_id").alias("s"))
    joined = c.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "chunk_id", "t"))), lambda x: x["t"]), " ").alias("t"))
    return joined.filter(F.length(F.trim("t")) >= 100).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query(f"""
    WITH f AS (SELECT DISTINCT file, sections FROM processed_filings WHERE file IS NOT NULL), s AS (SELECT file, generate_subscripts(sections, 1) AS section_no, unnest(sections) AS x FROM f),
    r AS (SELECT file, section_no, x.name AS name, generate_subscripts(x.sentences, 1) AS sentence_no, unnest(x.sentences) AS sentence FROM s),
    n AS (SELECT *, coalesce({NORM.format('name')}, '') AS form, {NORM.format('sentence')} AS same FROM r),
    o AS (SELECT file, form, same, min((section_no, sentence_no, sentence)) AS p FROM n WHERE length(same) >= 10 GROUP BY 1, 2, 3)
    SELECT file, form, count(*) AS n, md5(string_agg(p[3], chr(10) ORDER BY p)) AS digest FROM o GROUP BY 1, 2
""")
def merged_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a filing that have the same name, as one."""
    f = table(spark, d, "processed_filings").filter("file is not null").distinct().select("file", F.posexplode("sections").alias("section_no", "x"))
    rows = f.select("file", "section_no", F.col("x.name").alias("name"), F.posexplode("x.sentences").alias("sentence_no", "sentence"))
    m = chunking.merge_sections(rows, "file")
    return m.select("file", "form", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "\n")).alias("digest"))


@query("""
    WITH c AS (SELECT doc_id, chunk_id, max(text) AS t, max(start_sentence_id) AS s FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2), k AS (SELECT DISTINCT doc_id FROM c ORDER BY 1 LIMIT 50)
    SELECT doc_id, count(*) AS n, md5(string_agg(t, chr(10) || chr(10) ORDER BY s NULLS FIRST, chunk_id)) AS digest FROM c JOIN k USING (doc_id) GROUP BY 1
""")
def case_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages of the first fifty cases in order, parted by blank lines."""
    c = table(spark, d, "chunks").filter("doc_id is not null and chunk_id is not null and text is not null").groupBy("doc_id", "chunk_id").agg(F.max("text").alias("t"), F.max("start_sentence_id").alias("s"))
    first = c.select("doc_id").distinct().orderBy("doc_id").limit(50)
    rows = c.join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", "chunk_id", "t"))).alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).alias("digest"))


@query("""
    WITH e AS (SELECT DISTINCT doc_id, upper(event_type) AS t FROM ekg_events WHERE doc_id IS NOT NULL AND event_type IS NOT NULL), v AS (SELECT list(DISTINCT t ORDER BY t) AS v FROM e), l AS (SELECT doc_id, list(t) AS l FROM e GROUP BY 1)
    SELECT doc_id, list_transform(v, lambda x: list_contains(l, x)::INTEGER) AS hot FROM l, v
""")
def multi_hot_types(spark: SparkSession, d: str) -> DataFrame:
    """Which types of events each document has, as 0 and 1; types are a handful."""
    e = table(spark, d, "ekg_events").filter("doc_id is not null and event_type is not null").select("doc_id", F.upper("event_type").alias("t")).distinct()
    v = e.agg(F.array_sort(F.collect_set("t")).alias("v"))
    return e.groupBy("doc_id").agg(F.collect_set("t").alias("l")).crossJoin(F.broadcast(v)).select("doc_id", T.multi_hot(F.col("l"), F.col("v")).alias("hot"))


@query("SELECT doc_id, count(*) AS n_chunks, count(DISTINCT theme) AS n_themes, round(avg(length(text)), 6) AS mean_chars, sum(end_sentence_id - start_sentence_id + 1)::BIGINT AS n_sentences FROM (SELECT DISTINCT * FROM chunks) GROUP BY 1")
def chunk_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").distinct().groupBy("doc_id")
    return c.agg(F.count("*").alias("n_chunks"), F.count_distinct("theme").alias("n_themes"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.sum(F.col("end_sentence_id") - F.col("start_sentence_id") + 1).cast("long").alias("n_sentences"))


@query("""
    WITH f AS (SELECT doc_id, upper(event_type) AS t, min((created_at, event_id)) AS p FROM ekg_events WHERE doc_id IS NOT NULL AND event_type IS NOT NULL AND created_at IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2)
    SELECT doc_id, list(t ORDER BY p) AS kinds FROM f GROUP BY 1
""")
def kinds_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Distinct types of events of each document, in the order in which they first come."""
    e = table(spark, d, "ekg_events").filter("doc_id is not null and event_type is not null and created_at is not null and event_id is not null")
    first = e.groupBy("doc_id", F.upper("event_type").alias("t")).agg(F.min(F.struct("created_at", "event_id")).alias("p"))
    return first.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]).alias("kinds"))


@query("""
    SELECT case_id, fetched_at, nullif(replace(regexp_extract(lower(docket_number), '([0-9]+[-_]cv[-_][0-9]+)', 1), '_', '-'), '') AS docket, regexp_replace(absolute_url, '[?#].*$', '') AS path, regexp_replace(absolute_url, '#.*$', '') || '?page=2' AS page
    FROM courtlistener_recap WHERE absolute_url IS NULL OR NOT contains(absolute_url, '?')
""")
def docket_urls(spark: SparkSession, d: str) -> DataFrame:
    """Dockets by their mark cv, and the paths and second pages of relative URLs."""
    r = table(spark, d, "courtlistener_recap").filter("absolute_url is null or not contains(absolute_url, '?')")
    return r.select("case_id", "fetched_at", T.case_docket(F.col("docket_number")).alias("docket"), T.url_path(F.col("absolute_url")).alias("path"), T.url_page(F.col("absolute_url"), F.lit(2)).alias("page"))


@query("SELECT event_a, count(*) AS n, round(avg(CASE WHEN same_event THEN similarity WHEN NOT same_event THEN 1 - similarity END), 6) AS membership FROM event_matches GROUP BY 1")
def memberships(spark: SparkSession, d: str) -> DataFrame:
    """The mean signed confidence of an event's matches, of those that have one."""
    m = table(spark, d, "event_matches")
    return m.groupBy("event_a").agg(F.count("*").alias("n"), F.round(F.avg(T.signed_confidence(F.col("same_event"), F.col("similarity"))), 6).alias("membership"))


@query()
def balanced_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The best of four runs of k-means whose clusters are not too small. No SQL; tested by its properties."""
    return clusters.balanced(table(spark, d, "embeddings"), "vec_id", "embedding", 10, [1, 2, 3, 4])


@query()
def cluster_robustness(spark: SparkSession, d: str) -> DataFrame:
    return clusters.robustness(table(spark, d, "embeddings"), "vec_id", "embedding", [5, 10], [1, 2, 3])


@query()
def whitened(spark: SparkSession, d: str) -> DataFrame:
    return clusters.whiten(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query()
def fused_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and their whitened components side by side, the latter with half the weight."""
    e = table(spark, d, "embeddings")
    return clusters.fused([(e, "embedding", 1.0), (clusters.whiten(e, "vec_id", "embedding", 8), "whitened", 0.5)], "vec_id")


@query()
def question_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each held-out question from the events that graph_retrieval finds, with entities and chunks of their documents."""
    from docweft.plans.retrieval import graph_retrieval

    hits = graph_retrieval(spark, d).select("idx", "rank", "doc_id", "event_id")
    e = table(spark, d, "ekg_events").filter("event_id is not null").groupBy("doc_id", "event_id").agg(F.max("event_type").alias("event_type"), F.max("evidence_text").alias("text"))
    hits = hits.join(e, ["doc_id", "event_id"])
    docs = hits.select("idx", "doc_id").distinct()
    entities = docs.join(table(spark, d, "entities"), "doc_id").select("idx", "entity_id", "name").distinct()
    chunks = docs.join(table(spark, d, "chunks").filter("chunk_id is not null"), "doc_id").groupBy("idx", "chunk_id").agg(F.max("text").alias("text"))
    questions = table(spark, d, "qa_items").filter("idx is not null and question is not null").select("idx", "question")
    edges = hits.select("idx", F.col("event_id").alias("a"), F.lit("IN").alias("relation"), F.col("doc_id").alias("b"))
    return prompts.build(questions, hits, edges, entities, chunks)
