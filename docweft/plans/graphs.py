"""Queries on event graphs (survey A1-A6, J4, J5, J20, M9-M11, F30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.functions import text as T
from docweft.operators import graphs
from docweft.plans.retrieval import PAIRS
from docweft.session import table


@query(f"WITH {PAIRS} SELECT src AS id, count(*) AS degree FROM u GROUP BY 1")
def edge_degree(spark: SparkSession, d: str) -> DataFrame:
    return graphs.degree(graphs.match_edges(table(spark, d, "event_matches")))


@query(f"WITH RECURSIVE {PAIRS}, r AS (SELECT src, dst FROM u UNION SELECT r.src, u.dst FROM r JOIN u ON u.src = r.dst) SELECT src AS id, least(src, min(dst)) AS component FROM r GROUP BY 1")
def match_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.components(graphs.match_edges(table(spark, d, "event_matches")))


@query()
def cyclic_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that lie on, or between, cycles when all are read as directed from event_a to event_b."""
    m = table(spark, d, "event_matches").filter("same_event").select(F.upper(T.strip(F.col("event_a"))).alias("a"), F.upper(T.strip(F.col("event_b"))).alias("b"))
    return graphs.on_cycles(m)


@query("""
    WITH e AS (SELECT DISTINCT doc_id, entity_id, name, CASE WHEN length(trim(coalesce(name, ''))) > 0 THEN lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) ELSE chr(0) || entity_id END AS form FROM entities)
    SELECT DISTINCT doc_id, entity_id, min(entity_id) OVER (PARTITION BY doc_id, form) AS merged_id FROM e WHERE doc_id IS NOT NULL
""")
def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    return graphs.merge_entities(table(spark, d, "entities").filter("doc_id is not null"))


@query("""
    WITH e AS (SELECT DISTINCT doc_id, event_id, upper(event_type) AS t, lower(trim(regexp_replace(main_verb, '\\s+', ' ', 'g'))) AS v, coalesce(time_kind, '') AS k, coalesce(time_normalized, '') AS n, coalesce(evidence_sentence_ids_json, '') AS s FROM ekg_events WHERE doc_id IS NOT NULL)
    SELECT doc_id, event_id, min(event_id) OVER w AS merged_id, count(*) OVER w AS n_refs FROM e WINDOW w AS (PARTITION BY doc_id, t, v, k, n, s)
""")
def merged_events(spark: SparkSession, d: str) -> DataFrame:
    return graphs.merge_events(table(spark, d, "ekg_events").filter("doc_id is not null"))


@query("""
    WITH e AS (SELECT doc_id, count(*) AS rows, count(DISTINCT event_id) AS events, count(DISTINCT (upper(event_type), lower(trim(regexp_replace(main_verb, '\\s+', ' ', 'g'))), coalesce(time_kind, ''), coalesce(time_normalized, ''), coalesce(evidence_sentence_ids_json, ''))) AS merged FROM ekg_events WHERE doc_id IS NOT NULL GROUP BY 1)
    SELECT doc_id, rows, events, merged, greatest(0, events - merged) AS collapsed FROM e
""")
def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ekg_events").filter("doc_id is not null")
    rows = e.groupBy("doc_id").agg(F.count("*").alias("rows"))
    m = graphs.merge_events(e).groupBy("doc_id").agg(F.count_distinct("event_id").alias("events"), F.count_distinct("merged_id").alias("m1"))
    form = F.struct(F.upper("event_type"), T.norm_text(F.col("main_verb")), F.coalesce("time_kind", F.lit("")), F.coalesce("time_normalized", F.lit("")), F.coalesce("evidence_sentence_ids_json", F.lit("")))
    k = e.select("doc_id", F.sha2(F.to_json(form), 256).alias("f")).distinct().groupBy("doc_id").agg(F.count("*").alias("merged"))
    return rows.join(m, "doc_id").join(k, "doc_id").select("doc_id", "rows", "events", "merged", F.greatest(F.lit(0), F.col("events") - F.col("merged")).alias("collapsed"))


COMPONENTS = "r AS (SELECT src, dst FROM u UNION SELECT r.src, u.dst FROM r JOIN u ON u.src = r.dst), c AS (SELECT src AS id, least(src, min(dst)) AS component FROM r GROUP BY 1)"


@query(f"""
    WITH RECURSIVE {PAIRS}, {COMPONENTS}, x AS (SELECT DISTINCT upper(trim(event_a)) AS a, upper(trim(event_b)) AS b, CASE WHEN same_event THEN 'SAME' WHEN NOT same_event THEN 'OTHER' ELSE 'OPEN' END AS relation FROM event_matches)
    SELECT DISTINCT coalesce(p.component, a) AS a, coalesce(q.component, b) AS b, relation FROM x LEFT JOIN c p ON p.id = a LEFT JOIN c q ON q.id = b WHERE coalesce(p.component, a) <> coalesce(q.component, b)
""")
def collapsed_edges(spark: SparkSession, d: str) -> DataFrame:
    """All pairs after events of one group became one: loops go, repeats merge."""
    m = table(spark, d, "event_matches")
    groups = graphs.components(graphs.match_edges(m))
    relation = F.when(F.col("same_event"), "SAME").when(~F.col("same_event"), "OTHER").otherwise("OPEN")
    edges = m.select(F.upper(T.strip(F.col("event_a"))).alias("a"), F.upper(T.strip(F.col("event_b"))).alias("b"), relation.alias("relation"))
    return graphs.remap(edges, groups)


@query("""
    WITH e AS (SELECT event_id, any_value(time_normalized ORDER BY created_at, time_normalized) AS t FROM (SELECT * FROM ekg_events WHERE regexp_matches(time_normalized, '^\\d{4}-\\d{2}-\\d{2}$')) GROUP BY 1),
    m AS (SELECT DISTINCT upper(trim(event_a)) AS a, upper(trim(event_b)) AS b FROM event_matches)
    SELECT count(*) AS n, count(*) FILTER (x.t > y.t) AS bad FROM m LEFT JOIN e x ON x.event_id = a LEFT JOIN e y ON y.event_id = b
""")
def date_consistency(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs, read as BEFORE, contradict their dates."""
    e = table(spark, d, "ekg_events").filter(F.col("time_normalized").rlike(r"^\d{4}-\d{2}-\d{2}$")).groupBy("event_id").agg(F.min_by("time_normalized", F.struct("created_at", "time_normalized")).alias("t"))
    m = table(spark, d, "event_matches").select(F.upper(T.strip(F.col("event_a"))).alias("a"), F.upper(T.strip(F.col("event_b"))).alias("b")).distinct()
    m = m.join(e.select(F.col("event_id").alias("a"), F.col("t").alias("ta")), "a", "left").join(e.select(F.col("event_id").alias("b"), F.col("t").alias("tb")), "b", "left")
    return m.agg(F.count("*").alias("n"), F.count_if(~graphs.consistent_order(F.col("ta"), F.lit("BEFORE"), F.col("tb"))).alias("bad"))


@query("""
    WITH n AS (SELECT doc_id, count(DISTINCT entity_id) AS ne FROM entities WHERE doc_id IS NOT NULL GROUP BY 1), v AS (SELECT doc_id, count(DISTINCT event_id) AS nv, count(DISTINCT event_id) FILTER (length(trim(coalesce(time_raw, ''))) > 0) AS nt FROM ekg_events WHERE doc_id IS NOT NULL GROUP BY 1)
    SELECT doc_id, round(ln(1 + coalesce(ne, 0)), 6) AS f1, round(ln(1 + coalesce(nv, 0)), 6) AS f2, round(ln(1 + coalesce(nt, 0)), 6) AS f3, round(coalesce(nt, 0) / greatest(1, coalesce(nv, 0)), 6) AS temporal_ratio, round(coalesce(nt, 0) / greatest(1, coalesce(ne, 0) + coalesce(nv, 0)), 6) AS density FROM n FULL OUTER JOIN v USING (doc_id)
""")
def graph_features(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "entities").filter("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("entity_id").alias("ne"))
    timed = F.when(T.missing(F.col("time_raw")).isNotNull(), F.col("event_id"))
    v = table(spark, d, "ekg_events").filter("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("event_id").alias("nv"), F.count_distinct(timed).alias("nt"))
    x = n.join(v, "doc_id", "full_outer").na.fill(0, ["ne", "nv", "nt"])
    return x.select("doc_id", *[F.round(F.log1p(c), 6).alias(f"f{i}") for i, c in enumerate(("ne", "nv", "nt"), 1)], F.round(F.col("nt") / F.greatest(F.lit(1), F.col("nv")), 6).alias("temporal_ratio"), F.round(F.col("nt") / F.greatest(F.lit(1), F.col("ne") + F.col("nv")), 6).alias("density"))
