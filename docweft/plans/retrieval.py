"""Queries of the retrieval family (survey J1-J7, J25, F3, F8-F11, W6, W7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.functions import text as T
from docweft.operators import graphs, ranking, retrieval
from docweft.session import table

STOP = ",".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""
    WITH t AS (SELECT idx, unnest(list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z][a-z0-9_]{{2,}}')), lambda w: NOT list_contains([{STOP}], w))) AS term FROM qa_items),
    w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents), p AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2),
    l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
    v AS (SELECT DISTINCT word FROM p), x AS (SELECT v.word, d.term FROM v JOIN (SELECT DISTINCT term FROM t) d ON starts_with(v.word, d.term)),
    h AS (SELECT doc_id, term, sum(tf) AS tf FROM p JOIN x USING (word) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
    q AS (SELECT h.doc_id, h.term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS part FROM h JOIN f USING (term) JOIN l USING (doc_id), s),
    z AS (SELECT idx, doc_id, sum(part) AS score FROM t JOIN q USING (term) GROUP BY 1, 2)
    SELECT idx, doc_id, score, rank FROM (SELECT idx, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY idx ORDER BY round(score, 6) DESC, doc_id) AS rank FROM z) WHERE rank <= 10
""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for every held-out question."""
    s = retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, d, "qa_items").select("idx", "question"), "idx", "question")
    return retrieval.best(s, "idx", "doc_id", 10).select("idx", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
    WITH q AS (SELECT DISTINCT idx, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]+'))) AS w FROM qa_items) SELECT idx, list_sort(list(w)) AS terms FROM q WHERE length(w) >= 3 GROUP BY 1
""")
def fts_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_items").select("idx", F.array_sort(T.fts_terms(F.col("question"))).alias("terms"))


@query("""
    SELECT event_id, doc_id, created_at, round(0.5 * least(length(coalesce(evidence_text, '')) / 240.0, 1) + 0.5 * coalesce(confidence, 0), 6) AS richness,
      CASE WHEN length(trim(coalesce(time_raw, ''))) > 0 THEN 1.0 ELSE 0.15 END AS temporal, coalesce(is_supporting_fact, false) AS supporting FROM ekg_events
""")
def event_scores(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the score that need no graph, for a question about time."""
    q = F.lit("when was the contract signed?")
    return table(spark, d, "ekg_events").select(
        "event_id", "doc_id", "created_at", F.round(retrieval.evidence_richness(F.col("evidence_text"), F.col("confidence")), 6).alias("richness"),
        retrieval.temporal_match(q, F.col("time_raw"), F.col("time_normalized")).alias("temporal"), F.coalesce("is_supporting_fact", F.lit(False)).alias("supporting"),
    )


PAIRS = """p AS (SELECT DISTINCT least(upper(trim(event_a)), upper(trim(event_b))) AS a, greatest(upper(trim(event_a)), upper(trim(event_b))) AS b FROM event_matches WHERE same_event AND upper(trim(event_a)) <> upper(trim(event_b))),
    u AS (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p)"""


@query(f"""
    WITH {PAIRS}, g AS (SELECT src, count(*) AS n FROM u GROUP BY 1), e AS (SELECT event_id, max(coalesce(confidence, 0)) AS c, max(length(coalesce(evidence_text, ''))) AS len, bool_or(coalesce(is_supporting_fact, false)) AS s FROM ekg_events GROUP BY 1)
    SELECT event_id, round(0.10 * (0.5 * least(len / 240.0, 1) + 0.5 * c) + 0.12 * (0.45 * least(coalesce(n, 0) / 4.0, 1) - CASE WHEN false THEN 0.2 ELSE 0 END) + 0.03 * s::INT, 6) AS score FROM e LEFT JOIN g ON src = event_id WHERE NOT s OR n IS NOT NULL
""")
def structural_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Evidence, structure and support of events, isolated supporting facts left out."""
    e = table(spark, d, "ekg_events").groupBy("event_id").agg(
        F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"), F.max(F.length(F.coalesce("evidence_text", F.lit("")))).alias("len"), F.bool_or(F.coalesce("is_supporting_fact", F.lit(False))).alias("s")
    )
    g = graphs.degree(graphs.match_edges(table(spark, d, "event_matches")))
    x = e.join(g, F.col("event_id") == F.col("id"), "left").filter(~F.col("s") | F.col("degree").isNotNull())
    rich = 0.5 * F.least(F.col("len") / 240, F.lit(1.0)) + 0.5 * F.col("c")
    structure = retrieval.structure_score(F.lit(0), F.coalesce("degree", F.lit(0)), F.lit(False))
    return x.select("event_id", F.round(retrieval.combined(evidence=rich, structure=structure, supporting=F.col("s").cast("double")), 6).alias("score"))


@query(f"""
    WITH {PAIRS}, s AS (SELECT DISTINCT event_id FROM ekg_events WHERE main_verb = 'fired'), h1 AS (SELECT DISTINCT dst AS id FROM u JOIN s ON src = event_id), h2 AS (SELECT DISTINCT dst AS id FROM u JOIN h1 ON src = id)
    SELECT id, min(hop) AS hop FROM (SELECT event_id AS id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1
""")
def two_hops(spark: SparkSession, d: str) -> DataFrame:
    """What lies within two links of the events with the verb fired."""
    seeds = table(spark, d, "ekg_events").filter("main_verb = 'fired'").select(F.col("event_id").alias("id")).distinct()
    return graphs.hops(seeds, graphs.match_edges(table(spark, d, "event_matches")), 2)


@query(f"""
    WITH {PAIRS}, s AS (SELECT DISTINCT event_id FROM ekg_events WHERE main_verb = 'hired') SELECT DISTINCT a, b FROM p WHERE a IN (SELECT event_id FROM s) OR b IN (SELECT event_id FROM s)
""")
def incident_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with an end among the seeds: two semi-joins in place of an OR."""
    seeds = table(spark, d, "ekg_events").filter("main_verb = 'hired'").select(F.col("event_id").alias("id")).distinct()
    return graphs.incident(seeds, graphs.match_edges(table(spark, d, "event_matches")))


@query("""
    WITH e AS (SELECT event_id, doc_id, unnest(list_distinct(list_transform(regexp_extract_all(evidence_sentence_ids_json, '\\d+'), lambda x: x::INTEGER))) AS sid FROM ekg_events WHERE doc_id IS NOT NULL),
    c AS (SELECT DISTINCT doc_id, chunk_id, start_sentence_id AS a, end_sentence_id AS b FROM chunks WHERE chunk_id IS NOT NULL)
    SELECT DISTINCT event_id, chunk_id FROM e JOIN c USING (doc_id) WHERE sid BETWEEN a AND b
""")
def event_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold a sentence of an event's evidence: the chunk's span is unrolled, so the join is on equality."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all("evidence_sentence_ids_json", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")))
    e = table(spark, d, "ekg_events").filter("doc_id is not null").select("event_id", "doc_id", F.explode(ids).alias("sid")).distinct()
    c = table(spark, d, "chunks").filter("chunk_id is not null and start_sentence_id <= end_sentence_id").select("doc_id", "chunk_id", F.explode(F.sequence("start_sentence_id", "end_sentence_id")).alias("sid")).distinct()
    return e.join(c, ["doc_id", "sid"]).select("event_id", "chunk_id").distinct()


@query("SELECT DISTINCT n.doc_id, n.entity_id, n.name FROM entities n JOIN (SELECT DISTINCT doc_id FROM ekg_events WHERE upper(event_type) = 'TERMINATION') e USING (doc_id)")
def entities_of_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ekg_events").filter("upper(event_type) = 'TERMINATION'").select("doc_id")
    return table(spark, d, "entities").join(e, "doc_id", "left_semi").select("doc_id", "entity_id", "name").distinct()


#: Cells of hashes that last words of names are told apart by.
NAME_CELLS = 1 << 20


def _mentions(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, event_id, mention_text): entities of the document whose name is in the evidence; candidates by an equal last word of the name."""
    said = events.select("doc_id", "event_id", F.lower("evidence_text").alias("said"))
    names = entities.select("doc_id", "entity_id", F.trim("name").alias("mention_text")).filter("mention_text <> ''").distinct()
    names = names.withColumn("word", F.try_element_at(T.tokens(F.col("mention_text")), F.lit(-1)))
    # Words that no name of the document can end with are dropped before texts are shuffled by words; a cell for each hash, so the broadcast is bounded.
    cell = F.pmod(F.xxhash64("doc_id", "word"), F.lit(NAME_CELLS)).cast("int").alias("cell")
    words = said.select("*", F.explode(T.token_set(F.col("said"))).alias("word")).withColumn("cell", cell)
    words = words.join(F.broadcast(names.filter("word is not null").select(cell).distinct()), "cell", "left_semi").drop("cell")
    both = words.join(names, ["doc_id", "word"]).filter(F.contains(F.col("said"), F.lower("mention_text")))
    return both.select("doc_id", "event_id", "entity_id", "mention_text").distinct()


@query()
def graph_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The best eight events for each held-out question, by all eight parts of the score, with chunk rescue and two hops. No SQL; tested against a plain version."""
    e = ranking.latest(table(spark, d, "ekg_events").filter("doc_id is not null and event_id is not null"), ["doc_id", "event_id"], F.col("created_at"))
    e = e.withColumn("lexical_text", F.concat_ws(" ", "event_type", "main_verb", "trigger_text", "evidence_text"))
    chunks = table(spark, d, "chunks").filter("doc_id is not null and chunk_id is not null").groupBy("doc_id", "chunk_id").agg(F.max("text").alias("text"))
    entities = table(spark, d, "entities").filter("doc_id is not null and entity_id is not null").select("doc_id", "entity_id", "name").distinct()
    ids = e.select("doc_id", F.upper("event_id").alias("id"), "event_id")
    m = graphs.match_edges(table(spark, d, "event_matches"))
    a, b = (ids.select("doc_id", F.col("id").alias(k), F.col("event_id").alias(f"e_{k}")) for k in ("a", "b"))
    edges = m.join(a, "a").join(b, ["doc_id", "b"]).select("doc_id", F.col("e_a").alias("a"), F.col("e_b").alias("b"))
    questions = table(spark, d, "qa_items").filter("idx is not null and question is not null").select("idx", "question")
    return retrieval.graph_retrieval(questions, e, chunks, entities, _mentions(e, entities), edges)
