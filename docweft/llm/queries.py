"""The queries of the nine problems; each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import consensus, grid_union, leakage, mojibake, names, packing, segments, sentences, truncation
from docweft.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "sentences").select(F.col("id").alias("record_key"), "text")
    filings = table(spark, d, "processed_filings").select("file", F.posexplode("sections").alias("k", "s"))
    filings = filings.select(F.concat("file", F.lit("#"), F.col("k").cast("string")).alias("record_key"), F.array_join("s.sentences", " ").alias("text"))
    texts = spread(own.unionByName(filings).filter("record_key is not null and text is not null"))
    units = texts.select("record_key", F.explode(sentences.sentence_units(F.col("text"))).alias("u"))
    return units.select("record_key", "u.start_char", "u.end_char").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grid_union.event_groups(table(spark, d, "event_matches"), table(spark, d, "ekg_events"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "annotations")).select("dataset_id", "item_index", "label")


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    """The reliability of each annotator."""
    people = consensus.reliabilities(consensus.latest_votes(table(spark, d, "annotations")))
    return people.select("user_id", "n_votes", F.round("accuracy", 6).alias("accuracy"))


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    """The consensus of each item with agreement and probability."""
    return consensus.consensus(table(spark, d, "annotations")).withColumns({c: F.round(c, 6) for c in ("agreement", "probability")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = truncation.truncated_rows(table(spark, d, "courtlistener_recap"), "case_id", "document_text", "court_id")
    return rows.filter("case_id is not null").select("case_id").distinct()


def p4_courts(spark: SparkSession, d: str) -> DataFrame:
    """How often each court's cases are cut."""
    return truncation.truncated_rows(table(spark, d, "courtlistener_recap"), "case_id", "document_text", "court_id")[1]


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of oversized case texts and chunks."""
    cases = segments.split_oversized(table(spark, d, "courtlistener_recap").filter("case_id is not null"), "case_id", "document_text", 4000)
    cases = cases.select(F.lit("courtlistener_recap").alias("table_name"), F.col("case_id").alias("item_key"), F.lit(None).cast("int").alias("start_sentence_id"), F.lit(None).cast("int").alias("end_sentence_id"), "piece", "start_char", "end_char", "overlap", "text")
    chunks = segments.split_chunks(table(spark, d, "chunks").filter("chunk_id is not null"))
    chunks = chunks.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("item_key"), *cases.columns[2:])
    return cases.unionByName(chunks)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).select("table_name", "item_key").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_pairs(table(spark, d, "entities"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same as one row for each entity, with the smallest entity_id of its group."""
    return names.entity_groups(table(spark, d, "entities"))


def p7_bins(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, and of each partition the bound it is certified by."""
    return packing.pack(table(spark, d, "documents").filter("text is not null"), "doc_id", packing.byte_tokens(F.col("text")), 4096)


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, how many any packing needs, and the share of room that is unused."""
    return packing.summary(p7_bins(spark, d), 4096)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(p7_bins(spark, d)).select(F.col("item").alias("doc_id"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans to remove from each document."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "qa_items"), "doc_id", "text", "idx", leakage.qa_passages())
    return leakage.removal_spans(found, "doc_id", "idx")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "qa_items"), "doc_id", "text", "idx", leakage.qa_passages())
    return found.select("doc_id", "idx").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents").select("doc_id", "text")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with their text as far as it can be restored."""
    return mojibake.repair(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "restored", "n_lost")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_annotators, p3_items, p4_found, p4_courts, p5_found, p5_pieces, p6_found, p6_groups, p7_found, p7_bins, p7_unused, p8_found, p8_spans, p9_found, p9_restored)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH RECURSIVE ev AS (SELECT DISTINCT event_id, upper(trim(event_id)) AS k FROM ekg_events WHERE event_id IS NOT NULL),
            e AS (
              SELECT DISTINCT a.event_id AS a, b.event_id AS b FROM event_matches m
              JOIN ev a ON a.k = upper(trim(m.event_a)) JOIN ev b ON b.k = upper(trim(m.event_b)) WHERE m.same_event AND a.event_id <> b.event_id
            ),
            u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            reach AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON u.a = r.b)
            SELECT a AS event_id, least(a, min(b)) AS group_id FROM reach GROUP BY a
        """,
        "p5_found": """
            SELECT DISTINCT 'courtlistener_recap' AS table_name, case_id AS item_key FROM courtlistener_recap WHERE length(document_text) > 4000 AND case_id IS NOT NULL
            UNION SELECT DISTINCT 'chunks', chunk_id FROM chunks WHERE length(text) > 1200 AND chunk_id IS NOT NULL
        """,
        "p7_found": "SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL AND strlen(text) + 1 > 4096",
    }
