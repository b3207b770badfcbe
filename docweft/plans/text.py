"""Queries on text: normal forms, labels, sections, sentences and chunks (survey F*, P*, W*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.functions import text as T
from docweft.operators import chunking
from docweft.session import table

LABEL_SQL = """CASE WHEN w IN ('fact','facts','fac','1') THEN 1 WHEN w IN ('non-fact','nonfact','non_fact','non fact','non-facts','0') THEN 0 END"""


@query("SELECT lower(trim(regexp_replace(main_verb, '\\s+', ' ', 'g'))) AS verb, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ekg_events GROUP BY 1")
def verb_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ekg_events").select(T.norm_text(F.col("main_verb")).alias("verb"), "doc_id")
    return e.groupBy("verb").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"SELECT dataset_id, item_index, label, {LABEL_SQL} AS code FROM (SELECT *, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS w FROM annotations)")
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotations").select("dataset_id", "item_index", "label", T.sentence_label(F.col("label")).alias("code"))


@query("""
    SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents)
""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct")).select(
        "doc_id", *[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in ("n_tokens", "n_distinct")]
    )


@query("""
    SELECT case_id, fetched_at, CASE WHEN length(trim(case_name_full)) > 0 THEN trim(case_name_full) WHEN length(trim(case_name)) > 0 THEN trim(case_name) ELSE trim(docket_number) END AS title,
      CASE WHEN length(trim(case_name_full)) > 0 THEN 'case_name_full' WHEN length(trim(case_name)) > 0 THEN 'case_name' WHEN length(trim(docket_number)) > 0 THEN 'docket_number' END AS source
    FROM courtlistener_recap
""")
def first_nonempty_title(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("case_name_full", "case_name", "docket_number")]
    return table(spark, d, "courtlistener_recap").select("case_id", "fetched_at", T.first_nonempty(*c).alias("title"), T.which_nonempty(case_name_full=c[0], case_name=c[1], docket_number=c[2]).alias("source"))


@query("""
    SELECT lower(trim(court_id)) AS court, bool_or(coalesce(trim(court_id) <> '' AND NOT regexp_matches(lower(trim(court_id)), '^(ca|uscfc|usca|arb|neb|nysb)'), false)) AS district, count(*) AS n
    FROM courtlistener_recap GROUP BY 1
""")
def district_courts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "courtlistener_recap").select(F.lower(F.trim("court_id")).alias("court"), T.is_district_court(F.col("court_id")).alias("x"))
    return r.groupBy("court").agg(F.bool_or("x").alias("district"), F.count("*").alias("n"))


@query("""
    SELECT case_id, fetched_at, CASE
      WHEN instr(case_name, ' v. ') > 0 AND length(trim(substr(case_name, 1, instr(case_name, ' v. ') - 1))) > 0 AND length(trim(substr(case_name, instr(case_name, ' v. ') + 4))) > 0
      THEN trim(substr(case_name, 1, instr(case_name, ' v. ') - 1)) END AS left_side,
      CASE WHEN instr(case_name, ' v. ') > 0 AND length(trim(substr(case_name, 1, instr(case_name, ' v. ') - 1))) > 0 AND length(trim(substr(case_name, instr(case_name, ' v. ') + 4))) > 0
      THEN trim(substr(case_name, instr(case_name, ' v. ') + 4)) END AS right_side
    FROM courtlistener_recap WHERE instr(case_name, ' v. ') > 0
""")
def caption_sides(spark: SparkSession, d: str) -> DataFrame:
    p = T.caption_parties(F.col("case_name"))
    two = F.size(p) == 2
    return table(spark, d, "courtlistener_recap").filter(F.contains("case_name", F.lit(" v. "))).select(
        "case_id", "fetched_at", F.when(two, F.get(p, F.lit(0))).alias("left_side"), F.when(two, F.get(p, F.lit(1))).alias("right_side")
    )


@query("SELECT case_id, fetched_at, coalesce(docket_id, TRY_CAST(nullif(regexp_extract(absolute_url, '/dockets/(\\d+)', 1), '') AS BIGINT)) AS docket FROM courtlistener_recap")
def docket_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "courtlistener_recap").select("case_id", "fetched_at", T.docket_number_id(F.col("docket_id").cast("string"), F.col("absolute_url")).alias("docket"))


@query("SELECT regexp_replace(lower(file), '[^a-z0-9]+', '_', 'g') AS slug, count(*) AS n FROM processed_filings GROUP BY 1")
def file_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed_filings").groupBy(T.slugify(F.col("file")).alias("slug")).agg(F.count("*").alias("n"))


@query("""
    SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS plain
    FROM documents WHERE text NOT LIKE '%<script%'
""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(~F.contains("text", F.lit("<script"))).select("doc_id", T.strip_html(F.col("text")).alias("plain"))


@query("""
    SELECT doc_id, unnest(list_transform(range(1, len(l) + 1), lambda i: i)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
""")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each line of each document with its number from 1."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return lines.select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), "line")


@query("""
    WITH l AS (SELECT case_id, fetched_at, unnest(string_split(document_text, chr(10))) AS line FROM courtlistener_recap WHERE document_text IS NOT NULL),
    s AS (SELECT case_id, trim(line, ' ' || chr(9) || chr(13)) AS s FROM l)
    SELECT case_id, count(*) AS n_lines, count(*) FILTER (s = '') AS n_blank, count(*) FILTER (regexp_matches(s, '^[0-9]+$')) AS n_number,
      count(*) FILTER (regexp_matches(s, '^(?i:page [0-9]+( of [0-9]+)?)$')) AS n_page FROM s GROUP BY 1
""")
def line_classes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "courtlistener_recap").select("case_id", F.explode(F.split("document_text", "\n")).alias("line")).select("case_id", T.strip(F.col("line")).alias("s"))
    return lines.groupBy("case_id").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("s") == "").alias("n_blank"), F.count_if(F.col("s").rlike("^[0-9]+$")).alias("n_number"), F.count_if(F.col("s").rlike("^(?i:page [0-9]+( of [0-9]+)?)$")).alias("n_page")
    )


@query("""
    SELECT file, section_no, CASE WHEN regexp_matches(lower(name), 'fact') THEN 1 WHEN regexp_matches(lower(name), 'jurisdiction|venue|parties|relief|prayer') THEN 0 END AS label, n_sentences FROM (
      SELECT DISTINCT file, i AS section_no, sections[i].name AS name, len(sections[i].sentences) AS n_sentences FROM (SELECT file, sections, unnest(range(1, len(sections) + 1)) AS i FROM processed_filings))
""")
def section_labels(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "processed_filings").select("file", F.posexplode("sections").alias("k", "s")).select("file", (F.col("k") + 1).cast("long").alias("section_no"), "s.name", F.when(F.col("s.sentences").isNotNull(), F.size("s.sentences")).cast("long").alias("n_sentences")).distinct()
    return s.select("file", "section_no", T.section_label(F.col("name")).alias("label"), "n_sentences")


@query("""
    SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)
""")
def simple_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = T.split_sentences_simple(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query("""
    WITH c AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 1200 THEN [0] ELSE range(0, n - 1200 + 1000, 1000) END) AS start FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0))
    SELECT doc_id, start AS start_char, least(start + 1200, n) AS end_char, md5(substr(text, start + 1, 1200)) AS digest FROM c
""")
def char_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1200 characters that overlap by 200."""
    c = chunking.char_chunks(table(spark, d, "documents").filter(F.length("text") > 0), "text", 1200, 200)
    return c.select("doc_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), F.md5("chunk").alias("digest"))


@query("""
    WITH s AS (SELECT DISTINCT file, i AS section_no, sections[i].sentences AS s FROM (SELECT file, sections, unnest(range(1, len(sections) + 1)) AS i FROM processed_filings) WHERE len(sections[i].sentences) > 0),
    c AS (SELECT file, section_no, s, unnest(CASE WHEN len(s) <= 4 THEN [0] ELSE range(0, len(s) - 4 + 3, 3) END) AS start FROM s)
    SELECT file, section_no, start // 3 AS chunk_no, start + 1 AS first_id, least(start + 4, len(s)) AS last_id, md5(array_to_string(s[start + 1:start + 4], chr(10))) AS digest FROM c
""")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of four sentences that overlap by one."""
    s = table(spark, d, "processed_filings").select("file", F.posexplode("sections").alias("k", "x")).select("file", (F.col("k") + 1).cast("long").alias("section_no"), F.col("x.sentences").alias("s")).filter("size(s) > 0").distinct()
    c = chunking.sentence_chunks(s, "s", 4, 1)
    return c.select("file", "section_no", *[F.col(x).cast("long").alias(x) for x in ("chunk_no", "first_id", "last_id")], F.md5(F.array_join("chunk", "\n")).alias("digest"))


@query("""
    SELECT doc_id, chunk_id, start_sentence_id, text, md5(CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 100) || '...' || right(text, 100) END) AS clipped, left(sha256(text), 16) AS key FROM chunks
""")
def clips_and_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("doc_id", "chunk_id", "start_sentence_id", "text", F.md5(T.clip(F.col("text"), 200)).alias("clipped"), T.content_key(F.col("text")).alias("key"))


@query("""
    SELECT event_id, doc_id, created_at, list_sort(list_distinct(list_filter(list_transform(coalesce(TRY_CAST(evidence_sentence_ids_json AS JSON)->>'$[*]', []), lambda x: TRY_CAST(nullif(regexp_extract(x, '^[sS]?(\\d+)$', 1), '') AS INTEGER)), lambda x: x IS NOT NULL))) AS ids
    FROM ekg_events WHERE evidence_sentence_ids_json IS NULL OR json_valid(evidence_sentence_ids_json)
""")
def evidence_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ekg_events")
    return e.filter(F.col("evidence_sentence_ids_json").isNull() | F.try_parse_json("evidence_sentence_ids_json").isNotNull()).select("event_id", "doc_id", "created_at", T.sentence_numbers(F.col("evidence_sentence_ids_json")).alias("ids"))


@query("""
    SELECT case_id, fetched_at, CASE WHEN regexp_matches(document_text, '(?i)factual background|statement of facts') THEN md5(substr(document_text, instr(lower(document_text), regexp_extract(lower(document_text), 'factual background|statement of facts')))) ELSE md5(document_text) END AS facts
    FROM courtlistener_recap WHERE document_text IS NOT NULL AND length(document_text) = strlen(document_text)
""")
def facts_sections(spark: SparkSession, d: str) -> DataFrame:
    """The text from the facts header on, else the whole; texts of ASCII only, as in the SQL."""
    r = table(spark, d, "courtlistener_recap").filter(F.length("document_text") == F.octet_length("document_text"))
    return r.select("case_id", "fetched_at", F.md5(chunking.facts_section(F.col("document_text"))).alias("facts"))


@query()
def facts_sections_all(spark: SparkSession, d: str) -> DataFrame:
    """The facts of each case text in any script, by the tiers of headers. No SQL: DuckDB differs in white space and case beyond ASCII."""
    r = table(spark, d, "courtlistener_recap").filter("document_text is not null")
    return r.select("case_id", "fetched_at", F.md5(chunking.facts_body(F.col("document_text"))).alias("facts"))


@query("""
    WITH p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, (k - 1) // 5 AS paragraph, count(*) AS n_lines, md5(string_agg(line, ' ' ORDER BY k)) AS digest FROM p GROUP BY 1, 2
""")
def paragraph_groups(spark: SparkSession, d: str) -> DataFrame:
    """Lines in groups of five."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    groups = lines.select("doc_id", "l", F.explode(F.sequence(F.lit(0), (F.size("l") - 1).cast("int"), F.lit(5))).alias("s"))
    part = F.slice("l", F.col("s") + 1, F.lit(5))
    return groups.select("doc_id", F.floor(F.col("s") / 5).cast("long").alias("paragraph"), F.size(part).cast("long").alias("n_lines"), F.md5(F.array_join(part, " ")).alias("digest"))


@query()
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs packed greedily into chunks of up to 2000 characters."""
    return chunking.paragraph_chunks(table(spark, d, "courtlistener_recap").select("case_id", "fetched_at", "document_text"), "document_text", 2000)


@query()
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sections as chunks, those over 3000 characters in windows that overlap by 200."""
    c = table(spark, d, "courtlistener_recap").filter("document_text is not null and case_id is not null").groupBy("case_id").agg(F.max_by("document_text", "fetched_at").alias("text"))
    return chunking.section_chunks(c, "case_id", "text", 3000, 200)
