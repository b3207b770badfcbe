"""Queries of the rules on lines, sentences, roles, topics and intents (survey F11, F16, F17, F19, F27, F28, F32, W5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.functions import rules as R
from docweft.functions import text as T
from docweft.operators import chunking
from docweft.session import table


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _any(patterns: tuple[str, ...]) -> str:
    return _lit("|".join(f"(?:{p})" for p in patterns))


def _list(words) -> str:
    return "[" + ", ".join(_lit(w) for w in words) + "]"


def _key(s: str) -> str:
    out = f"lower(trim(regexp_replace({s}, {_lit(R.SPACES)}, ' ', 'g')))"
    for pattern, to in R.SECTION_TYPOS:
        out = f"regexp_replace({out}, {_lit(pattern)}, {_lit(to.replace('$1', chr(92) + '1'))}, 'g')"
    return out


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = f"""r AS (SELECT case_id, fetched_at, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM (SELECT case_id, fetched_at, string_split(document_text, chr(10)) AS l FROM t)),
    s AS (SELECT case_id, fetched_at, k, {STRIP.format('line')} AS s, {_key('line')} AS key FROM r),
    j AS (SELECT *, length(regexp_replace(s, '[^\\pL]', '', 'g')) AS letters, length(regexp_replace(s, '[^\\p{{Lu}}]', '', 'g')) AS capitals,
        regexp_matches(key, {_any(R.NOT_SECTIONS)}) AS form, regexp_matches(key, '^count\\s+(?:i+|\\d+)\\s*$|^count\\s+i+\\s+') AS is_count, list_contains({_list(R.SECTION_NAMES)}, key) AS known,
        contains(s, ' : ') OR ends_with(s, ':') OR (length(s) < 50 AND regexp_matches(lower(s), {_lit(f'(?:^|{R.EDGE})(?:defendant|plaintiff)' + chr(92) + '.?' + chr(92) + 's*$')})) AS caption FROM s),
    h AS (SELECT *, length(s) >= 4 AND NOT caption AND CASE WHEN known THEN NOT form ELSE is_count OR (length(s) >= 6 AND letters > 0 AND capitals >= 0.9 * letters AND NOT form) END AS head,
        s = '' OR regexp_matches(lower(s), {_any(R.JUNK_LINES)}) OR regexp_matches(s, '^[A-Z\\s-]+,?\\s*:\\s*$') OR (ends_with(s, 'JURY TRIAL DEMANDED') AND length(s) < 50) AS junk FROM j)"""


@query(f"""
    WITH t AS (SELECT DISTINCT case_id, fetched_at, document_text FROM courtlistener_recap WHERE document_text IS NOT NULL), {LINES}
    SELECT case_id, fetched_at, count(*) FILTER (head) AS n_heads, count(*) FILTER (junk) AS n_junk FROM h GROUP BY 1, 2
""")
def line_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each text are headers and how many are junk."""
    lines = table(spark, d, "courtlistener_recap").select("case_id", "fetched_at", "document_text").distinct().select("case_id", "fetched_at", F.explode(F.split("document_text", "\n")).alias("line"))
    return lines.groupBy("case_id", "fetched_at").agg(F.count_if(R.is_section_header(F.col("line"))).alias("n_heads"), F.count_if(R.is_junk_line(F.col("line"))).alias("n_junk"))


@query(f"""
    WITH t AS (SELECT case_id, 0 AS fetched_at, x.t AS document_text FROM (SELECT case_id, max({{'at': fetched_at, 'd': md5(document_text), 't': document_text}}) AS x FROM courtlistener_recap WHERE document_text IS NOT NULL AND case_id IS NOT NULL GROUP BY 1)), {LINES},
    m AS (SELECT *, last_value(CASE WHEN head THEN s END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY k) AS section, min(CASE WHEN head THEN k END) OVER (PARTITION BY case_id) AS first_k FROM h),
    f AS (SELECT m.*, coalesce(section, b.s) AS name FROM m LEFT JOIN h b ON b.case_id = m.case_id AND b.k = m.first_k)
    SELECT case_id, lower(name) AS section, count(*) AS n_lines, min(k) AS first_line FROM f WHERE NOT head AND NOT junk GROUP BY 1, 2
""")
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each case's latest text under the last header before them; lines before the first header go to it; repeated headers pool."""
    c = table(spark, d, "courtlistener_recap").filter("document_text is not null and case_id is not null")
    c = c.groupBy("case_id").agg(F.max_by("document_text", F.struct("fetched_at", F.md5("document_text"))).alias("t"))
    return chunking.section_lines(c, "case_id", "t").groupBy("case_id", F.lower("section").alias("section")).agg(F.count("*").alias("n_lines"), F.min("line_no").cast("long").alias("first_line"))


def _role_sql() -> str:
    s = r"lower(regexp_replace(coalesce(canonical_role, ''), '^\s+|\s+$', '', 'g'))"
    return "CASE " + " ".join(f"WHEN regexp_matches({s}, {_lit(p)}) THEN '{label}'" for p, label in R.ROLES) + " ELSE '' END"


@query(f"SELECT entity_id, doc_id, {_role_sql()} AS role FROM entities")
def role_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("entity_id", "doc_id", R.role_label(F.col("canonical_role")).alias("role"))


@query(f"""
    SELECT event_id, doc_id, created_at, len(list_filter(regexp_extract_all(lower(evidence_text), '[a-z][a-z''-]*'), lambda w: length(w) >= 3 AND NOT list_contains({_list(R.LIGHT_VERBS)}, w)
      AND (regexp_matches(w, '(ed|ing)$') OR list_contains({_list(R.ACTION_VERBS)}, w)))) > 0 AS acts FROM ekg_events
""")
def action_verbs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ekg_events").select("event_id", "doc_id", "created_at", R.has_action_verb(F.col("evidence_text")).alias("acts"))


def _tags_sql(rules: dict[str, tuple[str, ...]], text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({text}), {_lit(R.phrase(p))}) THEN '{k}' END" for k, p in sorted(rules.items())) + "], lambda v: v IS NOT NULL)"


@query(f"""
    WITH x AS (SELECT {_tags_sql(R.TOPICS, 'text')} AS l FROM documents WHERE text IS NOT NULL)
    SELECT unnest(CASE WHEN len(l) > 0 THEN l ELSE ['other_general_civil'] END) AS topic, count(*) AS n FROM x GROUP BY 1
""")
def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(R.topics(F.col("text"))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {_tags_sql(R.EVENTS, 'text')} AS events FROM documents WHERE text IS NOT NULL")
def event_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", R.events(F.col("text")).alias("events"))


def _intent_sql(question: str, kind: str) -> str:
    parts = []
    for words, worth in R.INTENTS:
        value = "CASE " + " ".join(f"WHEN list_contains({_list(kinds)}, upper({kind})) THEN {score}" for score, kinds in worth) + " ELSE 0 END"
        parts.append(f"CASE WHEN regexp_matches(lower({question}), {_lit(words)}) THEN {value} ELSE 0 END")
    return f"least({' + '.join(parts)}, 1.0)::DOUBLE"


QUESTIONS = ("Why was the plaintiff terminated after her maternity leave?", "Who was fired?", "What led to the dispute?", "When was the contract signed?")


@query(f"""
    WITH q AS (SELECT unnest({_list(QUESTIONS)}) AS question), e AS (SELECT DISTINCT upper(event_type) AS event_type FROM ekg_events WHERE event_type IS NOT NULL)
    SELECT question, event_type, round({_intent_sql('question', 'event_type')}, 6) AS intent FROM q, e
""")
def intent_scores(spark: SparkSession, d: str) -> DataFrame:
    """What each type of event is worth to some questions; types are a handful."""
    kinds = table(spark, d, "ekg_events").filter("event_type is not null").select(F.upper("event_type").alias("event_type")).distinct()
    asked = kinds.withColumn("question", F.explode(F.array(*map(F.lit, QUESTIONS))))
    return asked.select("question", "event_type", F.round(R.intent_score(F.col("question"), F.col("event_type")), 6).alias("intent"))


@query(f"""
    WITH t AS (SELECT doc_id, translate(trim(regexp_replace(text, {_lit(R.SPACES)}, ' ', 'g')), '․·', '..') AS t FROM documents WHERE text IS NOT NULL AND regexp_replace(text, {_lit(R.SPACES)}, '', 'g') <> ''),
    w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS k, len(l) AS n FROM (SELECT doc_id, string_split(t, ' ') AS l FROM t)),
    b AS (SELECT *, regexp_matches(w, '[.?!]$') AND regexp_matches(lead(w) OVER o, '^[A-Z"''0-9$]') AND NOT (ends_with(w, '.') AND (length(w) <= 4 OR list_contains({_list(R.ABBREVIATIONS)}, lower(replace(w, '.', ''))))) AS ends FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
    g AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM b),
    s AS (SELECT doc_id, no, string_agg(w, ' ' ORDER BY k) AS s FROM g GROUP BY 1, 2)
    SELECT doc_id, count(*) AS n, max(length(s) + CASE WHEN regexp_matches(s, '[.!?]$') THEN 0 ELSE 1 END) AS longest, md5(string_agg(CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END, chr(1) ORDER BY no)) AS digest FROM s GROUP BY 1
""")
def abbreviation_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", R.split_sentences(F.col("text")).alias("s")).filter("size(s) > 0")
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"), F.md5(F.array_join("s", "\u0001")).alias("digest"))
