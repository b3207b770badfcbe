"""Queries on records: shaping, joins, latest rows, rankings, set operations (survey S*, K*, P*, J*, W*, T*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.functions import text as T
from docweft.operators import ranking
from docweft.session import table


@query("""
    SELECT case_id, arg_max(docket_number, (fetched_at, coalesce(docket_number, ''))) AS docket_number, max(fetched_at) AS fetched_at FROM courtlistener_recap WHERE case_id IS NOT NULL GROUP BY 1
""")
def latest_case(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "courtlistener_recap").filter("case_id is not null").select("case_id", "docket_number", "fetched_at")
    return ranking.latest(r, ["case_id"], F.col("fetched_at"), F.coalesce("docket_number", F.lit("")))


@query("""
    SELECT dataset_id, item_index, user_id, label, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, item_index, user_id ORDER BY updated_at DESC, created_at DESC, id DESC, label DESC) AS k FROM annotations WHERE user_id IS NOT NULL) WHERE k = 1
""")
def latest_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Upsert semantics: the last write of a person for an item holds."""
    a = table(spark, d, "annotations").filter("user_id is not null")
    return ranking.latest(a, ["dataset_id", "item_index", "user_id"], F.col("updated_at"), F.col("created_at"), F.col("id"), F.col("label")).select("dataset_id", "item_index", "user_id", "label", "updated_at")


@query("SELECT user_id, dataset_id, item_index, label, updated_at, id FROM annotations ORDER BY updated_at DESC, id LIMIT 60")
def activity_top60(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotations").select("user_id", "dataset_id", "item_index", "label", "updated_at", "id").orderBy(F.desc("updated_at"), "id").limit(60)


@query("""
    SELECT d.id AS dataset_id, count(DISTINCT a.item_index) AS n_items, count(DISTINCT a.user_id) AS n_people, any_value(s.n) AS n_sentences FROM datasets d LEFT JOIN annotations a ON a.dataset_id = d.id
    LEFT JOIN (SELECT dataset_id, count(DISTINCT item_index) AS n FROM sentences GROUP BY 1) s ON s.dataset_id = d.id GROUP BY 1
""")
def contributor_stats(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations").groupBy("dataset_id").agg(F.count_distinct("item_index").alias("n_items"), F.count_distinct("user_id").alias("n_people"))
    s = table(spark, d, "sentences").groupBy("dataset_id").agg(F.count_distinct("item_index").alias("n_sentences"))
    ids = table(spark, d, "datasets").select(F.col("id").alias("dataset_id"))
    return ids.join(a, "dataset_id", "left").join(s, "dataset_id", "left").select("dataset_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_people", F.lit(0)).alias("n_people"), "n_sentences")


@query("""
    WITH s AS (SELECT DISTINCT dataset_id, item_index, source_row, text FROM sentences WHERE source_row IS NOT NULL), v AS (
      SELECT dataset_id, item_index, CASE WHEN lower(trim(label)) IN ('fact','facts','fac') THEN 1 ELSE 0 END AS y FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, item_index ORDER BY updated_at DESC, id) AS k FROM annotations) WHERE k = 1)
    SELECT s.dataset_id, source_row, '(' || coalesce(string_agg(trim(text), ' ' ORDER BY s.item_index, text) FILTER (y = 1), '') || ')' AS facts, '(' || coalesce(string_agg(trim(text), ' ' ORDER BY s.item_index, text) FILTER (y = 0), '') || ')' AS non_facts
    FROM s LEFT JOIN v USING (dataset_id, item_index) WHERE text = trim(text) GROUP BY 1, 2
""")
def structured_export(spark: SparkSession, d: str) -> DataFrame:
    """Facts and non-facts of each source row, joined and in brackets; rows without labels come out empty."""
    s = table(spark, d, "sentences").filter("source_row is not null and text = trim(text)").select("dataset_id", "item_index", "source_row", "text").distinct()
    v = ranking.top_k(table(spark, d, "annotations"), ["dataset_id", "item_index"], 1, F.desc("updated_at"), F.col("id"))
    v = v.select("dataset_id", "item_index", F.when(F.lower(F.trim("label")).isin("fact", "facts", "fac"), 1).otherwise(0).alias("y"))
    part = lambda k: F.concat(F.lit("("), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("y") == k, F.struct("item_index", "text")))), lambda x: x["text"]), " "), F.lit(")"))
    return s.join(v, ["dataset_id", "item_index"], "left").groupBy("dataset_id", "source_row").agg(part(1).alias("facts"), part(0).alias("non_facts"))


@query("SELECT s.id, s.dataset_id, s.item_index FROM (SELECT DISTINCT id, dataset_id, item_index FROM sentences) s WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.dataset_id = s.dataset_id AND a.item_index = s.item_index)")
def unlabelled_items(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences").select("id", "dataset_id", "item_index").distinct()
    return s.join(table(spark, d, "annotations"), ["dataset_id", "item_index"], "left_anti").select("id", "dataset_id", "item_index")


@query("SELECT a.id, a.dataset_id, a.item_index FROM annotations a WHERE NOT EXISTS (SELECT 1 FROM datasets d WHERE d.id = a.dataset_id AND NOT d.sentence_mode)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Annotations left after the datasets of whole passages go, as a left-anti join on the child."""
    gone = table(spark, d, "datasets").filter("not sentence_mode").select(F.col("id").alias("dataset_id"))
    return table(spark, d, "annotations").join(gone, "dataset_id", "left_anti").select("id", "dataset_id", "item_index")


@query("""
    WITH u AS (SELECT id, dataset_id, label, updated_at, 0 AS src FROM annotations WHERE user_id IS NOT NULL UNION ALL SELECT id, dataset_id, upper(label), updated_at, 1 FROM annotations WHERE label = 'fac' OR label = 'FAC')
    SELECT id, dataset_id, label, src FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src DESC, updated_at DESC, label DESC) AS k FROM u) WHERE k = 1
""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations")
    old = a.filter("user_id is not null").select("id", "dataset_id", "label", "updated_at", F.lit(0).alias("src"))
    new = a.filter("label in ('fac', 'FAC')").select("id", "dataset_id", F.upper("label").alias("label"), "updated_at", F.lit(1).alias("src"))
    return ranking.latest(old.unionByName(new), ["id"], F.col("src"), F.col("updated_at"), F.col("label")).select("id", "dataset_id", "label", "src")


@query("""
    WITH a AS (SELECT user_id, count(*) AS n FROM annotations WHERE user_id IS NOT NULL GROUP BY 1)
    SELECT coalesce(p.id, a.user_id) AS user_id, p.email, a.n FROM (SELECT DISTINCT id, email FROM profiles) p FULL OUTER JOIN a ON a.user_id = p.id
""")
def people_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations").filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n"))
    p = table(spark, d, "profiles").select(F.col("id").alias("user_id"), "email").distinct()
    return p.join(a, "user_id", "full_outer").select("user_id", "email", "n")


@query("""
    WITH c AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1), r AS (SELECT DISTINCT case_id FROM courtlistener_recap WHERE case_id IS NOT NULL)
    SELECT r.case_id, coalesce(c.n_chunks, 0) AS n_chunks, c.doc_id IS NOT NULL AS has_chunks FROM r LEFT JOIN c ON c.doc_id = r.case_id
""")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").groupBy(F.col("doc_id").alias("case_id")).agg(F.count("*").alias("n_chunks"))
    r = table(spark, d, "courtlistener_recap").filter("case_id is not null").select("case_id").distinct()
    return r.join(c, "case_id", "left").select("case_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("n_chunks").isNotNull().alias("has_chunks"))


@query("""
    WITH q AS (SELECT DISTINCT idx, gold_idx, gold_passage FROM qa_items WHERE gold_idx IS NOT NULL), p AS (SELECT gold_idx, min(idx) AS first_idx, min(gold_passage) AS passage, count(*) AS n FROM q GROUP BY 1)
    SELECT q.idx, q.gold_idx, p.first_idx, p.n, md5(p.passage) AS digest FROM q JOIN p USING (gold_idx)
""")
def gold_passages(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa_items").filter("gold_idx is not null").select("idx", "gold_idx", "gold_passage").distinct()
    p = q.groupBy("gold_idx").agg(F.min("idx").alias("first_idx"), F.min("gold_passage").alias("passage"), F.count("*").alias("n"))
    return q.join(p, "gold_idx").select("idx", "gold_idx", "first_idx", "n", F.md5("passage").alias("digest"))


@query("""
    SELECT idx, format('{}__q{:03d}', coalesce(answer, 'X'), k) AS faq_id, question FROM (SELECT idx, answer, question, row_number() OVER (PARTITION BY answer ORDER BY idx, question) AS k FROM qa_items WHERE length(trim(question)) > 0)
""")
def faq_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entry ids count the kept questions of their group."""
    q = table(spark, d, "qa_items").filter(T.missing(F.col("question")).isNotNull())
    k = F.row_number().over(Window.partitionBy("answer").orderBy("idx", "question"))
    return q.select("idx", F.format_string("%s__q%03d", F.coalesce("answer", F.lit("X")), k).alias("faq_id"), "question")


@query("""
    SELECT doc_id, case_id, norm_key FROM (SELECT doc_id, case_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS norm_key, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL AND length(text) = strlen(text)) WHERE k = 1
""")
def first_of_equal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies but for case and white space, of texts in ASCII only: the first id stays. Keyed by digest, so texts are not shuffled."""
    x = table(spark, d, "documents").filter(F.length("text") == F.octet_length("text")).select("doc_id", "case_id", F.md5(T.norm_text(F.col("text"))).alias("norm_key"))
    return ranking.first(x, ["norm_key"], F.col("doc_id")).select("doc_id", "case_id", "norm_key")


@query()
def first_of_equal_texts_all(spark: SparkSession, d: str) -> DataFrame:
    """As first_of_equal_texts, of texts in all scripts. No SQL: DuckDB differs in lower case and white space beyond ASCII."""
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", "case_id", F.md5(T.norm_text_any(F.col("text"))).alias("norm_key"))
    return ranking.first(x, ["norm_key"], F.col("doc_id")).select("doc_id", "case_id", "norm_key")


@query("SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1")
def longest_per_source(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").filter("source is not null and n_chars is not null")
    return x.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("SELECT source, doc_id, n_chars, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def top3_per_source(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], 3, F.desc_nulls_last("n_chars"), F.col("doc_id")).withColumn("rank", F.col("rank").cast("long"))


@query("""
    SELECT case_id, doc_id, n_chars, running FROM (SELECT case_id, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY case_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents WHERE case_id IS NOT NULL AND n_chars IS NOT NULL) WHERE running <= 10000
""")
def within_budget(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").filter("case_id is not null and n_chars is not null").select("case_id", "doc_id", "n_chars")
    return ranking.within_budget(x, ["case_id"], "n_chars", 10000, F.col("doc_id"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice < p.p_retailprice))")
def pareto_parts(spark: SparkSession, d: str) -> DataFrame:
    return ranking.skyline(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("""
    WITH e AS (SELECT * FROM part WHERE p_size >= 10 AND p_retailprice <= 1200), f AS (SELECT * FROM e UNION ALL SELECT * FROM part WHERE (SELECT count(*) FROM e) = 0)
    SELECT p_brand, arg_max(p_partkey, (p_size, -p_retailprice, -p_partkey)) AS best FROM f GROUP BY 1
""")
def best_eligible(spark: SparkSession, d: str) -> DataFrame:
    """The best part of each brand among eligible ones; among all if none is."""
    p = table(spark, d, "part").withColumn("ok", F.expr("p_size >= 10 and p_retailprice <= 1200"))
    some = F.broadcast(p.agg(F.bool_or("ok").alias("some")))
    kept = p.crossJoin(some).filter("ok or not coalesce(some, false)")
    return kept.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_retailprice"), -F.col("p_partkey"))).alias("best"))


@query("""
    SELECT doc_id, lang, CASE WHEN k <= round_even(n * 0.8, 0) THEN 'train' WHEN k <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'validation' ELSE 'test' END AS split FROM (
      SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "lang")
    return ranking.stratified_split(x, ["lang"], F.struct(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("42"))), "doc_id"), 0.8, 0.1)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def except_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return o.subtract(table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def semi_big_spenders(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def anti_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_nations(spark: SparkSession, d: str) -> DataFrame:
    """Aggregated before the joins: customers per nation are few."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    j = c.join(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("b"), 2).alias("balance"))


@query("""
    SELECT event_id, doc_id, k, md5(array_to_string(around, '|')) AS digest FROM (SELECT event_id, doc_id, row_number() OVER w AS k, list(coalesce(trigger_text, '')) OVER (PARTITION BY doc_id ORDER BY coalesce(s, 1000000000), coalesce(time_normalized, 'zzzz'), event_id, created_at ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around
      FROM (SELECT *, TRY_CAST(nullif(regexp_extract(evidence_sentence_ids_json, '(\\d+)', 1), '') AS INTEGER) AS s FROM ekg_events WHERE doc_id IS NOT NULL) WINDOW w AS (PARTITION BY doc_id ORDER BY coalesce(s, 1000000000), coalesce(time_normalized, 'zzzz'), event_id, created_at))
""")
def event_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Two events before and after each in its document, by first sentence, time and id."""
    e = table(spark, d, "ekg_events").filter("doc_id is not null").withColumn("s", F.regexp_extract("evidence_sentence_ids_json", r"(\d+)", 1).try_cast("int"))
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("s", F.lit(1000000000)), F.coalesce("time_normalized", F.lit("zzzz")), "event_id", "created_at")
    around = F.collect_list(F.coalesce("trigger_text", F.lit(""))).over(w.rowsBetween(-2, 2))
    return e.select("event_id", "doc_id", F.row_number().over(w).cast("long").alias("k"), F.md5(F.array_join(around, "|")).alias("digest"))


@query("""
    WITH s AS (SELECT dataset_id, item_index, max(CASE WHEN lower(trim(label)) IN ('fact','facts','fac') THEN 1 ELSE 0 END) AS y FROM annotations GROUP BY 1, 2),
    g AS (SELECT *, sum(1 - y) OVER (PARTITION BY dataset_id ORDER BY item_index ROWS UNBOUNDED PRECEDING) AS island FROM s), i AS (SELECT dataset_id, island, min(item_index) AS first_item, max(item_index) AS last_item, count(*) AS n FROM g WHERE y = 1 GROUP BY 1, 2)
    SELECT dataset_id, arg_min(first_item, island) AS first_item, arg_min(last_item, island) AS last_item, arg_min(n, island) AS n FROM i GROUP BY 1
""")
def first_fact_block(spark: SparkSession, d: str) -> DataFrame:
    """The first unbroken run of items that someone labelled fact."""
    s = table(spark, d, "annotations").groupBy("dataset_id", "item_index").agg(F.max(F.lower(F.trim("label")).isin("fact", "facts", "fac").cast("int")).alias("y"))
    s = s.withColumn("y", F.coalesce("y", F.lit(0)))
    w = Window.partitionBy("dataset_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, 0)
    i = s.withColumn("island", F.sum(1 - F.col("y")).over(w)).filter("y = 1").groupBy("dataset_id", "island").agg(F.min("item_index").alias("first_item"), F.max("item_index").alias("last_item"), F.count("*").alias("n"))
    return i.groupBy("dataset_id").agg(*[F.min_by(c, "island").alias(c) for c in ("first_item", "last_item", "n")])


@query("SELECT user_id, ts, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_event_per_type(spark: SparkSession, d: str) -> DataFrame:
    return ranking.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_property_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("""
    WITH u AS (SELECT DISTINCT case_id, absolute_url FROM courtlistener_recap WHERE absolute_url IS NOT NULL), p AS (SELECT DISTINCT docket_id FROM courtlistener_recap WHERE docket_id IS NOT NULL)
    SELECT u.case_id, u.absolute_url, p.docket_id FROM u JOIN p ON contains(u.absolute_url, '/' || p.docket_id || '/')
""")
def docket_mentions(spark: SparkSession, d: str) -> DataFrame:
    """URLs that hold the id of a docket: the numbers of each URL are joined by equality, so no URL meets all dockets."""
    r = table(spark, d, "courtlistener_recap")
    u = r.filter("absolute_url is not null").select("case_id", "absolute_url").distinct()
    u = u.select("*", F.explode(F.array_distinct(F.regexp_extract_all("absolute_url", F.lit("(?<=/)([0-9]+)(?=/)"), F.lit(1)))).alias("number"))
    p = r.filter("docket_id is not null").select("docket_id", F.col("docket_id").cast("string").alias("number")).distinct()
    return u.join(p, "number").select("case_id", "absolute_url", "docket_id")


@query("""
    WITH l AS (SELECT doc_id, count(*) AS n FROM ekg_events WHERE doc_id IS NOT NULL GROUP BY 1), g AS (SELECT unnest(generate_series(1, (SELECT max(n) FROM l))) AS lv), t AS (SELECT max(lv) AS lv FROM g WHERE (SELECT sum(least(n, lv)) FROM l) <= 2000)
    SELECT doc_id, least(n, (SELECT lv FROM t)) AS take FROM l
""")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "ekg_events").filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    return ranking.balanced_counts(n, "doc_id", "n", 2000)


@query("SELECT court, case_id, k AS round FROM (SELECT lower(trim(court_id)) AS court, case_id, row_number() OVER (PARTITION BY lower(trim(court_id)) ORDER BY md5(case_id), case_id) AS k FROM (SELECT DISTINCT court_id, case_id FROM courtlistener_recap WHERE case_id IS NOT NULL AND court_id = lower(trim(court_id)))) ORDER BY k, court LIMIT 100")
def round_robin_courts(spark: SparkSession, d: str) -> DataFrame:
    """One case of each court a round, for the first hundred."""
    c = table(spark, d, "courtlistener_recap").filter("case_id is not null and court_id = lower(trim(court_id))").select(F.col("court_id").alias("court"), "case_id").distinct()
    k = F.row_number().over(Window.partitionBy("court").orderBy(F.md5("case_id"), "case_id"))
    return c.withColumn("round", k.cast("long")).orderBy("round", "court").limit(100)


@query("SELECT lower(trim(c.lang)) AS lang, CASE WHEN length(trim(doc_kind)) > 0 THEN doc_kind ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT source) AS sources FROM documents c GROUP BY 1, 2")
def kinds_by_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.lower(F.trim("lang")).alias("lang"), F.when(F.length(F.trim("doc_kind")) > 0, F.col("doc_kind")).otherwise("other").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("""
    SELECT doc_id AS case_id, count(*) AS n_chunks, min(start_sentence_id) AS first_id, max(end_sentence_id) AS last_id, sum(length(text))::BIGINT AS n_chars FROM (SELECT DISTINCT * FROM chunks) WHERE doc_id IS NOT NULL GROUP BY 1
""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("doc_id is not null").distinct().groupBy(F.col("doc_id").alias("case_id")).agg(F.count("*").alias("n_chunks"), F.min("start_sentence_id").alias("first_id"), F.max("end_sentence_id").alias("last_id"), F.sum(F.length("text")).alias("n_chars"))


@query("""
    WITH d AS (SELECT DISTINCT case_id, document_text, parties FROM courtlistener_recap WHERE case_id IS NOT NULL), k AS (SELECT * FROM d WHERE length(trim(document_text)) > 0 AND len(parties) > 0), m AS (SELECT case_id, count(*) AS n FROM k GROUP BY 1)
    SELECT case_id, n FROM m
""")
def cases_with_both(spark: SparkSession, d: str) -> DataFrame:
    """Cases that have a text and parties, with the number of their versions."""
    r = table(spark, d, "courtlistener_recap").filter("case_id is not null").select("case_id", "document_text", "parties").distinct()
    return r.filter((F.length(F.trim("document_text")) > 0) & (F.size("parties") > 0)).groupBy("case_id").agg(F.count("*").alias("n"))


@query("SELECT party, count(*) AS n, count(DISTINCT case_id) AS cases FROM (SELECT case_id, unnest(parties) AS party FROM courtlistener_recap) GROUP BY 1")
def party_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "courtlistener_recap").select("case_id", F.explode("parties").alias("party")).groupBy("party").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))
