"""Queries of the evaluation family (survey A7-A17, A28-A30, A40, P18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.functions import text as T
from docweft.operators import metrics
from docweft.session import table

CODE = "CASE WHEN lower(trim(label)) IN ('fact','facts','fac') THEN 1 WHEN lower(trim(label)) IN ('non-fact','nonfact','non_fact','non fact','non-fac') THEN 0 END"
#: gold: the vote of the majority of an item (ties are facts); pred: that of each person.
JUDGED = f"""v AS (SELECT dataset_id, item_index, user_id, {CODE} AS y FROM annotations), w AS (SELECT * FROM v WHERE y IS NOT NULL),
    g AS (SELECT dataset_id, item_index, CASE WHEN sum(2 * y - 1) >= 0 THEN 1 ELSE 0 END AS gold FROM w GROUP BY 1, 2), j AS (SELECT w.*, gold FROM w JOIN g USING (dataset_id, item_index))"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    w = F.lower(F.trim("label"))
    y = F.when(w.isin("fact", "facts", "fac"), 1).when(w.isin("non-fact", "nonfact", "non_fact", "non fact", "non-fac"), 0)
    return table(spark, d, "annotations").select("dataset_id", "item_index", "user_id", y.alias("y")).filter("y is not null")


def judged(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    g = v.groupBy("dataset_id", "item_index").agg(F.when(F.sum(2 * F.col("y") - 1) >= 0, 1).otherwise(0).alias("gold"))
    return v.join(g, ["dataset_id", "item_index"])


SCORES = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 OR tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy"""
COUNTS = "count(*) FILTER (gold = 1 AND y = 1) AS tp, count(*) FILTER (gold = 0 AND y = 1) AS fp, count(*) FILTER (gold = 1 AND y = 0) AS fn, count(*) FILTER (gold = 0 AND y = 0) AS tn"


@query(f"WITH {JUDGED}, c AS (SELECT user_id, {COUNTS} FROM j GROUP BY 1) SELECT user_id, tp, fp, fn, tn, {SCORES} FROM c")
def annotator_scores(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.scores(metrics.confusion(judged(spark, d), "gold", "y", "user_id"))
    return s.select("user_id", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"""
    WITH {JUDGED}, c AS (SELECT dataset_id, {COUNTS} FROM j GROUP BY 1), s AS (SELECT tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f, (tp + tn) / (tp + fp + fn + tn) AS a FROM c),
    t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, avg(a) AS ma FROM s)
    SELECT round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS micro_accuracy, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(ma, 6) AS macro_accuracy FROM t
""")
def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.micro_macro(judged(spark, d), "gold", "y", "dataset_id")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("""
    WITH m AS (SELECT similarity AS s, CASE WHEN same_event THEN 1 ELSE 0 END AS gold FROM event_matches WHERE same_event IS NOT NULL AND similarity IS NOT NULL), g AS (SELECT k, 0.1 + k * 0.05 AS t FROM range(17) r(k)),
    c AS (SELECT k, count(*) FILTER (gold = 1 AND s >= t - 5e-11) AS tp, count(*) FILTER (s >= t - 5e-11) AS said, count(*) FILTER (gold = 1) AS pos FROM m, g GROUP BY k), f AS (SELECT k, round(CASE WHEN said + pos = 0 THEN 0 ELSE 2 * tp / (said + pos) END, 12) AS f1 FROM c)
    SELECT round(0.1 + arg_max(k, (f1, -k)) * 0.05, 6) AS threshold, round(max(f1), 6) AS f1 FROM f
""")
def best_match_threshold(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "event_matches").filter("same_event is not null").withColumn("gold", F.col("same_event").cast("int"))
    return metrics.best_thresholds(m, "similarity", "gold").select("threshold", F.round("f1", 6).alias("f1"))


@query(f"""
    WITH {JUDGED}, n AS (SELECT dataset_id, item_index, y, count(*) AS c FROM w GROUP BY 1, 2, 3), p AS (SELECT dataset_id, item_index, sum(c) AS n, sum(c * (c - 1)) AS same FROM n GROUP BY 1, 2), m AS (SELECT arg_max(n, (k, n)) AS common FROM (SELECT n, count(*) AS k FROM p WHERE n > 1 GROUP BY 1)),
    k AS (SELECT p.* FROM p, m WHERE n = common), s AS (SELECT sum(c * c) AS sq, sum(c) AS tot FROM (SELECT y, sum(c) AS c FROM n JOIN k USING (dataset_id, item_index) GROUP BY 1)), a AS (SELECT count(*) AS n_items, avg(same / (n * (n - 1))) AS pa FROM k)
    SELECT n_items, round((pa - sq / (tot * tot)) / (1 - sq / (tot * tot)), 6) AS kappa FROM a, s
""")
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fleiss_kappa(votes(spark, d), ["dataset_id", "item_index"], "y").select("n_items", F.round("kappa", 6).alias("kappa"))


@query(f"""
    WITH {JUDGED}, n AS (SELECT dataset_id, item_index, y, count(*) AS c FROM w GROUP BY 1, 2, 3), p AS (SELECT dataset_id, item_index, sum(c) AS m, sum(c * (c - 1)) AS same FROM n GROUP BY 1, 2 HAVING sum(c) > 1),
    a AS (SELECT count(*) AS n_units, sum(m) AS n, sum(same / (m - 1)) AS same FROM p), c AS (SELECT sum(c * c) AS chance FROM (SELECT y, sum(c) AS c FROM n JOIN p USING (dataset_id, item_index) GROUP BY 1))
    SELECT n_units, round(1 - (1 - same / n) / (1 - chance / (n * n)), 6) AS alpha FROM a, c
""")
def krippendorff_alpha(spark: SparkSession, d: str) -> DataFrame:
    return metrics.krippendorff_alpha(votes(spark, d), ["dataset_id", "item_index"], "y").select("n_units", F.round("alpha", 6).alias("alpha"))


@query(f"""
    WITH {JUDGED}, x AS (SELECT dataset_id, gold, y FROM j), c AS (SELECT dataset_id, avg((gold = y)::INT) AS po, avg(gold) AS pg, avg(y) AS py FROM x GROUP BY 1), k AS (SELECT dataset_id, (po - (pg * py + (1 - pg) * (1 - py))) / nullif(1 - (pg * py + (1 - pg) * (1 - py)), 0) AS kappa FROM c)
    SELECT dataset_id, round(kappa, 6) AS kappa, CASE WHEN kappa IS NULL THEN 'undefined' WHEN kappa > 0.8 THEN 'almost perfect' WHEN kappa > 0.6 THEN 'substantial' WHEN kappa > 0.4 THEN 'moderate' WHEN kappa > 0.2 THEN 'fair' WHEN kappa > 0 THEN 'slight' ELSE 'poor' END AS reading FROM k
""")
def dataset_kappa(spark: SparkSession, d: str) -> DataFrame:
    c = judged(spark, d).groupBy("dataset_id").agg(F.avg((F.col("gold") == F.col("y")).cast("int")).alias("po"), F.avg("gold").alias("pg"), F.avg("y").alias("py"))
    pe = F.col("pg") * F.col("py") + (1 - F.col("pg")) * (1 - F.col("py"))
    k = c.select("dataset_id", ((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))
    return k.select("dataset_id", F.round("kappa", 6).alias("kappa"), metrics.interpret(F.col("kappa")).alias("reading"))


@query("""
    WITH g AS (SELECT doc_id, list_distinct(list(lower(trim(kind)))) AS gold FROM entities WHERE doc_id IS NOT NULL AND kind IS NOT NULL GROUP BY 1), p AS (SELECT doc_id, list_distinct(list(CASE WHEN regexp_matches(name, '(?i)\\b(inc|llc|corp|ltd|co)\\b') THEN 'org' WHEN regexp_matches(name, '(?i)county|board|commission|department') THEN 'agency' ELSE 'person' END)) AS pred FROM entities WHERE doc_id IS NOT NULL AND name IS NOT NULL GROUP BY 1),
    x AS (SELECT gold, coalesce(pred, []) AS pred FROM g LEFT JOIN p USING (doc_id)), s AS (SELECT sum(len(list_intersect(gold, pred))) AS tp, sum(len(list_filter(pred, lambda v: NOT list_contains(gold, v)))) AS fp, sum(len(list_filter(gold, lambda v: NOT list_contains(pred, v)))) AS fn, avg((len(list_filter(pred, lambda v: NOT list_contains(gold, v))) + len(list_filter(gold, lambda v: NOT list_contains(pred, v))) = 0)::INT) AS exact FROM x)
    SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(exact, 6) AS exact FROM s
""")
def kind_set_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").filter("doc_id is not null")
    g = e.filter("kind is not null").groupBy("doc_id").agg(F.collect_set(F.lower(F.trim("kind"))).alias("gold"))
    rule = F.when(F.col("name").rlike(r"(?i)\b(inc|llc|corp|ltd|co)\b"), "org").when(F.col("name").rlike("(?i)county|board|commission|department"), "agency").otherwise("person")
    p = e.filter("name is not null").groupBy("doc_id").agg(F.collect_set(rule).alias("pred"))
    s = metrics.set_scores(g.join(p, "doc_id", "left"), "gold", "pred")
    return s.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact")])


@query("""
    WITH e AS (SELECT event_id, created_at, length(evidence_text) AS x, confidence AS y, event_id || coalesce(created_at::VARCHAR, '') || coalesce(doc_id, '') AS k FROM ekg_events), b AS (SELECT DISTINCT k, x::DOUBLE AS x, y FROM e WHERE x IS NOT NULL AND y IS NOT NULL AND k IS NOT NULL),
    r AS (SELECT *, row_number() OVER (ORDER BY x, k) AS rx, row_number() OVER (ORDER BY y, k) AS ry FROM b) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r
""")
def length_confidence_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ekg_events").select(F.concat("event_id", F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")), F.coalesce("doc_id", F.lit(""))).alias("k"), F.length("evidence_text").alias("x"), F.col("confidence").alias("y"))
    c = metrics.correlations(e.filter("k is not null").distinct(), "x", "y", "k")
    return c.select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("""
    WITH t AS (SELECT event_id, doc_id, created_at, list_distinct(regexp_extract_all(lower(trigger_text), '[a-z]{3,}')) AS f, lower(evidence_text) AS e FROM ekg_events WHERE trigger_text IS NOT NULL AND evidence_text IS NOT NULL),
    s AS (SELECT CASE WHEN len(f) = 0 THEN 0 ELSE len(list_filter(f, lambda w: contains(e, w))) / len(f) END AS cover FROM t)
    SELECT count(*) AS n, count(*) FILTER (cover >= 0.45) AS covered, count(*) FILTER (cover >= 0.25 AND cover < 0.45) AS partial, round((count(*) FILTER (cover >= 0.45) + 0.5 * count(*) FILTER (cover >= 0.25 AND cover < 0.45)) / count(*), 6) AS score FROM s
""")
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """How many triggers are covered by the words of their evidence."""
    words = T.token_set(F.col("trigger_text"), "[a-z]{3,}")
    t = table(spark, d, "ekg_events").filter("trigger_text is not null and evidence_text is not null").select(words.alias("f"), F.lower("evidence_text").alias("e"))
    c = t.select(F.when(F.size("f") == 0, 0.0).otherwise(F.size(F.filter("f", lambda w: F.contains("e", w))) / F.size("f")).alias("c"))
    a = c.agg(F.count("*").alias("n"), F.count_if(F.col("c") >= 0.45).alias("covered"), F.count_if((F.col("c") >= 0.25) & (F.col("c") < 0.45)).alias("partial"))
    return a.withColumn("score", F.round(F.try_divide(F.col("covered") + 0.5 * F.col("partial"), F.col("n")), 6))
