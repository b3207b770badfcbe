"""Queries on events (survey 2.10): those named stream run one over what is there and give the batch result; the others are batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.catalogue import query
from docweft.operators import ranking
from docweft.session import table
from docweft.streaming import windows


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts per day and type as a stream leaves them; days behind the watermark leave its state."""
    e = windows.read_stream(spark, f"{d}/events.parquet", "ts")
    out = windows.run_to_end(windows.tumbling(e, "ts", "1 day", "1 day", "event_type"), "update", ("window_start", "event_type"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def distinct_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events without repeats, by a stream that remembers ids only as long as its watermark."""
    e = windows.read_stream(spark, f"{d}/events.parquet", "ts")
    return windows.run_to_end(windows.distinct_within(e, "ts", "10 minutes", "event_id")).agg(F.count("*").alias("n"))


@query("""
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events without a pause of half an hour."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "30 minutes").alias("s")).agg(F.min("ts").alias("session_start"), F.count("*").alias("n"))
    return s.select("user_id", "session_start", "n")


@query("""
    WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click')
    SELECT p.event_id, c.event_id AS click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts
""")
def last_click_before_purchase(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: the union of both sides in order of time, the last click carried on."""
    e = table(spark, d, "events").filter("event_type in ('purchase', 'click')").select("user_id", "event_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_type").rowsBetween(Window.unboundedPreceding, 0)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("click_id", click).filter("event_type = 'purchase'").select("event_id", "click_id")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def type_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    return ranking.latest(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], F.col("ts"), F.col("event_id"))
