"""Sinks: JSON lines, CSV, the relational index of event graphs, upserts and content-addressed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators import ranking

#: Tables of the index with their columns.
INDEX = {
    "entities": ["doc_id", "entity_id", "name", "kind", "canonical_role", "aliases"],
    "events": ["doc_id", "event_id", "event_type", "main_verb", "time_normalized", "confidence"],
    "event_participants": ["doc_id", "event_id", "entity_id", "role"],
    "event_edges": ["doc_id", "edge_kind", "from_event", "to_event", "relation", "confidence"],
}


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, columns: list[str], path: str) -> None:
    """The named columns in this order, others left out, with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def index_tables(graphs: DataFrame) -> dict[str, DataFrame]:
    """The tables of (doc_id, graph). Ids repeated in a document keep their last entry."""
    n = graphs.select("doc_id", F.posexplode("graph.entities").alias("pos", "x"))
    v = graphs.select("doc_id", F.posexplode("graph.events").alias("pos", "x"))
    entities = ranking.latest(n.select("doc_id", "pos", "x.*"), ["doc_id", "entity_id"], F.col("pos"))
    events = ranking.latest(v.select("doc_id", "pos", "x.event_id", "x.event_type", "x.main_verb", F.col("x.time.normalized").alias("time_normalized"), "x.confidence"), ["doc_id", "event_id"], F.col("pos"))
    people = v.select("doc_id", "x.event_id", F.explode("x.participants").alias("p")).select("doc_id", "event_id", "p.entity_id", "p.role").distinct()
    edge = lambda kind: graphs.select("doc_id", F.lit(kind).alias("edge_kind"), F.explode(f"graph.{kind}_edges").alias("x")).select("doc_id", "edge_kind", "x.from_event", "x.to_event", "x.relation", "x.confidence")
    edges = edge("temporal").unionByName(edge("causal"))
    return {k: t.select(*INDEX[k]) for k, t in {"entities": entities, "events": events, "event_participants": people, "event_edges": edges}.items()}


def write_index(graphs: DataFrame, folder: str, reset: bool = True) -> dict[str, str]:
    """Writes the index; returns the path of each table. reset replaces, else rows are added."""
    paths = {}
    for name, t in index_tables(graphs).items():
        paths[name] = f"{folder}/{name}"
        t.write.mode("overwrite" if reset else "append").parquet(paths[name])
    return paths


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new put in or in place; of several new rows of a key the largest holds."""
    fresh = ranking.latest(new, keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def keep_run(spark: SparkSession, df: DataFrame, folder: str, content: str) -> str:
    """Writes df under a name told by its content key unless that is there; returns the path."""
    import hashlib

    path = f"{folder}/{hashlib.sha256(content.encode()).hexdigest()[:16]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").parquet(path)
    return path
