"""Nested event graphs (one struct a document): normal form, views, checks and quality measures.

The struct is sources.readers.GRAPH. Missing lists count as empty, missing ids are filled by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import graphs
from docweft.operators.metrics import share


def items(graph: str, name: str) -> Column:
    """A list of the graph, empty for null."""
    return F.coalesce(F.col(f"{graph}.{name}"), F.array().cast(_array_type(name)))


def _array_type(name: str) -> str:
    from docweft.sources.readers import GRAPH

    at = GRAPH.index(f"{name}:") + len(name) + 1
    depth, end = 0, at
    while True:
        depth += {"<": 1, ">": -1}.get(GRAPH[end], 0)
        end += 1
        if depth == 0 and GRAPH[end - 1] == ">":
            return GRAPH[at:end]


def normalise(df: DataFrame, graph: str = "graph") -> DataFrame:
    """Ids filled by the position in the list (E1.., EV1..), kinds in upper case and from the vocabulary, verbs trimmed, edges without ends dropped."""
    kinds = ("PERSON", "ORG", "AGENCY", "COURT")
    entity = lambda x, i: x.withField("entity_id", F.coalesce(T.missing(x["entity_id"]), F.concat(F.lit("E"), (i + 1).cast("string")))).withField("kind", F.when(F.upper(T.strip(x["kind"])).isin(*kinds), F.upper(T.strip(x["kind"]))).otherwise("UNKNOWN"))
    event = lambda x, i: x.withField("event_id", F.coalesce(T.missing(x["event_id"]), F.concat(F.lit("EV"), (i + 1).cast("string")))).withField("main_verb", T.strip(F.coalesce(x["main_verb"], F.lit(""))))
    edge = lambda x: T.missing(x["from_event"]).isNotNull() & T.missing(x["to_event"]).isNotNull()
    out = F.struct(
        F.transform(items(graph, "entities"), entity).alias("entities"), F.transform(items(graph, "events"), event).alias("events"),
        F.filter(items(graph, "temporal_edges"), edge).alias("temporal_edges"), F.filter(items(graph, "causal_edges"), edge).alias("causal_edges"),
    )
    return df.withColumn(graph, out)


def canonical_edges(df: DataFrame, key: str, graph: str = "graph") -> DataFrame:
    """(key, a, b, relation, kind) distinct; AFTER is turned round, so that a comes before b."""
    part = lambda kind: df.select(key, F.lit(kind).alias("kind"), F.explode(f"{graph}.{kind}_edges").alias("x"))
    e = part("temporal").unionByName(part("causal"))
    back = F.upper(F.col("x.relation")) == "AFTER"
    a, b = F.when(back, F.col("x.to_event")).otherwise(F.col("x.from_event")), F.when(back, F.col("x.from_event")).otherwise(F.col("x.to_event"))
    relation = F.when(F.col("kind") == "temporal", T.temporal_relation(F.col("x.relation"))).otherwise(F.upper("x.relation"))
    return e.select(key, a.alias("a"), b.alias("b"), relation.alias("relation"), "kind").distinct()


def linearise(graph: str = "graph", events: int = 120, entities: int = 80) -> Column:
    """Text of the first events and entities, one a line."""
    e = F.transform(F.slice(items(graph, "entities"), 1, entities), lambda x: F.concat(F.lit("[ENTITY] "), F.coalesce(x["name"], F.lit("")), F.lit(" ("), F.coalesce(x["kind"], F.lit("UNKNOWN")), F.lit(")")))
    v = F.transform(F.slice(items(graph, "events"), 1, events), lambda x: F.concat_ws(" ", F.lit("[EVENT]"), x["event_type"], x["main_verb"], x["time"]["normalized"]))
    return F.array_join(F.concat(e, v), "\n")


def digest(df: DataFrame, key: str, graph: str = "graph") -> DataFrame:
    """(key, n_entities, n_events, n_edges, n_grounded): grounded events have evidence ids."""
    return df.select(
        key, F.size(items(graph, "entities")).alias("n_entities"), F.size(items(graph, "events")).alias("n_events"), (F.size(items(graph, "temporal_edges")) + F.size(items(graph, "causal_edges"))).alias("n_edges"),
        F.size(F.filter(items(graph, "events"), lambda x: F.coalesce(F.size(x["evidence"]["sentence_ids"]) > 0, F.lit(False)))).alias("n_grounded"),
    )


def same_ids(a: str, b: str) -> Column:
    """Have two graphs the same sets of entity and event ids and of edge ends? Then one may stand for the other."""
    ids = lambda g, name, f: F.array_sort(F.array_distinct(F.transform(items(g, name), f)))
    ends = lambda x: F.concat_ws(">", x["from_event"], x["to_event"])
    tests = [("entities", lambda x: x["entity_id"]), ("events", lambda x: x["event_id"]), ("temporal_edges", ends), ("causal_edges", ends)]
    out = F.lit(True)
    for name, f in tests:
        out = out & (ids(a, name, f) == ids(b, name, f))
    return out


def incident_edges(df: DataFrame, key: str, graph: str = "graph") -> DataFrame:
    """(key, event_id, edges): each event with its edges as (other, relation, kind); none gives an empty list."""
    e = canonical_edges(df, key, graph)
    ends = e.select(key, F.col("a").alias("event_id"), F.struct(F.col("b").alias("other"), "relation", "kind").alias("x")).unionByName(e.select(key, F.col("b").alias("event_id"), F.struct(F.col("a").alias("other"), "relation", "kind").alias("x")))
    v = df.select(key, F.explode(f"{graph}.events.event_id").alias("event_id")).distinct()
    return v.join(ends, [key, "event_id"], "left").groupBy(key, "event_id").agg(F.array_sort(F.collect_set("x")).alias("edges"))


def quality(df: DataFrame, key: str, graph: str = "graph") -> DataFrame:
    """One row of shares over documents: non_empty, participants_ok, temporal_acyclic, dates_ok, causal_acyclic, loop_free, rich_events, rich_edges and their mean."""
    g = df.select(key, F.col(graph).alias("g"))
    ids = F.transform(items("g", "entities"), lambda x: x["entity_id"])
    people = F.flatten(F.transform(items("g", "events"), lambda x: F.coalesce(F.transform(x["participants"], lambda p: p["entity_id"]), F.array().cast("array<string>"))))
    base = g.select(key, F.size(items("g", "events")).alias("nv"), (F.size(items("g", "temporal_edges")) + F.size(items("g", "causal_edges"))).alias("ne"), (F.size(F.array_except(people, ids)) == 0).alias("ok"))
    e = canonical_edges(g, key, "g")
    tagged = lambda x: x.select(F.concat_ws("\u0001", key, "a").alias("a"), F.concat_ws("\u0001", key, "b").alias("b"))
    on_cycle = lambda x, name: graphs.on_cycles(tagged(x)).select(F.substring_index("a", "\u0001", 1).alias(key)).distinct().withColumn(name, F.lit(True))
    t_cycle = on_cycle(e.filter("kind = 'temporal' and relation <> 'OVERLAP'"), "t_cycle")
    c_cycle = on_cycle(e.filter("kind = 'causal'"), "c_cycle")
    loops = e.filter("a = b").select(key).distinct().withColumn("loop", F.lit(True))
    dates = g.select(key, F.explode("g.events").alias("v")).select(key, "v.event_id", F.col("v.time.normalized").alias("t"))
    late = e.filter("kind = 'temporal' and relation = 'NEXT'").join(dates.select(key, F.col("event_id").alias("a"), F.col("t").alias("ta")), [key, "a"]).join(dates.select(key, F.col("event_id").alias("b"), F.col("t").alias("tb")), [key, "b"])
    late = late.filter(~graphs.consistent_order(F.col("ta"), F.lit("BEFORE"), F.col("tb"))).select(key).distinct().withColumn("late", F.lit(True))
    x = base
    for part in (t_cycle, c_cycle, loops, late):
        x = x.join(part, key, "left")
    no = lambda c: F.avg(F.col(c).isNull().cast("double"))
    out = x.agg(
        F.count("*").alias("n"), F.avg((F.col("nv") > 0).cast("double")).alias("non_empty"), F.avg(F.col("ok").cast("double")).alias("participants_ok"), no("t_cycle").alias("temporal_acyclic"), no("late").alias("dates_ok"),
        no("c_cycle").alias("causal_acyclic"), no("loop").alias("loop_free"), F.least(F.avg("nv") / 4, F.lit(1.0)).alias("rich_events"), F.least(F.avg("ne") / 2, F.lit(1.0)).alias("rich_edges"),
    )
    parts = ("non_empty", "participants_ok", "temporal_acyclic", "dates_ok", "causal_acyclic", "loop_free", "rich_events", "rich_edges")
    return out.withColumn("structural", share(sum(F.col(c) for c in parts), F.lit(len(parts))))
