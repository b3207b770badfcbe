"""Graph operators on edge tables (a, b): degrees, hops, components, cycles, and the merging of chunk graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import unions
from docweft.session import cut


def match_edges(matches: DataFrame) -> DataFrame:
    """(a, b) distinct with a < b, from confirmed matches; ids in upper case and trimmed."""
    a, b = F.upper(T.strip(F.col("event_a"))), F.upper(T.strip(F.col("event_b")))
    return matches.filter("same_event").filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): how often an id is an end; a self loop counts twice."""
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def incident(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    one = edges.join(seeds.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")
    two = edges.join(seeds.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    return one.unionByName(two).distinct()


def hops(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, hop): the fewest links from a seed, up to depth; only new ids go on, so cycles end."""
    links = both_ways(edges)
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    front = seen
    for k in range(1, depth + 1):
        front = front.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen


#: Edges that a task unites at once.
EDGES = 500_000


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each vertex with the smallest one that the edges at hand link it to, for every EDGES edges of a partition."""
    held: list[pd.DataFrame] = []
    size = 0

    def flush() -> pd.DataFrame:
        pdf = pd.concat(held)
        codes, names = pd.factorize(np.concatenate([pdf["a"].to_numpy(object), pdf["b"].to_numpy(object)]), sort=True)
        root = unions.roots(codes[: len(pdf)], codes[len(pdf) :], len(names))
        return pd.DataFrame({"a": names[root], "b": names})

    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= EDGES:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is linked directly or through others; ids are compared as strings.

    Every task first unites the edges that it holds. Each vertex then becomes the neighbour of the lowest rank, and edges lie between what their ends became. Ranks
    are drawn anew each round, so about half of the vertices of a chain go, however its ids are ordered, and rounds grow with the logarithm of its length. Partial
    minima are taken before each shuffle. Each round is written to the shared folder.
    """
    known = edges.filter("a is not null and b is not null").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    united = lambda x: x.distinct().mapInPandas(_unite, "a string, b string")
    left = cut(united(known))
    labels = left.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    left, k = left.filter("a <> b"), 0
    while not left.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        lowest = both_ways(left).groupBy("src").agg(F.min(ranked("dst")).alias("near"))
        step = cut(lowest.select(F.col("src").alias("was"), F.least(ranked("src"), "near")["id"].alias("next")))
        of = lambda c: step.select(F.col("was").alias(c), F.col("next").alias(f"{c}_next"))  # noqa: B023, E731
        moved = left.join(of("a"), "a").join(of("b"), "b").filter("a_next <> b_next")
        left = cut(united(moved.select(F.least("a_next", "b_next").alias("a"), F.greatest("a_next", "b_next").alias("b"))).filter("a <> b"))
        labels = cut(labels.join(of("label"), "label", "left").select("id", F.coalesce("label_next", "label").alias("label")))
        k += 1
    heads = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(heads, "label").select("id", "component")


#: Levels of ids that one written round of on_cycles peels off.
LEVELS = 3


def on_cycles(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(a, b): directed edges that remain after peeling off ids without an edge in or without an edge out; empty for acyclic graphs.

    Raises where more than most rounds would be needed; it never returns edges that are not peeled to the end.
    """
    left = cut(edges.filter("a is not null and b is not null").select("a", "b").distinct())
    n = left.count()
    for _ in range(most):
        for _ in range(LEVELS):
            ins, outs = left.select(F.col("b").alias("a")).distinct(), left.select(F.col("a").alias("b")).distinct()
            left = left.join(ins, "a", "left_semi").join(outs, "b", "left_semi").select("a", "b")
        left = cut(left)
        if (m := left.count()) in (0, n):
            return left
        n = m
    raise ValueError(f"chains of over {most * LEVELS} links lead to or from the cycles")


def merge_entities(entities: DataFrame, key: str = "doc_id", name: str = "name", order: str = "entity_id") -> DataFrame:
    """(key, entity_id, merged_id): entities of a document with the same normal name; the first by order gives the id.

    Blank and null names stay alone.
    """
    e = entities.select(key, "entity_id", name, order).distinct() if order != "entity_id" else entities.select(key, "entity_id", name).distinct()
    form = T.missing(T.norm_text(F.col(name)))
    e = e.withColumn("form", F.coalesce(form, F.concat(F.lit("\u0000"), "entity_id")))
    head = e.groupBy(key, "form").agg(F.min_by("entity_id", F.struct(order, "entity_id")).alias("merged_id"))
    return e.join(head, [key, "form"]).select(key, "entity_id", "merged_id").distinct()


def merge_events(events: DataFrame) -> DataFrame:
    """(doc_id, event_id, merged_id, n_refs): events alike in type, verb, time and evidence; the smallest id gives the merged one."""
    form = F.struct(F.upper("event_type"), T.norm_text(F.col("main_verb")), F.coalesce("time_kind", F.lit("")), F.coalesce("time_normalized", F.lit("")), F.coalesce("evidence_sentence_ids_json", F.lit("")))
    e = events.select("doc_id", "event_id", F.sha2(F.to_json(form), 256).alias("form")).distinct()
    head = e.groupBy("doc_id", "form").agg(F.min("event_id").alias("merged_id"), F.count("*").alias("n_refs"))
    return e.join(head, ["doc_id", "form"]).select("doc_id", "event_id", "merged_id", "n_refs")


def remap(edges: DataFrame, groups: DataFrame, keep_loops: bool = False) -> DataFrame:
    """(a, b, relation) with ids replaced by those of groups (id, component), loops dropped, repeats merged."""
    out = edges
    for side in ("a", "b"):
        to = groups.select(F.col("id").alias(side), F.col("component").alias("__to"))
        out = out.join(to, side, "left").withColumn(side, F.coalesce("__to", side)).drop("__to")
    return (out if keep_loops else out.filter("a <> b")).select("a", "b", "relation").distinct()


def consistent_order(time_a: Column, relation: Column, time_b: Column) -> Column:
    """Do two ISO dates agree with BEFORE or AFTER? Missing dates and other relations do."""
    bad = ((F.upper(relation) == "BEFORE") & (time_a > time_b)) | ((F.upper(relation) == "AFTER") & (time_a < time_b))
    return ~F.coalesce(bad, F.lit(False))
