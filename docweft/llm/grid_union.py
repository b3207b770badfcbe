"""Groups from pairwise links: connected components on a two-dimensional grid of blocks.

Vertices are hashed into blocks, so an edge lies in one cell (block of its one end, block of the
other); there are always several cells. In each round every cell runs a union-find of its own edges, and each vertex
hears from its row and column of cells which representatives they gave it. It takes the smallest as parent; the
other representatives are linked to that parent and go on, all other vertices leave. Rounds go on until no
edge is left, that is until the parents are stable; parents are then followed back through the rounds.

The edges of each cell are counted first, and a cell with more than it should hold, as a vertex of huge degree makes it, is
split by the hash of the edge: any set of edges may be united by itself, as all its vertices hear of it.
So no task ever holds a whole group or all links of a vertex.

Defined results: links with a null end and self links are ignored, repeats and both directions count
once, an empty table gives an empty result. The group identifier is the smallest member.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions import unions
from docweft.session import cut

#: Edges that one cell should hold; about 200 bytes each in a worker.
CELL_EDGES = 500_000
#: Blocks a side of the smallest grid.
LEAST_SIDE = 2


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """The local union-find of one cell: for each of its vertices the representative, the first by rank and name."""
    codes, names = pd.factorize(np.concatenate([pdf["a"].to_numpy(object), pdf["b"].to_numpy(object)]))
    ranks = np.empty(len(names), np.int64)
    ranks[codes] = np.concatenate([pdf["ra"].to_numpy(np.int64), pdf["rb"].to_numpy(np.int64)])
    order = pd.DataFrame({"rank": ranks, "name": names}).sort_values(["rank", "name"]).index.to_numpy()
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    half = len(pdf)
    root = order[unions.roots(place[codes[:half]], place[codes[half:]], len(names))[place]]
    return pd.DataFrame({"v": names, "rep": names[root], "rank": ranks[root]})


def cells(edges: DataFrame, number: int, cell_edges: int = CELL_EDGES, n: int | None = None) -> DataFrame:
    """edges (a, b) with their cell of the grid (r, c, part) and the ranks of this round (ra, rb)."""
    n = edges.count() if n is None else n
    side = max(LEAST_SIDE, math.ceil(math.sqrt(n / cell_edges)) + 1)
    # Ranks are drawn anew each round: along a chain a third of the vertices leaves, whatever its order.
    rank = lambda c: F.xxhash64(c, F.lit(number))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    placed = edges.withColumns({"ra": rank("a"), "rb": rank("b"), "r": block("a"), "c": block("b")})
    # One row a cell, side x side in all, so the broadcast is bounded by edges / cell_edges.
    full = placed.groupBy("r", "c").agg(F.ceil(F.count("*") / cell_edges).alias("parts"))
    return placed.join(F.broadcast(full), ["r", "c"]).withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts"))).drop("parts")


def components(links: DataFrame, a: str, b: str, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(member string, group_id string) of every vertex with a link to another; see the module."""
    heard_as = "v string, rep string, rank long"
    edges = links.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    settled: list[DataFrame] = []
    number = 0
    while (n := edges.count()) > 0:
        united = cells(edges, number, cell_edges, n).groupBy("r", "c", "part").applyInPandas(_cell, heard_as)
        # One representative a vertex from each cell of its row and column.
        heard = cut(united.groupBy("v").agg(F.min(F.struct("rank", "rep"))["rep"].alias("parent"), F.collect_set("rep").alias("reps")))
        settled.append(heard.filter("v <> parent").select("v", F.col("parent").alias("rep")))
        # What goes on: representatives that share a vertex, and those with a better parent themselves.
        shared = heard.filter(F.size("reps") > 1).select(F.col("parent").alias("a"), F.explode("reps").alias("b"))
        own = heard.filter(F.array_contains("reps", F.col("v")) & (F.col("v") != F.col("parent"))).select(F.col("parent").alias("a"), F.col("v").alias("b"))
        edges = cut(shared.unionByName(own).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        number += 1
    if not settled:
        return edges.select(F.col("a").alias("member"), F.col("b").alias("group_id"))
    # Back through the rounds: a parent of one round may have got a parent in a later one.
    label = settled[-1]
    for earlier in reversed(settled[:-1]):
        up = label.select(F.col("v").alias("rep"), F.col("rep").alias("top"))
        moved = earlier.join(up, "rep", "left").select("v", F.coalesce("top", "rep").alias("rep")).filter("v <> rep")
        label = cut(label.join(earlier.select("v"), "v", "left_anti").unionByName(moved))
    heads = label.groupBy("rep").agg(F.min("v").alias("least")).withColumn("group_id", F.least("least", "rep"))
    members = label.join(heads.select("rep", "group_id"), "rep").select(F.col("v").alias("member"), "group_id")
    return members.unionByName(heads.select(F.col("rep").alias("member"), "group_id"))


def event_groups(matches: DataFrame, events: DataFrame, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(event_id, group_id): groups of two or more events that confirmed pairs link, directly or through others.

    same_event null or false links nothing. Ids of pairs are compared trimmed and in upper case; an end that
    no event has makes the pair void. Events whose ids differ in case or outer blanks alone are all linked by a pair that names them.
    """
    clean = lambda c: F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    known = events.filter(F.col("event_id").isNotNull()).select(clean(F.col("event_id")).alias("k"), "event_id").distinct()
    keys = known.select("k").distinct()
    pairs = matches.filter("same_event").select(clean(F.col("event_a")).alias("x"), clean(F.col("event_b")).alias("y")).distinct()
    for side in ("x", "y"):
        pairs = pairs.join(keys.withColumnRenamed("k", side), side, "left_semi")
    pairs = cut(pairs)
    found = components(pairs, "x", "y", cell_edges)
    # A pair of an event with itself links those that share its id but for case and blanks.
    selves = pairs.filter("x = y").select(F.col("x").alias("member"), F.col("x").alias("group_id")).join(found, "member", "left_anti")
    members = cut(known.join(found.unionByName(selves).withColumnRenamed("member", "k"), "k").select("event_id", F.col("group_id").alias("g")))
    heads = members.groupBy("g").agg(F.min("event_id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return members.join(heads.select("g", "group_id"), "g").select("event_id", "group_id")
