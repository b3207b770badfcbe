"""Filling containers of fixed capacity with whole items, certified by lower bounds.

Items are spread over partitions that each hold a bounded number of them, evenly by size class, so
that a partition sees the size mix of the whole. Each partition packs its items by best-fit decreasing and
compares the bin count with a lower bound from dual feasible functions. Full enough containers of
certified partitions are final; partitions with a gap give the items of their containers that are not full
back, and these items of all partitions meet again in fewer and larger partitions and are packed anew. That goes on as long
as it saves containers; a packing that saves none is dropped. There are always two partitions at least, so that items can be exchanged.

An item larger than the capacity is split into pieces of the capacity and a rest; the rest is packed
like an item. Items of null size are left out, items of size 0 take no room but get a container.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import cut

#: Items a partition packs at once.
PART_ITEMS = 4_000
#: Times as many meet in a partition of what is packed anew.
MEET = 4
#: Share of a container from which it counts as full.
FULL = 0.99
OUT = "item long, piece int, size long, part long, bin long, filled long, lower_bound long, round int"


def byte_tokens(text: Column) -> Column:
    """Size in tokens of a byte-level tokenizer: one for each UTF-8 byte and one end token."""
    return F.octet_length(text).cast("long") + 1


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of the volume bound and the dual feasible functions
    u(k) (rounding to multiples of 1/k) and U(e) (items over 1-e count whole, items under e nothing)."""
    if not len(sizes):
        return 0
    x = sizes.astype(np.int64)
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 21):
        up = (k + 1) * x
        v = np.where(up % capacity == 0, x * k, (up // capacity) * capacity)  # in units of capacity * k
        best = max(best, -(-int(v.sum()) // (capacity * k)))
    edges = np.unique(np.quantile(x[x <= capacity // 2], np.linspace(0, 1, 21)).astype(np.int64)) if (x <= capacity // 2).any() else []
    for e in edges:
        v = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int(v.sum()) // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item, and how many there are; each item goes where least room is left."""
    where = np.empty(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect.bisect_left(room, (s, -1))
        if at < len(room):
            left, c = room.pop(at)
        else:
            left, c, n = capacity, n, n + 1
        where[i] = c
        if left > s:
            bisect.insort(room, (left - s, c))
    return where, n


def _pack(pdf: pd.DataFrame, capacity: int, number: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "item", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes = pdf["size"].to_numpy(np.int64)
    where, n = best_fit_decreasing(sizes, capacity)
    filled = np.bincount(where, weights=sizes, minlength=n).astype(np.int64)
    return pdf[["item", "piece", "size", "part"]].assign(bin=where, filled=filled[where], lower_bound=lower_bound(sizes, capacity), round=number)


def _packer(capacity: int, number: int):
    return lambda pdf: _pack(pdf, capacity, number)


def _oversized(items: DataFrame, capacity: int) -> DataFrame:
    """(item, piece, size): full pieces of what exceeds a container, and rests or whole items."""
    full = (F.col("size") - 1).cast("long")
    n = F.when(F.col("size") > capacity, F.floor(full / capacity)).otherwise(F.lit(0)).cast("int")
    return items.select("item", F.explode(F.sequence(F.lit(0), n)).alias("piece"), n.alias("n"), "size").select(
        "item", "piece", F.when(F.col("piece") < F.col("n"), F.lit(capacity).cast("long")).otherwise(F.col("size") - F.col("n").cast("long") * capacity).alias("size")
    )


def pack(items: DataFrame, item: str, size: Column, capacity: int, part_items: int = PART_ITEMS) -> DataFrame:
    """(item, piece, size, part, bin, filled, lower_bound, round): the container (round, part, bin) of every item.

    piece counts the parts of an item that exceeds the capacity, 0 for others. lower_bound is of the partition.
    """
    left = cut(_oversized(items.select(F.col(item).cast("long").alias("item"), size.alias("size")).filter("item is not null and size is not null"), capacity))

    def packed(rows: DataFrame, number: int, parts: int) -> DataFrame:
        # Sizes are spread evenly: equal sizes go round by the hash of their ids.
        part = F.pmod(F.xxhash64("item", "piece", F.lit(number)), F.lit(parts)).cast("long")
        return cut(rows.withColumn("part", part).groupBy("part").applyInPandas(_packer(capacity, number), OUT))

    def bins(rows: DataFrame) -> int:
        return rows.groupBy("part", "bin").agg(F.lit(1)).count()

    state, done, number = packed(left, 0, max(2, -(-left.count() // part_items))), [], 0
    while True:
        # A partition at its bound is certified; of the others, containers that are not full go on.
        gap = state.groupBy("part").agg((F.max("bin") + 1 > F.max("lower_bound")).alias("open"))
        marked = state.join(gap, "part").withColumn("again", F.col("open") & (F.col("filled") < int(capacity * FULL)))
        again = cut(marked.filter("again").drop("open", "again"))
        number += 1
        anew = packed(again.select("item", "piece", "size"), number, max(1, -(-again.count() // (MEET * part_items))))
        if bins(anew) >= bins(again):
            done.append(state)
            break
        done.append(marked.filter("not again").drop("open", "again"))
        state = anew
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*[c.split()[0] for c in OUT.split(", ")])


def summary(packed: DataFrame, capacity: int) -> DataFrame:
    """One row (items, containers, tokens, bound, unused): how many containers any packing needs at least, by the dual feasible functions over all pieces,
    and the share of the containers' room that is unused. All by sums, whatever the number of pieces."""
    size = F.col("size")
    sums = [F.sum(size).alias("s0")]
    for k in range(1, 21):
        up = size * (k + 1)
        sums.append((F.sum(F.when(up % capacity == 0, size * k).otherwise(F.floor(up / capacity) * capacity)) / k).alias(f"u{k}"))
    for k in range(1, 21):
        e = capacity * k // 40
        sums.append(F.sum(F.when(size > capacity - e, F.lit(capacity)).when(size < e, 0).otherwise(size)).alias(f"e{k}"))
    total = packed.agg(F.count_distinct("item").alias("items"), *sums)
    used = packed.select("round", "part", "bin").distinct().agg(F.count("*").alias("containers"))
    bound = F.ceil(F.greatest(*[F.col(c) for c in total.columns[1:]]) / capacity - 1e-9)
    both = total.crossJoin(F.broadcast(used)).filter("containers > 0")
    return both.select("items", "containers", F.col("s0").alias("tokens"), bound.cast("long").alias("bound"), F.round(1 - F.col("s0") / (F.col("containers") * capacity), 6).alias("unused"))


def oversized(packed: DataFrame) -> DataFrame:
    """The items that no container holds whole: those that came out in more than one piece."""
    return packed.filter("piece = 1").select("item").distinct()
