"""Pairs by similarity without comparing all: prefix-filtered set joins, weighted overlaps, triplets and TF-IDF."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import graphs
from docweft.session import cut

#: Cells in which the tokens are counted, for an order from rare to common.
COUNTED = 1 << 16
#: Shared tokens that a group of sets may be told by.
DEPTH = 4
#: Sets with a token from which groups are split by a second shared token.
SLICE = 50_000
#: Sets that a task takes in at once, and pairs and longer groups that it makes of them at once.
BATCH, AT_ONCE = 50_000, 2_000_000
#: By how much a step that splits a group costs more than a comparison of two sets.
COST = 16
_ENTRY = "w long, slice int, id long, n int, tail array<long>, b0 long, b1 long"
#: Entries that a task packs at once, and tokens of all sets for which there is one more part to pack them in.
PACKED, TOKENS = 400_000, 1_000_000
#: Bits of the table that tells which values may be among others.
MARKS = 1 << 22


def _depth(threshold: float) -> int:
    """Two sets that are alike but not equal share so many tokens at least, DEPTH at most."""
    return DEPTH if threshold >= 1 else max(1, min(DEPTH, math.ceil(threshold / (1 - threshold) - 1e-9)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array column, and where each row's begin and the last ends."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes (2, 3): rows 0 0 1 1 1, and 0 1 0 1 2."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _entries(counts: np.ndarray, threshold: float) -> Callable:
    """Of (id, hashes of the tokens) one row for each token of the prefix, with the tokens of the longer prefix after it and the set as 128 bits."""
    depth = _depth(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, (h, at) = batch.column(0).to_numpy(), _flat(batch.column(1))
            n = np.diff(at)
            row, _ = _ranges(n)
            order = np.lexsort((h, counts[h & (COUNTED - 1)], row))
            h = h[order]
            bit = (h >> 20).view(np.uint64) & np.uint64(127)
            flags = np.left_shift(np.uint64(1), bit & np.uint64(63))
            bits = [np.bitwise_or.reduceat(np.where((bit >= 64) == high, flags, np.uint64(0)), at[:-1]).view(np.int64) for high in (False, True)]
            prefix = (n - np.ceil(threshold * n - 1e-9) + 1).astype(np.int64)
            row, k = _ranges(np.minimum(prefix, n))
            first = at[row] + k
            tails = np.minimum(prefix + depth - 1, n)[row] - k - 1
            # A common token is met in slices of the tokens that are shared next.
            slices = counts[h[first] & (COUNTED - 1)] // SLICE + 1 if depth > 1 else np.ones(len(row), np.int64)
            of, i = _ranges(np.where(slices > 1, np.minimum(tails, prefix[row] - k), 1))
            cell = np.where(slices[of] > 1, (h[np.minimum(first[of] + 1 + i, len(h) - 1)] >> 8) % slices[of], 0)
            of, cell = np.divmod(np.unique(of * slices.max() + cell), slices.max())
            row, first, tails = row[of], first[of], tails[of]
            _, i = _ranges(tails)
            tail = pa.ListArray.from_arrays(np.r_[0, np.cumsum(tails)].astype(np.int32), pa.array(h[np.repeat(first, tails) + 1 + i]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first], cell.astype(np.int32), ids[row], n[row].astype(np.int32))] + [tail] + [pa.array(b[row]) for b in bits], names=[c.split()[0] for c in _ENTRY.split(", ")])

    return run


class _Meeting:
    """Sets with a token in common: those that may reach the threshold, by pairs of ids.

    A group of sets that share their first tokens is split by the token that they share next, as long as that costs less than to compare all pairs
    and the sets must share as many. Sets are compared as bits: a bit that one of them has needs a token that the other has not.
    """

    def __init__(self, threshold: float, ids: np.ndarray, n: np.ndarray, tail: np.ndarray, at: np.ndarray, bits: list[np.ndarray]):
        self.threshold, self.depth = threshold, _depth(threshold)
        self.ids, self.n, self.tail, self.at, self.bits = ids, n, tail, at, bits
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def split(self, group: np.ndarray, row: np.ndarray, k: np.ndarray, level: int) -> None:
        """Entries (group, row, how many tokens of the row's tail are used), sorted by group."""
        start = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
        m = np.diff(np.r_[start, len(group)])
        steps = np.maximum(0, np.diff(self.at)[row] - k - (self.depth - 1 - level))
        wide = (m.astype(float) ** 2 > COST * np.add.reduceat(steps, start)) & (m > 1) if level < self.depth else np.zeros(len(m), bool)
        self.compare(start[(m > 1) & ~wide], m[(m > 1) & ~wide], row)
        of = np.repeat(wide, m)
        group, row, k, steps = group[of], row[of], k[of], steps[of]
        if not len(group):
            return
        # Whole groups at once, as many as fit.
        firsts = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
        before = (np.cumsum(steps) - steps)[firsts]
        for part in np.split(np.arange(len(firsts)), np.nonzero(np.diff(before // AT_ONCE))[0] + 1):
            lo, hi = firsts[part[0]], firsts[part[-1] + 1] if part[-1] + 1 < len(firsts) else len(group)
            e, i = _ranges(steps[lo:hi])
            g, r, used = group[lo:hi][e], row[lo:hi][e], k[lo:hi][e] + i
            token = self.tail[self.at[r] + used]
            order = np.lexsort((token, g))
            g, token = g[order], token[order]
            new = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (token[1:] != token[:-1])]) if len(g) else g
            if len(g):
                self.split(new, r[order], used[order] + 1, level + 1)

    def compare(self, start: np.ndarray, m: np.ndarray, row: np.ndarray) -> None:
        """All pairs of each group, a part of the pairs at once."""
        _, i = _ranges(m)
        left, at = np.repeat(m, m) - 1 - i, np.repeat(start, m) + i
        before = np.cumsum(left) - left
        for part in np.split(np.arange(len(at)), np.nonzero(np.diff(before // AT_ONCE))[0] + 1):
            e, i = _ranges(left[part])
            a, b = row[at[part][e]], row[at[part][e] + 1 + i]
            na, nb = self.n[a], self.n[b]
            differ = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in self.bits)
            ok = (differ <= (1 - self.threshold) / (1 + self.threshold) * (na + nb) + 1e-9) & (np.minimum(na, nb) >= self.threshold * np.maximum(na, nb) - 1e-9) & (self.ids[a] != self.ids[b])
            x, y = self.ids[a[ok]], self.ids[b[ok]]
            self.found.append((np.minimum(x, y), np.maximum(x, y)))


def _meet(threshold: float) -> Callable:
    """Rows of _ENTRY come sorted by token and slice, and a group may span batches; whole groups are met, BATCH sets or more at once."""

    def met(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        w, cell, ids, n, b0, b1 = (t[c].combine_chunks().to_numpy() if t.num_rows else np.zeros(0, np.int64) for c in ("w", "slice", "id", "n", "b0", "b1"))
        pairs = np.zeros((2, 0), np.int64)
        if len(w):
            tail, at = _flat(t["tail"].combine_chunks())
            meeting = _Meeting(threshold, ids, n.astype(np.int64), tail, at, [b0, b1])
            group = np.cumsum(np.r_[True, (w[1:] != w[:-1]) | (cell[1:] != cell[:-1])])
            meeting.split(group, np.arange(len(w)), np.zeros(len(w), np.int64), 1)
            if meeting.found:
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*meeting.found)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH:
                w, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                last = np.nonzero((w != w[-1]) | (cell != cell[-1]))[0]
                if len(last):  # the last group may go on
                    held[-1] = batch.slice(0, last[-1] + 1)
                    yield met(held)
                    held = [batch.slice(last[-1] + 1)]
        if held:
            yield met(held)

    return run


def _planes(a: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _pack(parts: int) -> Callable:
    """Entries as (part, block): those of a part are sorted and compressed by column. A token of a tail keeps 16 bits; a clash only gives a group to split less."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        w, cell, ids, n, b0, b1 = (t[c].combine_chunks().to_numpy() for c in ("w", "slice", "id", "n", "b0", "b1"))
        tail, at = _flat(t["tail"].combine_chunks())
        tail, sizes = tail.astype(np.uint16), np.diff(at).astype(np.int32)
        part = (((w >> 20) + cell) % parts).astype(np.int32)
        first = np.where(sizes > 0, np.r_[tail, np.uint16(0)][at[:-1]], 0)
        order = np.lexsort((first, cell, w, part))
        part, blocks = part[order], []
        start = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0]
        for rows in np.split(order, start[1:]):
            row, i = _ranges(sizes[rows])
            own = tail[at[rows][row] + i]
            raw = np.array([len(rows), len(own)], np.int64).tobytes() + b"".join(_planes(x[rows]) for x in (w, cell, ids, n, sizes)) + own.tobytes() + b0[rows].tobytes() + b1[rows].tobytes()
            blocks.append(np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(part[start]), pa.array(blocks, pa.binary())], names=["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield packed(held)
                held = []
        if sum(b.num_rows for b in held):
            yield packed(held)

    return run


def _unpacked(block: bytes) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(block)[8:], int(np.frombuffer(block, np.int64, 1)[0]), "zstd", asbytes=True)
    m, k = np.frombuffer(raw, np.int64, 2)
    out, at = [], 16
    for kind in (np.int64, np.int32, np.int64, np.int32, np.int32):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, m * size, at).reshape(size, m).T).view(kind).ravel())
        at += m * size
    for kind, n in ((np.uint16, k), (np.int64, m), (np.int64, m)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted by part: the entries of each part, sorted by token and slice."""

    def entries(held: list[bytes]) -> pa.RecordBatch:
        w, cell, ids, n, sizes, tail, b0, b1 = (np.concatenate(x) for x in zip(*map(_unpacked, held)))
        order, at = np.lexsort((cell, w)), np.cumsum(sizes) - sizes
        row, i = _ranges(sizes[order])
        tails = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes[order])].astype(np.int32), pa.array(tail[at[order][row] + i].astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (w, cell, ids, n)] + [tails] + [pa.array(b[order]) for b in (b0, b1)], names=[c.split()[0] for c in _ENTRY.split(", ")])

    held: list[bytes] = []
    last = None
    for batch in batches:
        for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and part != last:
                yield entries(held)
                held = []
            last = part
            held.append(block.as_py())
    if held:
        yield entries(held)


def _marked(df: DataFrame, column: str, among: DataFrame) -> DataFrame:
    """df with may: false only where the column's value is not in the same column of among. The marks are broadcast and of a fixed size, so nothing of df is shuffled."""
    cell = F.pmod(F.xxhash64(column), F.lit(MARKS))
    bit = F.expr("shiftleft(1L, cast(cell % 64 as int))")
    marks = cut(among.select(cell.alias("cell")).groupBy(F.expr("cell div 64").alias("word")).agg(F.bit_or(bit).alias("bits")))
    there = df.withColumn("cell", cell).withColumn("word", F.expr("cell div 64")).join(F.broadcast(marks), "word", "left")
    return there.withColumn("may", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("cell", "word", "bits")


def jaccard_classes(df: DataFrame, key: str, tokens: Column, threshold: float = 0.8) -> DataFrame:
    """(key, class_id, n_links): rows whose token sets reach the Jaccard threshold, as one row per key.

    Equal sets are one class first, so copies are never paired; sets without a copy are not shuffled for that. Representatives of classes that reach the threshold
    share their first tokens, from rare to common, within prefixes that are as much longer; they meet by these, packed in blocks. What passes as bits is verified, and
    only sets that may be in such a pair are shuffled for it. class_id is the smallest key linked directly or through others, n_links the number of other keys linked
    directly. Empty and null sets link to nothing.
    """
    sets = df.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(tokens)).alias("t")).filter("size(t) > 0")
    sets = cut(sets.withColumn("digest", F.substring(F.unhex(F.sha2(F.to_json("t"), 256)), 1, 16)).distinct(), "zstd")
    sets = _marked(sets, "digest", sets.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1"))
    one = sets.filter("not may").select("digest", "t", F.col("key").alias("rep"), F.lit(1).cast("long").alias("copies"))
    more = sets.filter("may").groupBy("digest").agg(F.first(F.to_json("t")).alias("t"), F.min("key").alias("rep"), F.count("*").alias("copies"))
    reps = cut(one.unionByName(more.withColumn("t", F.from_json("t", "array<string>"))).withColumn("id", F.monotonically_increasing_id()), "zstd")
    hashes = reps.select("id", F.transform("t", lambda x: F.xxhash64(x)).alias("h"))
    counts = np.zeros(COUNTED, np.int64)
    for cell, m in hashes.select(F.explode("h").alias("h")).groupBy((F.col("h").bitwiseAND(F.lit(COUNTED - 1))).alias("cell")).agg(F.count("*")).collect():
        counts[cell] = m
    entries, pack, meet = _entries(counts, threshold), _pack(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // TOKENS)), _meet(threshold)
    blocks = hashes.mapInArrow(lambda batches: pack(entries(batches)), "part int, block binary").repartition("part").sortWithinPartitions("part")
    near = cut(blocks.mapInArrow(lambda batches: meet(_unpack(batches)), "a long, b long").distinct())
    reps = _marked(reps, "id", near.select(F.explode(F.array("a", "b")).alias("id")))
    met = cut(reps.filter("may").drop("may"), "zstd")
    # A text is shorter than an array, when shuffled.
    full = near.join(met.select(F.col("id").alias("a"), F.to_json("t").alias("ta")), "a").join(met.select(F.col("id").alias("b"), F.to_json("t").alias("tb")), "b")
    ta, tb = (F.from_json(c, "array<string>") for c in ("ta", "tb"))
    linked = cut(full.filter(T.jaccard(ta, tb) >= threshold - 1e-12).select("a", "b"))
    size = met.select("id", "copies")
    partners = graphs.both_ways(linked).join(size.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("copies").alias("others"))
    groups = graphs.components(linked).select(F.col("id").cast("long").alias("id"), F.col("component").cast("long").alias("component"))
    of = met.select("id", "digest", "rep", "copies").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = of.groupBy("component").agg(F.min("rep").alias("class_id"))
    others = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    info = cut(of.join(heads, "component").join(partners, "id", "left").select("digest", "rep", "copies", "class_id", others.alias("n_links")))
    info = info.unionByName(reps.filter("not may").select("digest", "rep", "copies", F.col("rep").alias("class_id"), (F.col("copies") - 1).alias("n_links")))
    # Only sets with copies have more keys than their own.
    own = info.filter("copies = 1").select(F.col("rep").alias("key"), "class_id", "n_links")
    copies = sets.filter("may").select("key", "digest").join(info.filter("copies > 1").select("digest", "class_id", "n_links"), "digest")
    return own.unionByName(copies.select("key", "class_id", "n_links")).distinct().withColumnRenamed("key", key)


def tf_idf(df: DataFrame, key: str, text: str, top: int = 3000) -> DataFrame:
    """(key, word, weight): raw counts times ln(N/df), unsmoothed, for the top words by df (ties by word), rows of length 1."""
    words = df.select(key, F.explode(T.tokens(F.col(text), r"[a-z][a-z0-9_]{2,}")).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("docs"))
    vocabulary = words.groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(top)
    w = words.join(F.broadcast(vocabulary), "word").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * F.log(F.col("docs") / F.col("df")))
    size = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return w.join(size, key).select(key, "word", F.when(F.col("size") > 0, F.col("w") / F.col("size")).otherwise(0.0).alias("weight"))


def multiset_jaccard(queries: DataFrame, rows: DataFrame, key: str, item: str) -> DataFrame:
    """(query_id, id, score): sum of minima over sum of maxima of item counts, for pairs that share an item; (key, item) rows are counted."""
    count = lambda x, k: x.groupBy(F.col(key).alias(k), item).agg(F.count("*").alias(f"n_{k}"))
    q, r = count(queries, "query_id"), count(rows, "id")
    both = q.join(r, item).groupBy("query_id", "id").agg(F.sum(F.least("n_query_id", "n_id")).alias("both"))
    tq, tr = q.groupBy("query_id").agg(F.sum("n_query_id").alias("tq")), r.groupBy("id").agg(F.sum("n_id").alias("tr"))
    return both.join(tq, "query_id").join(tr, "id").filter("query_id <> id").select("query_id", "id", (F.col("both") / (F.col("tq") + F.col("tr") - F.col("both"))).alias("score"))
