"""Choosing pairs to link: scores from shared features, buckets, and degree-capped greedy acceptance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.session import cut, stored

#: What each shared feature adds to the priority of a duplicate or a relation.
DUPLICATE = {"same_sentence": 0.40, "same_verb": 0.10, "same_type": 0.08, "same_trigger": 0.09}
RELATION = {"same_time": 0.18, "time_token": 0.12, "same_verb": 0.05, "same_trigger": 0.06, "nearby": 0.10}


def pair_features(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """pairs (a, b, similarity) with booleans of what the two events share; events have one row an id. Unknown ids share nothing."""
    ids = T.sentence_numbers(F.col("evidence_sentence_ids_json"))
    e = events.select(
        "event_id", F.lower(T.strip(F.col("main_verb"))).alias("verb"), F.upper("event_type").alias("type"), T.norm_text(F.col("trigger_text")).alias("trigger"), T.missing(F.col("time_normalized")).alias("time"),
        T.token_set(F.coalesce("time_raw", F.lit("")), "[a-z0-9]{3,}").alias("tokens"), ids.alias("ids"),
    )
    side = lambda s: e.select(*[F.col(c).alias(f"{s}_{c}") for c in e.columns])
    x = pairs.join(side("a"), F.col("a") == F.col("a_event_id"), "left").join(side("b"), F.col("b") == F.col("b_event_id"), "left")
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    gap = F.abs(F.get("a_ids", F.lit(0)) - F.get("b_ids", F.lit(0)))
    return x.select(
        "a", "b", "similarity", same("verb").alias("same_verb"), same("type").alias("same_type"), same("trigger").alias("same_trigger"), same("time").alias("same_time"),
        F.coalesce(F.arrays_overlap("a_tokens", "b_tokens"), F.lit(False)).alias("time_token"), F.coalesce(F.arrays_overlap("a_ids", "b_ids"), F.lit(False)).alias("same_sentence"), F.coalesce(gap <= 2, F.lit(False)).alias("nearby"),
    )


def priority(weights: dict[str, float]) -> Column:
    out = F.col("similarity")
    for name, w in weights.items():
        out = out + F.when(F.col(name), w).otherwise(0.0)
    return out


def buckets(features: DataFrame) -> DataFrame:
    """features with bucket (relation where that priority is higher, else duplicate) and priority."""
    d, r = F.round(priority(DUPLICATE), 9), F.round(priority(RELATION), 9)
    return features.withColumns({"bucket": F.when(r > d, "relation").otherwise("duplicate"), "priority": F.greatest(d, r)})


def cap_degrees(pairs: DataFrame, group: str, cap: int) -> DataFrame:
    """Pairs accepted in order of similarity (ties by ids) while both ends have fewer than cap pairs; cap <= 0 takes all.

    Done in rounds that give the same as one pass: a pair among the first of the remaining pairs of both its ends, as many as
    these have room for, is accepted whatever happens to the others. Ranks stop at cap, so an end with most pairs is cut before the shuffle.
    """
    if cap <= 0:
        return pairs
    keep = [group, "a", "b", "similarity"]
    left = cut(pairs.select(*keep).distinct())
    used = left.select(group, F.col("a").alias("id"), F.lit(0).cast("long").alias("used")).limit(0)
    accepted = left.limit(0)
    while True:
        ends = left.select("*", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"), F.size(F.array_distinct(F.array("a", "b"))).alias("n_ends"))
        rank = F.row_number().over(Window.partitionBy(group, "id").orderBy(F.desc("similarity"), "a", "b"))
        first = ends.withColumn("r", rank).filter(F.col("r") <= cap).join(used, [group, "id"], "left").filter(F.col("r") <= cap - F.coalesce("used", F.lit(0)))
        now = cut(first.groupBy(*keep).agg(F.count("*").alias("n"), F.first("n_ends").alias("n_ends")).filter("n = n_ends").select(*keep))
        if now.isEmpty():
            return accepted
        accepted = accepted.unionByName(now)
        more = now.select(group, F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).groupBy(group, "id").agg(F.count("*").alias("used"))
        used = cut(used.unionByName(more).groupBy(group, "id").agg(F.sum("used").alias("used")))
        full = used.filter(F.col("used") >= cap)
        left = left.join(now, keep, "left_anti")
        for end in ("a", "b"):
            left = left.join(full.select(group, F.col("id").alias(end)), [group, end], "left_anti")
        left = cut(left.select(*keep))


def top_k_either(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs among the k most similar of either end."""
    w = lambda c, o: Window.partitionBy(c).orderBy(F.desc("similarity"), o)
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    best = both.withColumn("r", F.row_number().over(w("a", "b"))).filter(F.col("r") <= k)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()


def hashed_bag(text: Column, size: int = 256) -> Column:
    """Counts of tokens by their hash, the same in every run."""
    cells = F.transform(T.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    count = lambda x: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.size(x) - F.size(F.array_remove(x, i))).cast("double"))
    return F.get(F.transform(F.array(cells), count), F.lit(0))  # bound to a variable, as the text would else be split for each cell


def anonymise(text: Column, names: Column) -> Column:
    """The names of a document (longest first) replaced by [NAME_n] in the order they are given."""
    numbered = F.transform(F.array_distinct(names), lambda x, i: F.struct(F.length(x).alias("n"), x.alias("name"), F.concat(F.lit("[NAME_"), (i + 1).cast("string"), F.lit("]")).alias("tag")))
    ordered = F.reverse(F.array_sort(F.filter(numbered, lambda x: x["n"] > 0)))
    return F.aggregate(ordered, text, lambda acc, x: F.replace(acc, x["name"], x["tag"]))


#: Events of a document that a task looks for partners of, and events that it compares them with at once.
CELL, COLUMNS = 2048, 4096
#: Rows of a product of matrices, and places (sets of sentences and chunks) among them.
ROWS, PLACES = 512, 16
#: Cells in which values of a field are told apart before pairs are looked at one by one.
HASHED = 16
#: Events of small documents that are compared at once, and pairs that are looked at one by one at once.
BATCH, AT_ONCE = 8192, 100_000
FIELDS = ("main_verb", "event_type", "trigger_text", "time_normalized")
SETS = ("participants", "sentences", "chunks")
#: What equal fields and a shared participant add to either priority at most.
MOST = ((0.10, 0.08, 0.09, 0.0, 0.06), (0.05, 0.0, 0.06, 0.18, 0.12))
_NEIGHBOURS = "doc_id string, event_id string, other string, bucket string, priority double, similarity double"


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes (2, 3): rows 0 0 1 1 1, and 0 1 0 1 2."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Sets:
    """A set of numbers for each row."""

    def __init__(self, column: pa.Array):
        at = column.offsets.to_numpy()
        self.values, self.at = column.values.to_numpy()[at[0] : at[-1]].astype(np.int64), at - at[0]

    def of(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of the sets of rows i, with the place in i."""
        row, k = _ranges(np.diff(self.at)[i])
        return row, self.values[self.at[i][row] + k]

    def keys(self, other: np.ndarray) -> np.ndarray:
        """Sorted (row, number of the member among other); members that are not among other are left out."""
        row, v = self.of(np.arange(len(self.at) - 1))
        n = np.searchsorted(other, v)
        known = np.nonzero(n < len(other))[0]
        known = known[other[n[known]] == v[known]]
        return np.sort(row[known] * len(other) + n[known])


def _shared(a: _Sets, i: np.ndarray, b: _Sets, j: np.ndarray, by: tuple[int, ...] = (0,)) -> np.ndarray:
    """How many members the sets of rows i and j share, if those of a may be off by one of by."""
    values = np.unique(b.values)
    keys, out = b.keys(values), np.zeros(len(i), np.int64)
    row, v = a.of(i)
    for d in by if len(keys) else ():
        n = np.minimum(np.searchsorted(values, v + d), len(values) - 1)
        key = j[row] * len(values) + n
        out += np.bincount(row, (values[n] == v + d) & (keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key), len(i)).astype(np.int64)
    return out


def _meet(a: _Sets, i: np.ndarray, b: _Sets, j: np.ndarray, by: tuple[int, ...] = (0,)) -> np.ndarray:
    """Of all rows i of a and j of b, whether they share a member."""
    out = np.zeros((len(i), len(j)), bool)
    (r, v), (c, w) = a.of(i), b.of(j)
    order = np.argsort(w, kind="stable")
    c, w = c[order], w[order]
    for d in by:
        lo, hi = np.searchsorted(w, v + d), np.searchsorted(w, v + d, "right")
        for part in np.array_split(np.arange(len(v)), (hi - lo).sum() // (10 * AT_ONCE) + 1):
            e, k = _ranges((hi - lo)[part])
            out[r[part][e], c[lo[part][e] + k]] = True
    return out


class _Events:
    """Columns of events as arrays; rank tells their ids' order."""

    def __init__(self, t: pa.Table, names: np.ndarray | None = None):
        t = t.combine_chunks()
        col = lambda c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
        self.n, ids = t.num_rows, col("event_id").to_numpy(zero_copy_only=False)
        self.names, self.rank = np.unique(ids, return_inverse=True) if names is None else (names, np.searchsorted(names, ids))
        vector = col("vector")
        sizes = np.diff(vector.offsets.to_numpy())
        self.vector = np.zeros((self.n, sizes.max(initial=0)))
        self.vector[_ranges(sizes)] = vector.flatten().to_numpy()
        self.size = np.linalg.norm(self.vector, axis=1)
        self.fields = [col(f).to_numpy() for f in FIELDS]
        self.sets = {s: _Sets(col(s)) for s in SETS}
        # A row of each distinct pair of sets of sentences and chunks, and which of them each row has.
        self.places, self.place = np.unique(col("place").to_numpy(), return_index=True, return_inverse=True)[1:]

    def told(self, width: int) -> np.ndarray:
        """Unit vector, and in hashed cells the fields and participants: products of these are no less than what they add to a priority."""
        out = np.zeros((self.n, width + (len(FIELDS) + 1) * HASHED), np.float32)
        d = self.vector.shape[1]
        out[:, :d] = self.vector / np.where(self.size > 0, self.size, 1)[:, None]
        for k, f in enumerate(self.fields):
            has = np.nonzero(f != 0)[0]
            out[has, width + k * HASHED + (f[has] >> 8) % HASHED] = 1
        row, v = self.sets["participants"].of(np.arange(self.n))
        np.add.at(out, (row, width + len(FIELDS) * HASHED + (v >> 8) % HASHED), 1)
        return out


class _Best:
    """Each row's best partners in either bucket so far."""

    def __init__(self, rows: int, quota: tuple[int, int]):
        self.quota = quota
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * 2
        self.least = [np.full(rows, -np.inf) for _ in quota]

    def add(self, bucket: int, row: np.ndarray, rank: np.ndarray, value: np.ndarray, sim: np.ndarray) -> None:
        row, rank, value, sim = (np.concatenate(x) for x in zip(self.kept[bucket], (row, rank, np.round(value, 6), sim)))
        order = np.lexsort((rank, -value, row))
        row, rank, value, sim = row[order], rank[order], value[order], sim[order]
        start = np.r_[True, row[1:] != row[:-1]][: len(row)]
        at = np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0))
        self.kept[bucket] = tuple(x[at < self.quota[bucket]] for x in (row, rank, value, sim))
        last = at == self.quota[bucket] - 1
        self.least[bucket][row[last]] = value[last]


class _Search:
    """Of each event the best k // 2 duplicates and the best other half of related events, by the priorities of the features that two share."""

    def __init__(self, k: int, least: float):
        self.known, self.rescue = least, max(0.42, least - 0.18)
        self.quota = (max(1, k // 2), max(1, k - max(1, k // 2)))
        # Pairs of either bucket have this priority at least, but for those of one sentence.
        self.floors = (min(least + 0.06, self.rescue + 0.15), min(self.rescue, max(0.30, self.rescue - 0.08) + 0.10))

    def judge(self, a: _Events, i: np.ndarray, b: _Events, j: np.ndarray, where: tuple | None = None, best: _Best | None = None) -> tuple:
        """(i, j, similarity, then of either bucket whether the pair is in it and its priority). where: sentence, near and chunk, if these are known;
        best: pairs that can't be among these are left out before participants are compared."""
        d = min(a.vector.shape[1], b.vector.shape[1])
        dot, size = np.einsum("ij,ij->i", a.vector[i, :d], b.vector[j, :d]), a.size[i] * b.size[j]
        sim = np.round(np.divide(dot, size, out=np.zeros(len(i)), where=size > 0), 9)
        verb, kind, trigger, time = ((x[i] == y[j]) & (x[i] != 0) for x, y in zip(a.fields, b.fields))
        share = lambda s, *by: _shared(a.sets[s], i, b.sets[s], j, *by) > 0
        sentence, near, chunk = where or (share("sentences"), share("sentences", (-2, -1, 0, 1, 2)), share("chunks"))
        may = ~chunk & (a.rank[i] != b.rank[j])
        if best is not None:
            may &= (sim + 0.40 * sentence + 0.10 * verb + 0.08 * kind + 0.09 * trigger + 0.06 >= best.least[0][i] - 1e-5) | (
                sim + 0.18 * time + 0.20 + 0.05 * verb + 0.06 * trigger + 0.10 * near >= best.least[1][i] - 1e-5
            )
        i, j, sim, verb, kind, trigger, time, sentence, near = (x[may] for x in (i, j, sim, verb, kind, trigger, time, sentence, near))
        people = _shared(a.sets["participants"], i, b.sets["participants"], j)
        least, rescue = self.known, self.rescue
        duplicate = sentence | ((sim >= least) & (verb | kind | trigger | (people > 0))) | ((sim >= rescue) & trigger & (people > 0))
        related = ~sentence & (((sim >= rescue) & ((people > 0) | time | verb | kind | trigger | near)) | ((sim >= max(0.30, rescue - 0.08)) & (time | (people >= 2) | near)))
        return i, j, sim, (
            (duplicate, sim + 0.40 * sentence + 0.10 * verb + 0.08 * kind + 0.09 * trigger + 0.06 * (people > 0)),
            (related, sim + 0.18 * time + 0.12 * (people > 0) + 0.08 * (people >= 2) + 0.05 * verb + 0.06 * trigger + 0.10 * near),
        )

    def whole(self, e: _Events, start: np.ndarray, m: np.ndarray) -> _Best:
        """All pairs of documents whose events lie at start."""
        best = _Best(e.n, self.quota)
        _, k = _ranges(m)
        left, at = np.repeat(m, m) - 1 - k, np.repeat(start, m) + k
        before, found = np.cumsum(left) - left, ([], [])
        for part in np.split(np.arange(len(at)), np.nonzero(np.diff(before // AT_ONCE))[0] + 1):
            r, k = _ranges(left[part])
            i, j, sim, buckets = self.judge(e, at[part][r], e, at[part][r] + 1 + k)
            for into, (ok, value) in zip(found, buckets):
                into += [(i[ok], e.rank[j[ok]], value[ok], sim[ok]), (j[ok], e.rank[i[ok]], value[ok], sim[ok])]
        for bucket, x in enumerate(found):
            if x:
                best.add(bucket, *(np.concatenate(c) for c in zip(*x)))
        return best

    def part(self, e: _Events, blocks: Iterator[_Events]) -> _Best:
        """Events of one document against all of it. Products of matrices bound the priorities; only pairs whose bound reaches what a row has already are looked at."""
        best = _Best(e.n, self.quota)
        of, place = e.places, e.place
        rows = np.argsort(place, kind="stable")
        nth = np.r_[0, np.cumsum(np.diff(place[rows]) != 0)] if e.n else rows
        tiles, lo = [], 0
        while lo < e.n:
            hi = min(lo + ROWS, int(np.searchsorted(nth, nth[lo] + PLACES)))
            tiles.append(rows[lo:hi])
            lo = hi
        for b in blocks:
            width = max(e.vector.shape[1], b.vector.shape[1])
            x, y = e.told(width), b.told(width)
            weighted = [x * np.r_[np.ones(width), np.repeat(w, HASHED)].astype(np.float32) for w in MOST]
            to, column = b.places, b.place
            lift = max(0.40, self.floors[0]) + (min(e.vector.min(initial=0), b.vector.min(initial=0)) < 0)  # no pair of one sentence is under the floor
            sentence, near, chunk = (_meet(e.sets[s], of, b.sets[s], to, by) for s, by in (("sentences", (0,)), ("sentences", (-2, -1, 0, 1, 2)), ("chunks", (0,))))
            bonus = [np.where(chunk, -9, np.where(sentence, s, n)).astype(np.float32) for s, n in ((lift, 0), (-9, np.where(near, 0.10, 0)))]
            found: tuple[list, list] = ([], [])

            def look(i: np.ndarray, j: np.ndarray) -> None:
                for s in range(0, len(i), AT_ONCE):
                    p, q = place[i[s : s + AT_ONCE]], column[j[s : s + AT_ONCE]]
                    i_, j_, sim, buckets = self.judge(e, i[s : s + AT_ONCE], b, j[s : s + AT_ONCE], (sentence[p, q], near[p, q], chunk[p, q]), best)
                    for into, (ok, value) in zip(found, buckets):
                        into.append((i_[ok], b.rank[j_[ok]], value[ok], sim[ok]))

            for r in tiles:
                mine, local = np.unique(place[r], return_inverse=True)
                one = np.eye(len(mine), dtype=np.float32)[local]
                bounds = [np.c_[w[r], one] @ np.c_[y, add[mine][:, column].T].T for w, add in zip(weighted, bonus)]
                reach = [bound >= (np.maximum(most[r], floor) - 1e-4).astype(np.float32)[:, None] for bound, most, floor in zip(bounds, best.least, self.floors)]
                i, j = np.divmod(np.flatnonzero(reach[0] | reach[1]), b.n)
                look(r[i], j)
            for bucket, z in enumerate(found):
                if z:
                    best.add(bucket, *(np.concatenate(c) for c in zip(*z)))
        return best


def _neighbours(k: int, least: float, folder: str) -> Callable:
    """Rows sorted by document and part; a document of one part is whole, the others' events are read from folder, where each has its own."""
    search = _Search(k, least)

    def told(t: pa.Table, names: np.ndarray, best: _Best) -> Iterator[pa.RecordBatch]:
        for bucket, (row, rank, value, sim) in zip(("duplicate", "relation"), best.kept):
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].take(pa.array(row)).combine_chunks().cast(pa.string()), t["event_id"].take(pa.array(row)).combine_chunks().cast(pa.string()), pa.array(names[rank], pa.string()), pa.array([bucket] * len(row), pa.string()), pa.array(value), pa.array(sim)],
                names=[c.split()[0] for c in _NEIGHBOURS.split(", ")],
            )

    def met(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        doc, part, parts = (t[c].to_numpy() for c in ("doc", "part", "parts"))
        start = np.nonzero(np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])[0]
        m = np.diff(np.r_[start, len(doc)])
        single = parts[start] == 1
        if single.any():
            e = _Events(t)
            yield from told(t, e.names, search.whole(e, start[single], m[single]))
        for s, n in zip(start[~single], m[~single]):
            mine = t.slice(s, n)
            d = dataset.dataset(f"{folder}/doc={doc[s]}", format="parquet")
            names = np.unique(d.to_table(columns=["event_id"])["event_id"].to_numpy())

            def blocks() -> Iterator[_Events]:
                held, size = None, COLUMNS // 16  # a few first, for bounds to start with
                for b in d.to_batches(columns=["event_id", "vector", *FIELDS, *SETS, "place"], batch_size=COLUMNS, batch_readahead=1, fragment_readahead=1):
                    b = pa.Table.from_batches([b])
                    held = pa.concat_tables([held, b]) if held else b
                    while held.num_rows >= size:
                        yield _Events(held.slice(0, size), names)
                        held, size = held.slice(size), min(2 * size, COLUMNS)
                if held:
                    yield _Events(held, names)

            yield from told(mine, names, search.part(_Events(mine, names), blocks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH:
                doc, part = batch["doc"].to_numpy(), batch["part"].to_numpy()
                last = np.nonzero((doc != doc[-1]) | (part != part[-1]))[0]
                if len(last):  # the last group may go on
                    held[-1] = batch.slice(0, last[-1] + 1)
                    yield from met(pa.Table.from_batches(held))
                    held = [batch.slice(last[-1] + 1)]
        if held:
            yield from met(pa.Table.from_batches(held))

    return run


def candidate_pairs(events: DataFrame, k: int = 8, least: float = 0.6, cell: int = CELL) -> DataFrame:
    """(doc_id, a, b, bucket, priority, similarity, rescue): pairs of events of a document that may be the same or related, each event's best k.

    events: (doc_id, event_id, vector, main_verb, event_type, trigger_text, time_normalized, participants, sentences, chunks), one row an event. A pair with a chunk in common is
    skipped. A pair in both buckets is related, with that priority. Each event is shuffled to one task, with cell others of its document; a document of more is also written to the
    shared folder, from where its tasks read it block by block. Names are compared by 64 bits of hash.
    """
    number = lambda c: F.when(F.col(c) != "", F.xxhash64(c)).otherwise(F.lit(0).cast("long")).alias(c)
    members = lambda c, f: F.coalesce(F.array_distinct(F.transform(F.array_compact(c), f)), F.array().cast("array<long>")).alias(c)
    e = events.filter("doc_id is not null and event_id is not null").select(
        F.xxhash64("doc_id").alias("doc"), "doc_id", "event_id", F.coalesce("vector", F.array().cast("array<double>")).alias("vector"), *[number(f) for f in FIELDS],
        members("participants", lambda x: F.xxhash64(x)), members("sentences", lambda x: x.cast("long")), members("chunks", lambda x: F.xxhash64(x)),
    )
    e = cut(e.withColumn("place", F.xxhash64(F.array_sort("sentences"), F.size("sentences"), F.array_sort("chunks"))))
    # One row for cell events at most.
    large = F.broadcast(cut(e.groupBy("doc").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts")).filter("parts > 1")))
    placed = e.join(large, "doc", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int"))
    folder = stored(e.join(large, "doc", "left_semi"), "doc")
    tasks = max(4 * e.sparkSession.sparkContext.defaultParallelism, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = placed.repartition(tasks, "doc", "part").sortWithinPartitions("doc", "part").mapInArrow(_neighbours(k, least, folder), _NEIGHBOURS)
    pairs = told.groupBy("doc_id", F.least("event_id", "other").alias("a"), F.greatest("event_id", "other").alias("b")).agg(F.max(F.struct("bucket", "priority", "similarity")).alias("p"))
    return pairs.select("doc_id", "a", "b", "p.bucket", "p.priority", "p.similarity", (F.col("p.similarity") < least).alias("rescue"))


def rescue_pairs(events: DataFrame, chosen: DataFrame, k: int = 8, least: float = 0.6, most: int = 200) -> DataFrame:
    """(doc_id, a, b, bucket, priority, similarity): of the related pairs by a lower floor that are not chosen yet and have an anchor, the first most of
    each document by priority, if the cosine of their vectors (of an embedding model) is at least max(0.56, least - 0.04)."""
    wide = candidate_pairs(events, k, least - 0.30 + 0.18).join(chosen.select("doc_id", "a", "b"), ["doc_id", "a", "b"], "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("priority"), "a", "b"))
    wide = wide.filter(F.col("similarity") >= max(0.24, least - 0.30)).withColumn("rank", first).filter(F.col("rank") <= most)
    return wide.filter(F.col("similarity") >= max(0.56, least - 0.04)).select("doc_id", "a", "b", F.concat("bucket", F.lit("_semantic_rescue")).alias("bucket"), "priority", "similarity")
