"""Test items that leaked into training documents, by an FM-index over each shard of the corpus.

Words are folded (case, punctuation, line-break hyphens, the digits 0 and 1 that scanners put for o and l, bare
numbers dropped). Of a shard only stretches of at least SEED consecutive words of the items' vocabulary can match, so only
these enter its index: a suffix array, the Burrows-Wheeler transform as a wavelet tree, and sampled suffix positions. All
phrases are searched backwards at once, two rank queries a word; a phrase is the shortest one from a position of an
item that stands at no more than RARE places of the items. Occurrences are located by walking to a sampled position, merged on their
diagonals and extended over altered words. An exact check of the extended passage decides.

A passage counts with 12 equal running words, whatever they say. One with altered words counts with a score of 14, where equal words
count 1 and a replaced, missing or added word costs 2, or with 12 words of which at most one in FEW is altered. It must also
say more than chance would: the items' own wording, as a chain of word pairs, gives each equal word
its surprise in bits, and the sum less what altered words cost must exceed the bits that tell all item positions apart by MARGIN. (It sorts
out sentences of one pattern with other nouns.) Words inside a run of 12
that at least STOCK items share are stock wording and match nothing.

Defined results: null or empty texts and passages hold nothing; repeated items are each reported; an empty
corpus or item table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 12
SCORE = 14
PENALTY = 2
#: An altered word in so many of a passage's words.
FEW = 6
SEED = 5
RARE = 3
STOCK = 3
MARGIN = 25.0
#: Words of all items; the item set is given and small, this is its checked bound.
MAX_ITEM_WORDS = 1_000_000
#: Symbols of one index; a shard beyond that gets several.
SHARD_SYMBOLS = 2_000_000
#: Words of the documents that an index has stretches of, held to extend and check what it finds; with more the index is searched at once.
HELD_WORDS = 4_000_000
SAMPLE = 8

WORD = re.compile(r"[^\W_]+(?:-\s*[^\W_]+)*")
_SCAN = str.maketrans("01", "ol")
_JOIN = re.compile(r"[-\s]+")


def fold(word: str) -> str:
    """A word in lower case as it is compared; empty if it is a bare number or a mark of a list."""
    w = _JOIN.sub("", word)
    if w.isdigit() or w in ("b", "c", "d", "e", "s"):
        return ""
    return w.translate(_SCAN) if not w.isalpha() else w


class Vocabulary(dict):
    """Word to number: -1 for what is skipped, 0 for words of no item. It remembers words as they come in, up to a bound."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> int:
        f = fold(word)
        n = self.words.get(f, 0) if f else -1
        if len(self) > 300_000:
            self.clear()
        self[word] = n
        return n


class Items:
    """The items' passages as numbers, stock wording blanked, and the phrases to search."""

    def __init__(self, rows: list[tuple[int, list[str | None]]]):
        texts = [(idx, [f for w in WORD.findall(p.lower()) if (f := fold(w))]) for idx, parts in rows for p in parts if p]
        self.words = {w: k + 1 for k, w in enumerate(sorted({w for _, t in texts for w in t}))}
        having: dict[tuple, set[int]] = defaultdict(set)
        for idx, t in texts:
            for j in range(len(t) - RUN + 1):
                having[tuple(t[j : j + RUN])].add(idx)
        stock = {g for g, ids in having.items() if len(ids) >= STOCK}
        self.item, self.passages = [], []
        for idx, t in texts:
            ids = np.array([self.words[w] for w in t], np.int32)
            for j in range(len(t) - RUN + 1):
                if tuple(t[j : j + RUN]) in stock:
                    ids[j : j + RUN] = -9
            self.item.append(idx)
            self.passages.append(ids.tolist())
        self._phrases()
        self._surprise()

    def _surprise(self) -> None:
        """Of each passage the running sum of bits of its words after the words before them; what is needed in all."""
        pairs, firsts = Counter(), Counter()
        for t in self.passages:
            pairs.update(zip(t, t[1:]))
            firsts.update(t[:-1])
        v = len(self.words) + 1
        bits = lambda a, b: -np.log2((pairs[a, b] + 0.1) / (firsts[a] + 0.1 * v))
        self.bits = [np.concatenate(([0.0, np.log2(v)], np.cumsum([bits(a, b) for a, b in zip(t, t[1:])]) + np.log2(v))) for t in self.passages]
        self.needed = np.log2(max(2, sum(map(len, self.passages)))) + MARGIN
        self.altered = float(np.mean([b[-1] / max(1, len(b) - 1) for b in self.bits])) if self.bits else 0.0

    def _phrases(self) -> None:
        """From each position the shortest phrase of SEED to RUN words that stands at most at RARE places.

        A phrase of RUN words that stands at more is searched from its first place in each passage: such a run decides by itself.
        """
        owners: dict[tuple, int] = defaultdict(int)
        for p, t in enumerate(self.passages):
            for n in range(SEED, RUN + 1):
                for j in range(len(t) - n + 1):
                    owners[tuple(t[j : j + n])] += 1
        found: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for p, t in enumerate(self.passages):
            for j in range(len(t) - SEED + 1):
                for n in range(SEED, min(RUN, len(t) - j) + 1):
                    g = tuple(t[j : j + n])
                    if g[-1] < 0 or -9 in g:
                        break
                    if owners[g] <= RARE or (n == RUN and (not found[g] or found[g][-1][0] != p)):
                        found[g].append((p, j))
                    if owners[g] <= RARE:
                        break
        self.phrases = [g for g, places in found.items() if places]
        self.places = [found[g] for g in self.phrases]
        self.length = np.array([len(g) for g in self.phrases], np.int64)
        self.matrix = np.zeros((len(self.phrases), RUN), np.int32)
        for k, g in enumerate(self.phrases):
            self.matrix[k, : len(g)] = g


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By doubling: ranks of prefixes of 1, 2, 4, .. symbols, until all differ."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, k = len(s), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-k or n] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + second
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[sa[-1]] == n - 1 or k >= n:
            return sa
        k *= 2


class WaveletTree:
    """Symbols by their bits, highest first, stably parted at each level; rank by one lookup a level."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in reversed(range(bits)):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often c[i] stands before at[i]."""
        lo = np.zeros_like(at)
        for level, b in enumerate(reversed(range(self.bits))):
            ones, bit = self.ones[level], ((c >> b) & 1).astype(bool)
            o_lo, o_at = ones[lo], ones[at]
            lo, at = np.where(bit, self.zeros[level] + o_lo, lo - o_lo), np.where(bit, self.zeros[level] + o_at, at - o_at)
        return at - lo


class FMIndex:
    def __init__(self, s: np.ndarray):
        """s: symbols from 1; 0 parts stretches. Inside, all are one higher and a single 0 ends the text."""
        s = np.concatenate((s + 1, [0]))
        self.n = len(s)
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.tree = WaveletTree(self.bwt, max(1, int(s.max()).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s)))).astype(np.int64)
        sampled = sa % SAMPLE == 0
        self.known = np.concatenate(([0], np.cumsum(sampled)))
        self.samples, self.sampled = sa[sampled], sampled

    def search(self, matrix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes of each phrase, all phrases at once, the last word first."""
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        top = len(self.first) - 2
        for step in range(matrix.shape[1]):
            at = np.nonzero((length > step) & (lo < hi))[0]
            if not len(at):
                break
            c = matrix[at, length[at] - 1 - step].astype(np.int64) + 1
            seen = c <= top
            lo[at[~seen]] = hi[at[~seen]] = 0
            at, c = at[seen], c[seen]
            lo[at] = self.first[c] + self.tree.rank(c, lo[at])
            hi[at] = self.first[c] + self.tree.rank(c, hi[at])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a sampled one."""
        out, steps, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows.copy()
        while len(todo):
            hit = self.sampled[at[todo]]
            done = todo[hit]
            out[done] = (self.samples[self.known[at[done]]] + steps[done]) % self.n
            todo = todo[~hit]
            c = self.bwt[at[todo]].astype(np.int64)
            at[todo] = self.first[c] + self.tree.rank(c, at[todo])
            steps[todo] += 1
        return out


def _extend(a: list[int], b: list[int], i: int, j: int, step: int) -> tuple[int, int, int, int]:
    """From equal words on in one direction: (score gained, words of a, words of b, equal words right at the start)."""
    score = best = n = m = run = 0
    at_best, altered = (0, 0), False
    while 0 <= i < len(a) and 0 <= j < len(b):
        if a[i] == b[j]:
            score, n, m, i, j = score + 1, n + 1, m + 1, i + step, j + step
            run += not altered
            if score > best:
                best, at_best = score, (n, m)
            continue
        altered = True
        # What explains the difference best: the way with most equal words among the next four.
        ways = []
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2)):
            k = 0
            while k < 4 and 0 <= i + step * (di + k) < len(a) and 0 <= j + step * (dj + k) < len(b) and a[i + step * (di + k)] == b[j + step * (dj + k)]:
                k += 1
            ways.append((k - PENALTY * (max(di, dj) - 1), -di - dj, di, dj))
        _, _, di, dj = max(ways)
        score -= PENALTY * max(di, dj)
        if score < best - 3 * PENALTY:
            break
        n, m, i, j = n + di, m + dj, i + step * di, j + step * dj
    return best, *at_best, run


def _blocks(index: FMIndex, items: Items) -> np.ndarray:
    """(passage, position in the shard, position in the passage, words): maximal equal stretches from the phrases found."""
    lo, hi = index.search(items.matrix, items.length)
    count = hi - lo
    hit = np.nonzero(count)[0]
    if not len(hit):
        return np.zeros((0, 4), np.int64)
    phrase = np.repeat(hit, count[hit])
    rows = np.repeat(lo[hit], count[hit]) + np.arange(len(phrase)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
    at = index.locate(rows)
    out = [(p, x, j, items.length[k]) for k, x in zip(phrase.tolist(), at.tolist()) for p, j in items.places[k]]
    h = np.array(out, np.int64)
    h = h[np.lexsort((h[:, 1], h[:, 1] - h[:, 2], h[:, 0]))]
    same = (h[1:, 0] == h[:-1, 0]) & (h[1:, 1] - h[1:, 2] == h[:-1, 1] - h[:-1, 2]) & (h[1:, 1] <= h[:-1, 1] + h[:-1, 3])
    start = np.nonzero(np.concatenate(([True], ~same)))[0]
    end = np.maximum.reduceat(h[:, 1] + h[:, 3], start)
    first = h[start]
    return np.column_stack((first[:, 0], first[:, 1], first[:, 2], end - first[:, 1]))


def _counts(items: Items, p: int, lo: int, hi: int, words: int, score: int, run: int) -> bool:
    """Do the words lo to hi of passage p count, equal to so many words of a document but for altered ones?"""
    if run >= RUN:
        return True
    altered = (hi - lo - score) / (1 + PENALTY)
    long = score >= SCORE or (min(hi - lo, words) >= RUN and altered * FEW <= hi - lo)
    return long and items.bits[p][hi] - items.bits[p][lo] - 2 * altered * items.altered >= items.needed


def _search(stream: np.ndarray, back: np.ndarray, docs: list, ids: list[list[int]], items: Items) -> list[tuple]:
    """(doc, idx, first word, end word, score): passages of one shard, those of an item in a document that overlap as one.

    stream: the stretches, parted by 0; back: for each symbol (document, place in its list of folded words); ids: these lists.
    """
    found: dict[tuple, list[tuple]] = defaultdict(list)
    last: dict[tuple, tuple] = {}
    for p, x, j, n in _blocks(FMIndex(stream), items).tolist():
        d, i = back[x].tolist()
        # Blocks of a passage come by diagonal, so the next ones mostly lie inside the passage just found.
        if (s := last.get((d, p))) and s[0] <= i and i + n <= s[1] and s[2] <= j and j + n <= s[3]:
            continue
        t, passage = ids[d], items.passages[p]
        right, r_doc, r_item, r_run = _extend(t, passage, i + n, j + n, 1)
        left, l_doc, l_item, l_run = _extend(t, passage, i - 1, j - 1, -1)
        score = n + left + right
        start, end, lo, hi = i - l_doc, i + n + r_doc, j - l_item, j + n + r_item
        if _counts(items, p, lo, hi, end - start, score, n + l_run + r_run):
            last[d, p] = start, end, lo, hi
            found[d, items.item[p]].append((start, end, score))
    out = []
    for (d, idx), spans in found.items():
        first, end, score = None, -1, 0
        for a, b, s in sorted(spans):
            if a < end:
                end, score = max(end, b), max(score, s)
                continue
            if first is not None:
                out.append((docs[d], idx, first, end, score))
            first, end, score = a, b, s
        out.append((docs[d], idx, first, end, score))
    return out


def _shards(items: Items):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, get = Vocabulary(items.words), None
        get = vocabulary.__getitem__
        streams, backs, docs, ids, size, words = [], [], [], [], 0, 0

        def flush() -> pd.DataFrame:
            rows = _search(np.concatenate(streams).astype(np.int64), np.concatenate(backs).astype(np.int64), docs, ids, items) if streams else []
            return pd.DataFrame(rows, columns=["doc", "idx", "first_word", "end_word", "score"])

        for pdf in batches:
            keys, lists, lengths = [], [], []
            for doc, text in zip(pdf["doc"], pdf["text"]):
                t = [n for n in map(get, WORD.findall(text.lower())) if n >= 0]
                keys.append(doc)
                lists.append(t)
                lengths.append(len(t))
            if not (total := sum(lengths)):
                continue
            # All documents of the batch in one array, a 0 after each.
            flat = np.zeros(total + len(lists), np.int32)
            ends = np.cumsum(np.array(lengths) + 1)
            for t, end in zip(lists, ends.tolist()):
                flat[end - 1 - len(t) : end - 1] = t
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (flat > 0).view(np.int8), [0]))))
            starts, stops = edge[::2], edge[1::2]
            long = stops - starts >= SEED
            starts, stops = starts[long], stops[long]
            if not len(starts):
                continue
            # Each stretch with the 0 that follows it.
            n = stops - starts + 1
            place = np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            owner = np.searchsorted(ends, place, side="right")
            keep = np.unique(owner)
            base = ends - np.array(lengths) - 1
            new = np.full(len(lists), -1)
            new[keep] = np.arange(len(docs), len(docs) + len(keep))
            streams.append(np.where(place == np.repeat(stops, n), 0, flat[np.minimum(place, len(flat) - 1)]))
            backs.append(np.column_stack((new[owner], place - base[owner])))
            for k in keep.tolist():
                docs.append(keys[k])
                ids.append(array("i", lists[k]))
                words += len(lists[k])
            size += len(place)
            if size > SHARD_SYMBOLS or words > HELD_WORDS:
                yield flush()
                streams, backs, docs, ids, size, words = [], [], [], [], 0, 0
        yield flush()

    return run


def leaks(documents: DataFrame, items: DataFrame, key: str, text: str, item: str, passages: list[Column]) -> DataFrame:
    """(key, item, first_word, end_word, score): each passage of each item in each document; those of an item don't overlap.

    Word numbers are of the folded words of the document, from 0, the end exclusive. The score is the best of what the span was joined from.
    """
    rows = items.select(F.col(item).cast("long"), *[c.alias(f"__p{k}") for k, c in enumerate(passages)])
    rows = rows.filter(F.col(rows.columns[0]).isNotNull())
    # One row more than may come, so that none is left out unseen.
    rows = rows.filter(F.length(F.concat_ws("", *[F.col(c) for c in rows.columns[1:]])) > 0).limit(MAX_ITEM_WORDS + 1).collect()
    held = Items([(r[0], list(r[1:])) for r in rows])
    if len(rows) > MAX_ITEM_WORDS or sum(map(len, held.passages)) > MAX_ITEM_WORDS:
        raise ValueError(f"the items have over {MAX_ITEM_WORDS} words; search them in several runs")
    if not held.phrases:
        return documents.sparkSession.createDataFrame([], f"{key} long, {item} long, first_word int, end_word int, score int")
    texts = documents.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    found = texts.mapInPandas(_shards(held), "doc long, idx long, first_word int, end_word int, score int")
    return found.select(F.col("doc").alias(key), F.col("idx").alias(item), "first_word", "end_word", "score")


def qa_passages() -> list[Column]:
    """The prompt, the question with its choices, and the gold passage."""
    return [F.col("prompt"), F.concat_ws(" ", "question", "choice_a", "choice_b", "choice_c", "choice_d"), F.col("gold_passage")]


def removal_spans(found: DataFrame, key: str, item: str) -> DataFrame:
    """(key, first_word, end_word, items): spans of all leaked items of a document, merged where they meet."""
    so_far = Window.partitionBy(key).orderBy("first_word", "end_word", item)
    before = F.max("end_word").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.withColumn("__new", F.when(before >= F.col("first_word"), 0).otherwise(1)).withColumn("__span", F.sum("__new").over(so_far))
    merged = spans.groupBy(key, "__span").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.sort_array(F.collect_set(item)).alias("items"))
    return merged.drop("__span")
