"""Splitting oversized items at natural boundaries, by lexical cohesion.

The boundaries of sentences come from SQL. Each gap between sentences gets the similarity of the blocks of words
on its two sides; a valley's depth is how far the similarity rises from it to the peaks left and right. Within the
window that a piece may end in, the deepest valley is cut (ties: the later one). A sentence longer than
the limit is cut at white space, and a run without any at the limit. Each further piece begins with the last whole sentences
of the piece before, as many as fit in the overlap, or else with its last whole words.

Defined results: null, empty and small texts give no pieces; repeated rows give one item; pieces cover the whole
text but white space between pieces; a piece with its overlap never exceeds the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.sentences import sentence_units
from docweft.session import spread

#: Sentences in a block, and the share of the limit from which a piece may end.
BLOCK, EARLIEST = 3, 0.5
_WORD = re.compile(r"[^\W\d_]{3,}")
OUT = "piece int, start_char int, end_char int, overlap int, first_line int, last_line int, text string"


def similarities(sentences: list[str], block: int = BLOCK, part: int = 256) -> np.ndarray:
    """Cosine of the words of the blocks before and after each gap; in parts, so that long texts stay small."""
    words = [_WORD.findall(s.lower()) for s in sentences]
    n = len(words) - 1
    sims = np.zeros(max(n, 0))
    for lo in range(0, n, part):
        hi = min(lo + part, n)
        a, b = max(0, lo + 1 - block), min(len(words), hi + block)
        ids: dict[str, int] = {}
        at = [(k + 1 - a, ids.setdefault(w, len(ids))) for k in range(a, b) for w in words[k]]
        if not at:
            continue
        m = np.zeros((b - a + 1, len(ids)), np.float32)
        np.add.at(m, tuple(np.array(at).T), 1)
        m = m.cumsum(0)  # row k: counts of the sentences a .. a + k - 1
        gap = np.arange(lo, hi) + 1 - a
        left, right = m[gap] - m[np.maximum(gap - block, 0)], m[np.minimum(gap + block, b - a)] - m[gap]
        norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
        sims[lo:hi] = np.divide((left * right).sum(1), norm, out=np.zeros(hi - lo), where=norm > 0)
    return sims


def valley_depths(sentences: list[str], block: int = BLOCK) -> np.ndarray:
    """Depth of the similarity valley at each gap: the climbs to the nearest peaks on both sides."""
    sims = similarities(sentences, block).tolist()
    n = len(sims)
    left, right = sims[:], sims[:]
    for k in range(1, n):
        if sims[k - 1] >= sims[k]:
            left[k] = left[k - 1]
        if sims[n - k] >= sims[n - 1 - k]:
            right[n - 1 - k] = right[n - k]
    return np.array(left) + np.array(right) - 2 * np.array(sims)


def cut_points(text: str, units: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of the pieces of a text with these sentence spans."""
    if not units:
        return []
    depth = valley_depths([text[a:b] for a, b in units])
    starts, ends = np.array([a for a, _ in units]), np.array([b for _, b in units])
    out, start, fresh, last = [], int(starts[0]), int(starts[0]), int(ends[-1])
    while True:
        if last - start <= limit:
            out.append((start, last, fresh - start))
            return out
        lo, hi = np.searchsorted(ends, max(start + limit * EARLIEST, fresh), side="right"), np.searchsorted(ends, start + limit, side="right")
        if lo >= hi:  # any sentence end that makes progress
            lo = np.searchsorted(ends, fresh, side="right")
        if lo < hi:
            best = max(range(int(lo), int(hi)), key=lambda k: (depth[k] if k < len(depth) else 0.0, k))
            end = int(ends[best])
        else:  # within one sentence: at white space, else hard
            end = start + limit
            gap = max(text.rfind(c, fresh + 1, end + 1) for c in " \n\t　")
            if gap > fresh:
                end = gap
        out.append((start, end, fresh - start))
        fresh = end
        while fresh < last and text[fresh].isspace():
            fresh += 1
        k = int(np.searchsorted(starts, fresh - overlap))
        if k < len(starts) and starts[k] < end:
            start = int(starts[k])
        else:
            gap = text.find(" ", max(fresh - overlap, 0), end) + 1
            start = gap if gap else fresh
        # The overlap may not eat up the room that the next piece needs to get ahead.
        if fresh - start >= limit // 2:
            start = fresh


def _splitter(limit: int, overlap: int, others: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                text, spans = row.text, list(zip(row.starts.tolist(), row.ends.tolist()))
                lines = np.cumsum([0] + [len(x) + 1 for x in text.split("\n")][:-1])
                filled = np.cumsum([bool(x.strip()) for x in text.split("\n")])
                line = lambda at: int(filled[np.searchsorted(lines, at, side="right") - 1])  # noqa: E731, B023
                for k, (a, b, o) in enumerate(cut_points(text, spans, limit, overlap)):
                    out.append((*(getattr(row, c) for c in others), k, a, b, o, line(a), line(b - 1), text[a:b]))
            yield pd.DataFrame(out, columns=[*others, "piece", "start_char", "end_char", "overlap", "first_line", "last_line", "text"])

    return run


def split_oversized(items: DataFrame, key: str, text: str, limit: int, overlap: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, piece, start_char, end_char, overlap, first_line, last_line, text): pieces of items over the limit.

    The overlap is that with the piece before; first_line and last_line count the filled lines from 1.
    """
    units = sentence_units(F.col("text"))
    big = spread(items.filter(F.length(text) > limit).select(key, *keep, F.col(text).alias("text"))).select(key, *keep, "text", units.alias("u"))
    big = big.select(key, *keep, "text", F.col("u.start_char").alias("starts"), F.col("u.end_char").alias("ends"))
    kinds = dict(items.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in (key, *keep)] + [OUT])
    return big.mapInPandas(_splitter(limit, overlap, [key, *keep]), schema)


def split_chunks(chunks: DataFrame, limit: int = 1200, overlap: int = 200) -> DataFrame:
    """Pieces of chunks with the ids of their sentences; a chunk has one sentence a line, the first is start_sentence_id."""
    p = split_oversized(chunks, "chunk_id", "text", limit, overlap, ("doc_id", "start_sentence_id", "end_sentence_id"))
    number = lambda c: F.least(F.col("start_sentence_id") + F.greatest(F.col(c), F.lit(1)) - 1, F.coalesce("end_sentence_id", F.lit(2**31 - 1)))
    # least() skips nulls, so an unknown start stays unknown only by saying so.
    known = F.col("start_sentence_id").isNotNull()
    return p.withColumns({"start_id": F.when(known, number("first_line")), "end_id": F.when(known, number("last_line"))}).select(
        "chunk_id", "doc_id", F.col("start_id").alias("start_sentence_id"), F.col("end_id").alias("end_sentence_id"), "piece", "start_char", "end_char", "overlap", "text"
    )
