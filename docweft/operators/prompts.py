"""Prompts from retrieved events with their edges, entities and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T

#: How much of each part a prompt shows.
EDGES, ENTITIES, CHUNKS = 24, 20, 12


def _lines(rows: DataFrame, idx: str, order: Column, line: Column, most: int, name: str) -> DataFrame:
    """(idx, name): the first lines by order. min and max states of a bounded number of lines are kept, not whole groups."""
    from docweft.operators import ranking

    top = ranking.top_k(rows.select(idx, order.alias("__o"), line.alias("__line")).distinct(), [idx], most, F.col("__o"), F.col("__line"))
    return top.groupBy(idx).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "__line"))), lambda x: x["__line"]), "\n").alias(name))


def build(questions: DataFrame, hits: DataFrame, edges: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(idx, prompt) for questions (idx, question) with hits (idx, rank, doc_id, event_id, event_type, text), edges (idx, a, relation, b),
    entities (idx, entity_id, name) and chunks (idx, chunk_id, text); a part without lines says - none."""
    parts = {
        "Events": (hits, F.col("rank"), F.format_string("- [%s:%s] %s: %s", "doc_id", "event_id", F.coalesce("event_type", F.lit("")), T.clip(F.coalesce("text", F.lit("")), 400)), 1000),
        "Edges": (edges, F.struct("a", "b"), F.format_string("- %s %s %s", "a", F.coalesce("relation", F.lit("RELATED")), "b"), EDGES),
        "Entities": (entities, F.col("entity_id"), F.format_string("- %s: %s", "entity_id", F.coalesce("name", F.lit(""))), ENTITIES),
        "Passages": (chunks, F.col("chunk_id"), F.format_string("- [%s] %s", "chunk_id", T.clip(F.coalesce("text", F.lit("")), 800)), CHUNKS),
    }
    out = questions.select("idx", "question")
    for name, (rows, order, line, most) in parts.items():
        out = out.join(_lines(rows, "idx", order, line, most, name), "idx", "left")
    body = [F.concat(F.lit(f"{name}:\n"), F.coalesce(name, F.lit("- none"))) for name in parts]
    return out.select("idx", F.concat_ws("\n\n", F.concat(F.lit("Question: "), "question"), *body).alias("prompt"))
