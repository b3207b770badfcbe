"""Inverted index, BM25 and the transparent scores of the graph retrieval.

A query term is a prefix: its counts are those of all words that begin with it. Prefixes are matched by
equality (words cut to the lengths that occur among the terms), so no step compares all words with all terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import rules as R
from docweft.functions import text as T
from docweft.session import cut

K1, B = 1.2, 0.75
#: Weights of the parts of the retrieval score.
WEIGHTS = {"lexical": 0.35, "graph": 0.25, "entity": 0.15, "temporal": 0.10, "evidence": 0.10, "structure": 0.12, "intent": 0.18, "supporting": 0.03}


def bm25(docs: DataFrame, key: str, text: str, questions: DataFrame, question_key: str, question: str, terms_of: Callable[[Column], Column] = T.content_tokens) -> DataFrame:
    """(question_key, key, score) of documents that hold a term of the question, larger is better. Null and empty texts hold none.

    Words are counted once to see which begin with a term; then only the hits of these words leave their documents.
    """
    words = docs.select(key, T.tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("length"), F.explode("t").alias("word"))
    terms = cut(questions.select(question_key, F.explode(terms_of(F.col(question))).alias("term")).distinct())
    lengths = terms.select(F.length("term").alias("n")).distinct()
    vocabulary = cut(words.groupBy("word").agg(F.count("*").alias("n_word")))
    prefixes = vocabulary.crossJoin(F.broadcast(lengths)).filter(F.length("word") >= F.col("n")).select("word", F.left("word", F.col("n")).alias("term"))  # lengths are a handful
    of_term = cut(prefixes.join(terms.select("term").distinct(), "term", "left_semi"))
    hits = cut(words.join(of_term, "word").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length")))
    stats = vocabulary.agg(F.sum("n_word").alias("words")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("docs")))).withColumn("mean", F.col("words") / F.col("docs"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.greatest(idf, F.lit(1e-6)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.join(df, "term").crossJoin(F.broadcast(stats)).select(key, "term", part.alias("part"))
    return terms.join(scored, "term").groupBy(question_key, key).agg(F.sum("part").alias("score"))


def rank_norm(rank: Column) -> Column:
    """1 for the first, 1/2 for the second and so on."""
    return 1.0 / rank


def temporal_match(question: Column, *times: Column) -> Column:
    """For a question about time 1 if the event has any, else 0.15; 0 for other questions."""
    time = F.concat_ws(" ", *times)
    asks = F.lower(question).rlike("when|before|after|timeline|date|time")
    return F.when(asks & T.missing(time).isNotNull(), 1.0).when(asks, 0.15).otherwise(0.0)


def evidence_richness(evidence: Column, confidence: Column) -> Column:
    return 0.5 * F.least(F.length(F.coalesce(evidence, F.lit(""))) / 240, F.lit(1.0)) + 0.5 * F.coalesce(confidence, F.lit(0.0))


def structure_score(participants: Column, neighbours: Column, supporting: Column) -> Column:
    base = 0.55 * F.least(participants / 3, F.lit(1.0)) + 0.45 * F.least(neighbours / 4, F.lit(1.0))
    return F.greatest(F.lit(0.0), base - F.when(supporting & (participants == 0) & (neighbours == 0), 0.2).otherwise(0.0))


def combined(**parts: Column) -> Column:
    """The weighted sum of the parts that are given."""
    total = F.lit(0.0)
    for name, c in parts.items():
        total = total + WEIGHTS[name] * F.coalesce(c, F.lit(0.0))
    return total


def best(scored: DataFrame, group: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(F.round("score", 6)), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the words of two texts; 0 if one is null or has none."""
    return F.coalesce(T.jaccard(T.token_set(a), T.token_set(b)), F.lit(0.0))


#: How many events, chunks and entities of a question are seeds, how many events a seed chunk may add, and how much of the chunk asks for them.
SEEDS, SEED_CHUNKS, SEED_ENTITIES, RESCUED, CHUNK_HEAD = 12, 6, 6, 6, 200


def graph_retrieval(
    questions: DataFrame, events: DataFrame, chunks: DataFrame, entities: DataFrame, participants: DataFrame, edges: DataFrame, hops: int = 2, top: int = 8
) -> DataFrame:
    """(idx, rank, doc_id, event_id, score and its eight parts): the best events for each question by text, graph and intent.

    questions (idx, question); events (doc_id, event_id, event_type, lexical_text, evidence_text, time_raw, time_normalized, confidence, is_supporting_fact), one row
    an event; chunks (doc_id, chunk_id, text); entities (doc_id, entity_id, name); participants (doc_id, event_id, mention_text); edges (doc_id, a, b), either way.

    The best events by BM25 are seeds. The best chunks ask with their first words for events of their own document, which come in with seven tenths of the chunk's overlap.
    Events within some hops of these follow; all of them count as one hop away, whichever hop found them, and have no entity and structure part. All
    questions go through each step together; every join is on document and event.
    """
    events = events.select("doc_id", "event_id", "event_type", "lexical_text", "evidence_text", "time_raw", "time_normalized", "confidence", "is_supporting_fact")
    key = F.concat_ws("\u0001", "doc_id", "event_id")
    indexed = events.select(key.alias("key"), "lexical_text")
    seeds = best(bm25(indexed, "key", "lexical_text", questions, "idx", "question", T.fts_terms), "idx", "key", SEEDS).select("idx", "key", "rank")
    found = best(bm25(chunks.select(F.concat_ws("\u0001", "doc_id", "chunk_id").alias("chunk"), "text"), "chunk", "text", questions, "idx", "question", T.fts_terms), "idx", "chunk", SEED_CHUNKS)
    named = best(bm25(entities.select(F.concat_ws("\u0001", "doc_id", "entity_id").alias("entity"), "name"), "entity", "name", questions, "idx", "question", T.fts_terms), "idx", "entity", SEED_ENTITIES)
    texts = chunks.select(F.concat_ws("\u0001", "doc_id", "chunk_id").alias("chunk"), "doc_id", "text")
    found = cut(found.join(texts, "chunk").join(questions, "idx").select("idx", "chunk", "doc_id", "text", token_overlap(F.col("question"), F.col("text")).alias("overlap")).filter("overlap > 0"))
    asked = found.select("chunk", F.left("text", F.lit(CHUNK_HEAD)).alias("head")).distinct()
    told = best(bm25(indexed, "key", "lexical_text", asked, "chunk", "head", T.fts_terms), "chunk", "key", RESCUED).select("chunk", "key")
    rescued = found.join(told, "chunk").filter(F.startswith(F.col("key"), F.concat("doc_id", F.lit("\u0001")))).groupBy("idx", "key").agg(F.max("overlap").alias("overlap"))
    first = cut(seeds.join(rescued, ["idx", "key"], "full"))

    by_key = events.withColumn("key", key)
    links = edges.select(*[F.concat_ws("\u0001", "doc_id", c).alias(n) for c, n in (("a", "src"), ("b", "dst"))]).filter("src <> dst")
    links = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().join(by_key.select(F.col("key").alias("dst")), "dst", "left_semi"))
    seen = first.select("idx", "key")
    front, after = seen, None
    for _ in range(hops):
        front = cut(front.join(links, F.col("key") == F.col("src")).select("idx", F.col("dst").alias("key")).distinct().join(seen, ["idx", "key"], "left_anti"))
        seen = seen.unionByName(front)
        after = front if after is None else after.unionByName(front)
    all_ = first.withColumn("first", F.lit(True))
    if after is not None:
        all_ = all_.unionByName(after.withColumn("first", F.lit(False)), allowMissingColumns=True)
    rows = all_.join(by_key, "key").join(questions, "idx")
    # Who takes part, and who of the document the question names: their words.
    own = participants.select(key.alias("key"), "mention_text").join(first.select("key"), "key", "left_semi")
    own = own.groupBy("key").agg(F.count("*").alias("n_participants"), F.array_distinct(F.flatten(F.collect_list(T.token_set(F.coalesce("mention_text", F.lit("")))))).alias("own_words"))
    names = entities.select(F.concat_ws("\u0001", "doc_id", "entity_id").alias("entity"), "doc_id", "name").distinct()
    names = named.join(names, "entity").groupBy("idx", "doc_id").agg(F.array_distinct(F.flatten(F.collect_list(T.token_set(F.coalesce("name", F.lit("")))))).alias("named_words"))
    near = links.join(first.select(F.col("key").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("key")).agg(F.count("*").alias("n_neighbours"))
    rows = rows.join(own, "key", "left").join(names, ["idx", "doc_id"], "left").join(near, "key", "left")
    none, q = F.array().cast("array<string>"), T.token_set(F.col("question"))
    hit = F.array_intersect(F.array_union(F.coalesce("own_words", none), F.coalesce("named_words", none)), q)
    overlap = token_overlap(F.col("question"), F.col("lexical_text"))
    supporting = F.coalesce("is_supporting_fact", F.lit(False))
    lexical = F.when(F.col("rank").isNotNull(), F.greatest(1.0 / F.col("rank"), overlap, F.coalesce("overlap", F.lit(0.0)) * 0.7)).when(F.col("first"), F.col("overlap") * 0.7).otherwise(overlap)
    structure = structure_score(F.coalesce("n_participants", F.lit(0)), F.coalesce("n_neighbours", F.lit(0)), supporting)
    parts = {
        "lexical": lexical,
        "graph": F.when(F.col("rank").isNotNull(), 1.0).when(F.col("first"), 0.3).otherwise(0.5),
        "entity": F.when(F.col("first") & (F.size(q) > 0), F.size(hit) / F.size(q)).otherwise(0.0),
        "temporal": temporal_match(F.col("question"), F.col("time_raw"), F.col("time_normalized")),
        "evidence": evidence_richness(F.col("evidence_text"), F.col("confidence")),
        "structure": F.when(F.col("first"), structure).otherwise(0.0),
        "intent": R.intent_score(F.col("question"), F.col("event_type")),
        "supporting": supporting.cast("double"),
    }
    rows = rows.select("idx", "key", "doc_id", "event_id", *[F.round(c, 6).alias(k) for k, c in parts.items()], combined(**parts).alias("score"))
    return best(rows, "idx", "key", top).select("idx", "rank", "doc_id", "event_id", F.round("score", 6).alias("score"), *parts)
