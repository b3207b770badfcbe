"""Consensus of annotators who disagree, by the method of triplet moments.

Votes are +1 (fact) and -1 (non-fact). For annotators i and j who err independently, the agreement
rate corrected for chance, c_ij = 2 P(agree) - 1, is a_i a_j with a = 2 accuracy - 1. So each triplet gives
a_i^2 = c_ij c_ik / c_jk. Triplets are pooled by least squares, each weighted by the votes behind it, the sign
is that of the agreement with all others, and few votes are shrunk towards the mean of all annotators.
The label is the sign of the sum of votes weighted by log-odds of accuracy and of the prior of facts.

Votes per item are turned into pair counts inside a task, summed there before the shuffle: no pair of votes is ever a row, and an item
with very many votes is counted in cells of a bounded size. The pair table has a row for two people who
met, so it grows with the people, not with the items. Triplets are found from the one of the three who met the fewest, so
that a person who met everybody is no burden: nobody has more than the root of twice the pairs to look through.

Defined results: of one person's labels for an item the latest by updated_at counts (ties: created_at, id); a null
user_id is a person of its own for each row, with the mean reliability; a latest label that means neither fact nor non-fact
withdraws the person's vote; items without votes get no row; a sum of exactly 0 gives the label more
common in all votes, fact if these tie too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import cut

# Spellings, after lower case and with everything but letters dropped.
FACT = ("fact", "facts", "fac", "f", "isfact", "factual", "yes", "true")
NONFACT = ("nonfact", "nonfacts", "nonfac", "nf", "notafact", "notfact", "nofact", "nonfactual", "no", "false")
#: Pairs of people that a task sums up before it hands them on, and votes of an item in one part of it.
HELD_PAIRS, CELL_VOTES = 500_000, 1000
#: Votes of the mean annotator that are added to each one's own.
SHRINK = 8.0


def vote(label: Column) -> Column:
    """1 for fact, -1 for non-fact, null for what is blank or evasive."""
    word = F.regexp_replace(F.lower(label), r"[^a-z01]", "")
    return F.when(word.isin(*FACT, "1"), 1).when(word.isin(*NONFACT, "0"), -1)


def latest_votes(annotations: DataFrame) -> DataFrame:
    """(dataset_id, item_index, user_id, person, vote): one row per person and item, by the latest label."""
    a = annotations.filter("dataset_id is not null and item_index is not null")
    person = F.coalesce(F.concat(F.lit("u:"), "user_id"), F.concat(F.lit("row:"), F.coalesce("id", F.lit(""))))
    order = F.struct("updated_at", "created_at", "id")
    last = a.select("dataset_id", "item_index", "user_id", person.alias("person"), F.struct(order.alias("o"), vote(F.col("label")).alias("vote")).alias("x"))
    last = last.groupBy("dataset_id", "item_index", "person").agg(F.max("x").alias("x"), F.max("user_id").alias("user_id"))
    return last.select("dataset_id", "item_index", "user_id", "person", F.col("x.vote").alias("vote")).filter("vote is not null")


def _counted(p: np.ndarray, q: np.ndarray, same: np.ndarray) -> pd.DataFrame:
    x = pd.DataFrame({"i": np.minimum(p, q), "j": np.maximum(p, q), "n": 1.0, "d": same})
    return x.groupby(["i", "j"], sort=False, as_index=False).sum()


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair counts of the votes of a partition. Rows come sorted by cell (item, x, y), and a cell may span batches; where x and y differ, only pairs of
    the two parts count."""
    people: dict[str, int] = {}
    total = pd.DataFrame({"i": [], "j": [], "n": [], "d": []})
    held: list[pd.DataFrame] = []
    size = 0

    def told() -> pd.DataFrame:
        names = np.array(list(people), object)
        i, j = names[total["i"].to_numpy(np.int64)], names[total["j"].to_numpy(np.int64)]
        first = np.array([a < b for a, b in zip(i, j)], bool)
        return pd.DataFrame({"i": np.where(first, i, j), "j": np.where(first, j, i), "n": total["n"], "d": total["d"]})

    def take(pdf: pd.DataFrame) -> None:
        nonlocal held, size, total
        codes = np.array([people.setdefault(u, len(people)) for u in pdf["user_id"]], np.int64)
        votes, part, mixed = pdf["vote"].to_numpy(np.float64), pdf["part"].to_numpy(), (pdf["x"] != pdf["y"]).to_numpy()
        cell = pdf.groupby(["item", "x", "y"], sort=False).ngroup().to_numpy()
        lag = 1
        while lag < len(cell):
            at = np.nonzero(cell[lag:] == cell[:-lag])[0]
            if not len(at):  # cells lie together, so no longer distance has any
                break
            at = at[~mixed[at] | (part[at] != part[at + lag])]
            held.append(_counted(codes[at], codes[at + lag], votes[at] * votes[at + lag]))
            size += len(held[-1])
            lag += 1
            if size > HELD_PAIRS:
                total = pd.concat([total, *held]).groupby(["i", "j"], sort=False, as_index=False).sum()
                held, size = [], 0

    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf])
        if len(rest):
            last = rest.iloc[-1]
            open_ = ((rest["item"] == last["item"]) & (rest["x"] == last["x"]) & (rest["y"] == last["y"])).to_numpy()
            take(rest[~open_])
            rest = rest[open_]
        if len(total) > HELD_PAIRS:
            total = pd.concat([total, *held]).groupby(["i", "j"], sort=False, as_index=False).sum()
            yield told()
            held, size = [], 0
            total, people = total.iloc[:0], {}
    if rest is not None and len(rest):
        take(rest)
    total = pd.concat([total, *held]).groupby(["i", "j"], sort=False, as_index=False).sum()
    yield told()


def agreement(votes: DataFrame) -> DataFrame:
    """(i, j, n, c) for two people i < j who labelled n items in common; c is 2 P(agree) - 1."""
    v = votes.filter("user_id is not null").select(F.xxhash64("dataset_id", "item_index").alias("item"), "user_id", "vote")
    parts = v.groupBy("item").agg(F.count("*").alias("m")).filter("m > 1").select("item", F.ceil(F.col("m") / CELL_VOTES).cast("int").alias("parts"))
    v = v.join(parts, "item").withColumn("part", F.pmod(F.xxhash64("user_id"), F.col("parts")).cast("int"))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})
    v = v.select("item", "x", "y", "part", "user_id", "vote").repartition("item", "x", "y").sortWithinPartitions("item", "x", "y")
    pairs = v.mapInPandas(_grams, "i string, j string, n double, d double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return cut(pairs.select("i", "j", "n", (F.col("d") / F.col("n")).alias("c")))


def triplets(pairs: DataFrame) -> DataFrame:
    """(a, b, e, n_ab, c_ab, n_ae, c_ae, n_be, c_be): each three people of whom all met, once; a met the fewest."""
    ends = pairs.select("i").unionByName(pairs.select(F.col("j").alias("i"))).groupBy("i").agg(F.count("*").alias("met"))
    one = pairs.join(ends.withColumnRenamed("met", "mi"), "i").join(ends.select(F.col("i").alias("j"), F.col("met").alias("mj")), "j")
    ranked = lambda m, k: F.struct(F.col(m).alias("met"), F.col(k).alias("who"))
    low, high = F.least(ranked("mi", "i"), ranked("mj", "j")), F.greatest(ranked("mi", "i"), ranked("mj", "j"))
    out = cut(one.select(low["who"].alias("a"), high["who"].alias("b"), high.alias("o"), "n", "c"))
    side = lambda k: out.select("a", F.col("b").alias(k), F.col("o").alias(f"o_{k}"), F.col("n").alias(f"n_a{k}"), F.col("c").alias(f"c_a{k}"))
    wedges = side("b").join(side("e"), "a").filter("o_b < o_e").drop("o_b", "o_e")
    return wedges.join(out.select(F.col("a").alias("b"), F.col("b").alias("e"), F.col("n").alias("n_be"), F.col("c").alias("c_be")), ["b", "e"])


def reliabilities(votes: DataFrame) -> DataFrame:
    """(user_id, n_votes, n_compared, accuracy): the estimate for each annotator; see the module."""
    pairs = agreement(votes)
    p = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "c"))
    # Least squares of c_ij c_ik = a_i^2 c_jk, weighted by the harmonic mean of the three counts. The square of c_jk
    # is taken without the noise of few votes, else all would look less reliable than they are. Each triplet tells of all its three.
    w = 3 / (1 / F.col("n_ab") + 1 / F.col("n_ae") + 1 / F.col("n_be"))
    product = w * F.col("c_ab") * F.col("c_ae") * F.col("c_be")

    def of(i: str, n: str, c: str) -> Column:
        n_, c_ = F.col(n), F.col(c)
        return F.when(n_ > 1, F.struct(F.col(i).alias("i"), product.alias("up"), (w * (n_ * c_ * c_ - 1) / (n_ - 1)).alias("down")))

    told = triplets(pairs).select(F.explode(F.array(of("a", "n_be", "c_be"), of("b", "n_ae", "c_ae"), of("e", "n_ab", "c_ab"))).alias("t")).filter("t is not null")
    square = told.groupBy("t.i").agg(F.sum("t.up").alias("up"), F.sum("t.down").alias("down"))
    side = p.groupBy("i").agg(F.sum(F.col("n") * F.col("c")).alias("lean"), F.sum("n").alias("n_compared"))
    counts = votes.filter("user_id is not null").groupBy(F.col("user_id").alias("i")).agg(F.count("*").alias("n_votes"))
    raw = counts.join(side, "i", "left").join(square, "i", "left")
    size = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("up") / F.when(F.col("down") > 0, F.col("down")))))
    raw = raw.withColumn("a", F.when(F.col("lean") < 0, -size).otherwise(size))
    mean = raw.agg((F.sum(F.col("a") * F.col("n_compared")) / F.sum(F.when(F.col("a").isNotNull(), F.col("n_compared")))).alias("mean_a"))
    # n_compared counts a vote once for each partner; what it is worth is at most the votes themselves.
    n = F.when(F.col("a").isNotNull(), F.least(F.col("n_votes"), F.coalesce("n_compared", F.lit(0.0)))).otherwise(F.lit(0.0))
    a = (F.coalesce("a", F.lit(0.0)) * n + F.coalesce("mean_a", F.lit(0.5)) * SHRINK) / (n + SHRINK)
    return cut(raw.crossJoin(F.broadcast(mean)).select(F.col("i").alias("user_id"), "n_votes", F.coalesce("n_compared", F.lit(0.0)).alias("n_compared"), ((1 + a) / 2).alias("accuracy")))


def consensus(annotations: DataFrame) -> DataFrame:
    """(dataset_id, item_index, label, n_votes, agreement, probability): a row per item with a vote.

    agreement is the share of votes for the item's more common vote; probability is that of the label.
    """
    votes = cut(latest_votes(annotations))
    people = reliabilities(votes)
    clip = lambda c: F.greatest(F.lit(0.02), F.least(F.lit(0.98), c))
    accuracy = clip(F.coalesce("accuracy", "mean_accuracy", F.lit(0.75)))
    facts = votes.agg(F.avg("vote").alias("balance"), F.count("*").alias("all"))
    mean = people.agg((F.sum(F.col("accuracy") * F.col("n_votes")) / F.sum("n_votes")).alias("mean_accuracy"))
    odds = F.log(accuracy / (1 - accuracy)) * F.col("vote")
    # People are few against votes; the join falls back to a shuffle where they are too many to broadcast.
    scored = votes.join(people.select("user_id", "accuracy"), "user_id", "left").crossJoin(F.broadcast(mean)).withColumn("odds", odds)
    items = scored.groupBy("dataset_id", "item_index").agg(F.sum("odds").alias("odds"), F.sum(F.col("vote")).alias("lead"), F.count("*").alias("n_votes"), F.first("mean_accuracy").alias("m"))
    # The share of facts among items follows from that among votes: balance = (2m-1) (2 share - 1).
    share = clip((1 + F.col("balance") / (2 * F.col("m") - 1)) / 2)
    total = F.round(F.col("odds") + F.coalesce(F.log(share / (1 - share)), F.lit(0.0)), 9)
    fact = (total > 0) | ((total == 0) & (F.col("balance") >= 0))
    return items.crossJoin(F.broadcast(facts)).select(
        "dataset_id", "item_index", F.when(fact, "fact").otherwise("non-fact").alias("label"), "n_votes",
        ((F.col("n_votes") + F.abs("lead")) / (2 * F.col("n_votes"))).alias("agreement"), (1 / (1 + F.exp(-F.abs(total)))).alias("probability"),
    )
