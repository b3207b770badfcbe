"""Latest rows, top-k, budgets, skylines, splits and samples. Every ranking has a total order, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.session import cut


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that is largest by order; rows equal in order are told apart by all columns.

    An aggregate, not a window: partial maxima are taken before the shuffle, so a key with most rows is no burden.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.max(row).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.min(row).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key with their rank; Spark cuts to k before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def running_total(df: DataFrame, keys: list[str], value: Column, *order: Column) -> DataFrame:
    """df with running: the sum of value over the rows of the key up to this one by order, which must be total.

    Rows are sorted into ranges of keys and order, so a key with most rows is spread over many tasks: each range is summed by itself, and the sums of the
    ranges before it, a table of a row per key and range, are added.
    """
    names = [f"__o{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(names, order))).withColumn("__v", value)
    ranged = cut(ranged.repartitionByRange(*keys, *names).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "__range").agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = F.sum("__v").over(Window.partitionBy(*keys, "__range").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__in", inside).join(sums, same).withColumn("running", F.col("__before") + F.col("__in")).select(*df.columns, "running")


def within_budget(df: DataFrame, keys: list[str], size: str, budget: int, *order: Column) -> DataFrame:
    """Rows in order while the running total of size stays within the budget of their key."""
    return running_total(df, keys, F.col(size), *order).filter(F.col("running") <= budget)


def skyline(df: DataFrame, quality: str, cost: str, buckets: int = 256) -> DataFrame:
    """Rows that no other row beats: none has at least the quality at most the cost and is better in one.

    Per cost the best quality is pre-aggregated; ranges of cost are compared by their maxima first and then inside each range, so no
    window spans all rows.
    """
    best = df.groupBy(F.col(cost).alias("__c")).agg(F.max(quality).alias("__q"))
    edges = best.agg(F.min("__c").alias("lo"), F.max("__c").alias("hi"))
    ranged = best.crossJoin(F.broadcast(edges)).withColumn("__b", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("__c") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).otherwise(0)).drop("lo", "hi")
    tops = ranged.groupBy("__b").agg(F.max("__q").alias("__t"))  # at most buckets + 1 rows
    before = tops.withColumn("__before", F.max("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__b", "__before")
    inside = F.max("__q").over(Window.partitionBy("__b").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    kept = ranged.withColumn("__in", inside).join(F.broadcast(before), "__b").filter((F.col("__in").isNull() | (F.col("__q") > F.col("__in"))) & (F.col("__before").isNull() | (F.col("__q") > F.col("__before"))))
    return df.join(kept.select("__c", "__q"), (F.col(cost) == F.col("__c")) & (F.col(quality) == F.col("__q")), "left_semi")


def stratified_split(df: DataFrame, strata: list[str], order: Column, train: float, validation: float) -> DataFrame:
    """df with split: in each stratum, by order, the first share to train, the next to validation, the rest to test (shares rounded half even)."""
    placed = running_total(df, strata, F.lit(1), order)
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__n")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(strata)], "__n")
    same = F.lit(True)
    for i, k in enumerate(strata):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    a, b = F.bround(F.col("__n") * train), F.bround(F.col("__n") * validation)
    k = F.col("running")
    return placed.join(sizes, same).withColumn("split", F.when(k <= a, "train").when(k <= a + b, "validation").otherwise("test")).select(*df.columns, "split")


def balanced_counts(lengths: DataFrame, key: str, length: str, limit: int) -> DataFrame:
    """(key, take): how many to take of each key so that takes are as even as the lengths allow and sum to the limit at most.

    The level is found from counts per length, a table of distinct lengths, not from the keys.
    """
    by = lengths.filter(F.col(length) > 0).groupBy(F.col(length).alias("l")).agg(F.count("*").alias("n"))
    w = Window.orderBy("l")
    level = by.withColumns({"used": F.coalesce(F.sum(F.col("l") * F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "left": F.sum("n").over(w.rowsBetween(0, Window.unboundedFollowing))})
    level = level.withColumn("level", F.floor((F.lit(limit) - F.col("used")) / F.col("left"))).filter(F.col("level") <= F.col("l")).agg(F.min_by("level", "l").alias("level"))
    return lengths.crossJoin(F.broadcast(level)).select(key, F.least(F.col(length), F.coalesce("level", F.col(length))).alias("take"))
