"""Evaluation measures as aggregates. Shares of nothing are 0, as the callers expect; agreement of fewer than two raters is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def confusion(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """(*by, tp, fp, fn, tn); rows with a null on either side are left out."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    return df.filter(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def scores(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1 and accuracy."""
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "accuracy": share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def micro_macro(df: DataFrame, gold: str, pred: str, by: str) -> DataFrame:
    """One row: micro scores from summed counts, macro as plain means of the groups'."""
    per = scores(confusion(df, gold, pred, by))
    total = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "accuracy")])
    return scores(total).select(*[F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1", "accuracy")], *[f"macro_{c}" for c in ("precision", "recall", "f1", "accuracy")])


def best_thresholds(df: DataFrame, score: str, gold: str, *by: str, steps: int = 17, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(*by, threshold, f1): the threshold of the grid with the best F1, the lowest of equals; 0.5 where none scores.

    Each score is counted once, in the grid cell it falls in; sums over cells give all thresholds. No row meets all thresholds.
    """
    width = (high - low) / (steps - 1)
    cell = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), F.floor((F.col(score) - low) / width + 1e-9).cast("int")))
    counts = df.filter(F.col(score).isNotNull() & F.col(gold).isNotNull()).groupBy(*by, cell.alias("cell")).agg(F.count_if(F.col(gold) == 1).alias("pos"), F.count("*").alias("n"))
    grid = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.collect_list(F.struct("cell", "pos", "n")).alias("cells"))  # at most steps + 1 cells
    grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    over = F.filter("cells", lambda x: x["cell"] >= F.col("k"))
    total = lambda f: F.aggregate(F.transform(over, lambda x: x[f]), F.lit(0).cast("long"), lambda a, b: a + b)
    grid = grid.withColumns({"tp": total("pos"), "said": total("n")})
    grid = grid.withColumn("f1", F.round(share(2.0 * F.col("tp"), F.col("said") + F.col("all_pos")), 12))
    best = grid.groupBy(*by).agg(F.max_by("k", F.struct("f1", -F.col("k"))).alias("k"), F.max("f1").alias("f1"))
    return best.select(*by, F.when(F.col("f1") > 0, F.round(low + F.col("k") * width, 6)).otherwise(0.5).alias("threshold"), "f1")


def fleiss_kappa(ratings: DataFrame, item: list[str], category: str) -> DataFrame:
    """One row (n_items, kappa) over the items with the commonest number of ratings."""
    n = ratings.select(F.struct(*item).alias("__i"), F.col(category).alias("__k")).groupBy("__i", "__k").agg(F.count("*").alias("c"))
    per = n.groupBy("__i").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.map_from_entries(F.collect_list(F.struct("__k", "c"))).alias("m"))
    common = per.filter("n > 1").groupBy("n").agg(F.count("*").alias("k")).agg(F.max_by("n", F.struct("k", "n")).alias("common"))
    kept = per.crossJoin(F.broadcast(common)).filter("n = common")
    shares = kept.select(F.explode("m").alias("cat", "c"), "n").groupBy("cat").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("all"))
    a = kept.agg(F.count("*").alias("n_items"), F.avg(F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("pa")).crossJoin(shares)
    pe = F.col("sq") / (F.col("all") * F.col("all"))
    return a.select("n_items", F.when(F.col("n_items") == 0, None).when(F.abs(1 - pe) < 1e-15, 1.0).otherwise((F.col("pa") - pe) / (1 - pe)).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, unit: list[str], category: str) -> DataFrame:
    """One row (n_units, alpha), nominal; units with one rating are skipped; all alike gives 1.

    The expected disagreement is that of draws with replacement, 1 less the sum of the squared shares of the categories, as in the published values.
    """
    n = ratings.filter(F.col(category).isNotNull()).select(F.struct(*unit).alias("__i"), F.col(category).alias("__k")).groupBy("__i", "__k").agg(F.count("*").alias("c"))
    per = n.groupBy("__i").agg(F.sum("c").alias("m"), F.collect_list(F.struct(F.col("__k").alias("cat"), "c")).alias("l")).filter("m > 1")
    inner = F.aggregate("l", F.lit(0).cast("long"), lambda acc, x: acc + x["c"] * (x["c"] - 1))
    agree = per.agg(F.count("*").alias("n_units"), F.sum("m").alias("n"), F.sum(inner / (F.col("m") - 1)).alias("same"))
    cats = per.select(F.explode("l").alias("x")).groupBy("x.cat").agg(F.sum("x.c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("chance"))
    do, de = 1 - F.col("same") / F.col("n"), 1 - F.col("chance") / (F.col("n") * F.col("n"))
    return agree.crossJoin(cats).select("n_units", F.when(de <= 1e-15, F.when(do <= 1e-15, 1.0)).otherwise(1 - do / de).alias("alpha"))


def interpret(kappa: Column) -> Column:
    return F.when(kappa.isNull(), "undefined").when(kappa > 0.8, "almost perfect").when(kappa > 0.6, "substantial").when(kappa > 0.4, "moderate").when(kappa > 0.2, "fair").when(kappa > 0, "slight").otherwise("poor")


def set_scores(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row of micro precision, recall, F1 and exact matches of two array columns; a null prediction is empty."""
    g, p = F.coalesce(gold, F.array().cast("array<string>")), F.coalesce(pred, F.array().cast("array<string>"))
    a = df.agg(F.sum(F.size(F.array_intersect(g, p))).alias("tp"), F.sum(F.size(F.array_except(p, g))).alias("fp"), F.sum(F.size(F.array_except(g, p))).alias("fn"), F.avg(((F.size(F.array_except(g, p)) == 0) & (F.size(F.array_except(p, g)) == 0)).cast("double")).alias("exact"))
    pr, rc = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.select("tp", "fp", "fn", pr.alias("precision"), rc.alias("recall"), f1(pr, rc).alias("f1"), "exact")


def correlations(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """One row (n, pearson, spearman); ranks are positions in sorted order, ties by key, not averaged; null under three rows.

    Positions over all rows come from a range-partitioned sort: counts of the partitions, then row numbers within each.
    """
    kept = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for c in ("x", "y"):
        part = kept.repartitionByRange(F.col(c), F.col(key)).withColumn("__p", F.spark_partition_id())
        part = part.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(c, key)))
        sizes = part.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        kept = part.join(F.broadcast(sizes.select("__p", "__before")), "__p").withColumn(f"r{c}", F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")
    return kept.agg(F.count("*").alias("n"), F.corr("x", "y").alias("p"), F.corr("rx", "ry").alias("s")).select("n", *[F.when(F.col("n") >= 3, F.col(c)).alias(name) for c, name in (("p", "pearson"), ("s", "spearman"))])
