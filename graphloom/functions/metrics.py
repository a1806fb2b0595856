"""Tie-aware ranking metrics, agreement and retrieval metrics.  Undefined is null."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(rows: DataFrame, by: list[str] | None = None, y: str = "label", p: str = "p") -> DataFrame:
    """Per group: auroc and auprc from counts per distinct score; null if a class is missing."""
    by = by or []
    steps = rows.groupBy(*by, p).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))
    down = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down))
    neg = F.col("n") - F.col("pos")
    return steps.groupBy(*by).agg(
        (F.sum(neg * (F.col("tp") - F.col("pos") / 2)) / F.nullif(F.sum("pos") * F.sum(neg), F.lit(0.0))).alias("auroc"),
        F.when(F.sum(neg) > 0, F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.nullif(F.sum("pos"), F.lit(0.0))).alias("auprc"),
        F.sum("n").cast("long").alias("n"), F.sum("pos").cast("long").alias("n_pos"),
    )


def precision_at_k(rows: DataFrame, k: int, row_id: str, y: str = "label", p: str = "p") -> DataFrame:
    """Share of ones in the k highest scores (all rows, if fewer); ties by row_id."""
    return rows.orderBy(F.desc(p), row_id).limit(k).agg(F.avg(F.col(y).cast("double")).alias("precision"), F.count("*").alias("k"))


def grouped_auroc(rows: DataFrame, by: str, y: str = "label", p: str = "p") -> DataFrame:
    """Mean of the groups' auroc over groups with both classes, and their number."""
    return ranking_metrics(rows, [by], y, p).agg(F.avg("auroc").alias("auroc"), F.count("auroc").alias("n_groups"))


def fold_summary(results: DataFrame, by: list[str], value: str = "auroc") -> DataFrame:
    """Seeds' mean per fold first, then mean, deviation, least and most over folds."""
    folds = results.groupBy(*by, "fold").agg(F.avg(value).alias("v"))
    return folds.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_distinct("fold").alias("n_folds"))


def pairwise_kappa(long: DataFrame) -> DataFrame:
    """(item, rater, label) to Cohen's kappa of each two raters over items that both labelled."""
    a = long.select("item", F.col("rater").alias("rater_a"), F.col("label").alias("la"))
    b = long.select("item", F.col("rater").alias("rater_b"), F.col("label").alias("lb"))
    cells = a.join(b, "item").where("rater_a < rater_b").groupBy("rater_a", "rater_b", "la", "lb").agg(F.count("*").cast("double").alias("n"))
    pair = ["rater_a", "rater_b"]
    total = cells.groupBy(*pair).agg(F.sum("n").alias("items"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0.0)).alias("same"))
    left = cells.groupBy(*pair, F.col("la").alias("label")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*pair, F.col("lb").alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*pair, "label"]).groupBy(*pair).agg(F.sum(F.col("na") * F.col("nb")).alias("ab"))
    po, pe = F.col("same") / F.col("items"), F.coalesce("ab", F.lit(0.0)) / (F.col("items") * F.col("items"))
    return total.join(chance, pair, "left").select(*pair, F.col("items").cast("long").alias("n"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def annotation_problems(long: DataFrame, allowed: list[str]) -> DataFrame:
    """problem, subject: an item twice by a rater, a label that isn't allowed, an item with one rater."""
    item = F.col("item").cast("string").alias("subject")
    twice = long.groupBy("item", "rater").count().where("count > 1").select(F.lit("duplicate").alias("problem"), item)
    unknown = long.where(~F.col("label").isin(allowed)).select(F.lit("unknown label").alias("problem"), item)
    single = long.groupBy("item").agg(F.count_distinct("rater").alias("n")).where("n = 1").select(F.lit("single rater").alias("problem"), item)
    return twice.unionByName(unknown).unionByName(single)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n and spearman: the correlation of average ranks of two columns, over rows that have both."""
    from graphloom.operators.labels import with_percentiles

    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    ranked = with_percentiles(with_percentiles(both, "__a", "__ra"), "__b", "__rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("spearman"))


def recall_and_mrr(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10), by: list[str] | None = None) -> DataFrame:
    """ranked: question, id, rank; gold: question, id.  Share of questions with a gold id in the first k; mean 1 / rank."""
    by = by or []
    best = gold.select("question", "id").join(ranked, ["question", "id"], "left").groupBy(*by, "question").agg(F.min("rank").alias("best"))
    return best.groupBy(*by).agg(*[F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def large_quantiles(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n, mean and a column per share: exact continuous quantiles of few groups of any size; no nulls or NaN.

    Values are counted in 1,024 bins an octave; only those of the bins that a quantile lies in are put in order, equal
    ones counted once, so no task holds a group.  `values` is read twice: made from a repartition, it is shuffled once.
    """
    part = lambda x: F.floor(F.log2(x) * 1024) + 2**21
    v = F.col(value)
    binned = values.select(*by, v, F.when(v > 0, part(v)).when(v < 0, -part(-v)).otherwise(0).cast("int").alias("__bin"))
    sizes = binned.groupBy(*by, "__bin").agg(F.count("*").alias("__n"), F.sum(value).alias("__s"))
    group = Window.partitionBy(*by)
    sizes = sizes.withColumn("__before", F.sum("__n").over(group.orderBy("__bin")) - F.col("__n")).withColumn("__all", F.sum("__n").over(group)).withColumn("__mean", F.sum("__s").over(group) / F.col("__all"))
    place = {k: q * (F.col("__all") - 1) for k, q in shares.items()}
    holds = lambda rank, start, n: (F.col(start) <= rank) & (rank < F.col(start) + F.col(n))
    some = functools.reduce(lambda p, q: p | q, [holds(f(x), "__before", "__n") for x in place.values() for f in (F.floor, F.ceil)])
    picked = sizes.where(some).drop("__n", "__s")
    near = binned.join(F.broadcast(picked), [*by, "__bin"]).groupBy(*by, "__bin", "__before", "__all", "__mean", value).agg(F.count("*").alias("__n"))
    near = near.withColumn("__start", F.col("__before") + F.sum("__n").over(Window.partitionBy(*by, "__bin").orderBy(value)) - F.col("__n"))
    at = lambda rank: F.max(F.when(holds(rank, "__start", "__n"), v))
    ends = [c for k, x in place.items() for c in (at(F.floor(x)).alias(f"__low_{k}"), at(F.ceil(x)).alias(f"__high_{k}"))]
    out = near.groupBy(*by, "__all", "__mean").agg(*ends)
    between = lambda k: F.col(f"__low_{k}") + (F.col(f"__high_{k}") - F.col(f"__low_{k}")) * (place[k] - F.floor(place[k]))
    return out.select(*by, F.col("__all").alias("n"), F.col("__mean").alias("mean"), *[between(k).alias(k) for k in shares])
