"""Silver labels, scores, percentiles, leakage mask, folds and hold-outs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The enzymes that labels rest on.
CYP5 = ["CYP1A2", "CYP2C9", "CYP2C19", "CYP2D6", "CYP3A4"]


def _set(edges: DataFrame, key: str, name: str) -> DataFrame:
    return edges.groupBy(F.col("src").alias(key)).agg(F.collect_set("dst").alias(name))


def silver_labels(compounds: DataFrame, drugs: DataFrame, inhibits: DataFrame, substrate: DataFrame, non_substrate: DataFrame) -> DataFrame:
    """compound, drug, label, enzymes of every pair.

    compounds: compound, ok.  Label -1 without assay data or if an inhibited enzyme's role for the drug is unknown,
    1 if the compound inhibits an enzyme that the drug is a substrate of (substrate beats non-substrate), else 0.
    The drug side is a catalogue; it is broadcast only below Spark's own limit.
    """
    none = F.array().cast("array<string>")
    c = compounds.join(_set(inhibits, "compound", "ci"), "compound", "left").withColumn("ci", F.coalesce("ci", none))
    d = drugs.join(_set(substrate, "drug", "ds"), "drug", "left").join(_set(non_substrate, "drug", "dn"), "drug", "left").select("drug", F.coalesce("ds", none).alias("ds"), F.coalesce("dn", none).alias("dn"))
    hit, unknown = F.array_intersect("ci", "ds"), F.array_except(F.array_except("ci", "ds"), F.col("dn"))
    pairs = c.crossJoin(d).withColumn("hit", hit).withColumn("unknown", unknown)
    label = F.when(~F.col("ok"), -1).when(F.size("hit") > 0, 1).when(F.size("unknown") > 0, -1).otherwise(0)
    enzymes = F.when(F.col("ok") & (F.size("hit") > 0), F.col("hit")).when(F.col("ok") & (F.size("unknown") > 0), F.col("unknown")).otherwise(none)
    return pairs.select("compound", "drug", label.alias("label"), F.array_join(F.array_sort(enzymes), ";").alias("enzymes"))


def label_conflicts(substrate: DataFrame, non_substrate: DataFrame) -> DataFrame:
    """drug, gene that are among both edge sets."""
    return substrate.select(F.col("src").alias("drug"), F.col("dst").alias("gene")).intersect(non_substrate.select("src", "dst"))


def by_pattern(contains: DataFrame, scored: DataFrame, value: str) -> DataFrame:
    """(herb, drug, value, m, n): how many rows (m) and different compounds (n) of a herb have a value for a drug.

    contains: src, dst; scored: compound, drug, value.  Compounds with equal values for all drugs are one pattern, and
    herbs are joined with patterns: a herb's compounds are not multiplied by the drugs.  A value that a compound has
    twice for a drug counts twice in m; n counts the compound at its first value there.
    """
    rows = scored.groupBy("compound").agg(F.array_sort(F.collect_list(F.struct("drug", F.col(value).alias("value")))).alias("p")).withColumn("key", F.unhex(F.md5(F.to_json("p"))))
    once = F.transform("p", lambda x, i: F.struct(x["drug"].alias("drug"), x["value"].alias("value"), ((i == 0) | (F.get("p", i - 1)["drug"] != x["drug"])).cast("int").alias("first")))
    patterns = rows.groupBy("key").agg(F.first("p").alias("p")).select("key", once.alias("p"))
    own = contains.groupBy(F.col("src").alias("herb"), F.col("dst").alias("compound")).agg(F.count("*").alias("m"))
    counted = own.join(rows.select("compound", "key"), "compound").groupBy("herb", "key").agg(F.sum("m").alias("m"), F.count("*").alias("n"))
    cells = counted.join(patterns, "key").select("herb", "m", "n", F.inline("p"))
    return cells.select("herb", "drug", "value", "m", (F.col("n") * F.col("first")).alias("n"))


def herb_drug_scores(labels: DataFrame, contains: DataFrame) -> DataFrame:
    """herb, drug, n_pos, n_labelled, n_compounds, frac_pos (null where nothing is labelled)."""
    m = lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0)).cast("long")
    out = by_pattern(contains, labels, "label").groupBy("herb", "drug").agg(m(F.col("value") == 1).alias("n_pos"), m(F.col("value") >= 0).alias("n_labelled"), F.sum("n").alias("n_compounds"))
    return out.withColumn("frac_pos", F.col("n_pos") / F.nullif("n_labelled", F.lit(0)))


def with_percentiles(rows: DataFrame, value: str, average: str | None = None, at_most: str | None = None, by: list[str] | None = None) -> DataFrame:
    """rows with `average` (mean rank of equal values over the number of rows) and `at_most` (share of rows not above).

    Rows are counted per distinct value first, so that windows see the distinct values only; nulls are left out.
    """
    by = by or []
    steps = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    part = Window.partitionBy(*(by or [F.lit(1)]))
    upto, total = F.sum("__n").over(part.orderBy(value)), F.sum("__n").over(part)
    ranks = {average: (upto - (F.col("__n") - 1) / 2) / total, at_most: upto / total}
    steps = steps.select(*by, value, *[c.alias(name) for name, c in ranks.items() if name])
    return rows.join(steps, [*by, value])


def gold_vs_silver(gold: DataFrame, scores: DataFrame) -> DataFrame:
    """Gold pairs (herb, drug, ...) with score and percentile among scored pairs; unmatched ones stay with nulls."""
    ranked = with_percentiles(scores.where("n_labelled > 0"), "frac_pos", "pct")
    return gold.join(ranked.select("herb", "drug", "frac_pos", "pct"), ["herb", "drug"], "left")


def mask_label_edges(edges: DataFrame, enzymes: list[str] = CYP5, dropped: tuple[str, ...] = ("predicted_cyp_inhibitor", "substrate_of", "non_substrate_of"), masked: tuple[str, ...] = ("modulates", "targets")) -> DataFrame:
    """(etype, src, dst) without what labels could be derived from: whole types, and masked types' edges to the enzymes."""
    return edges.where(_unmasked(enzymes, dropped, masked))


def _unmasked(enzymes: list[str] = CYP5, dropped: tuple[str, ...] = ("predicted_cyp_inhibitor", "substrate_of", "non_substrate_of"), masked: tuple[str, ...] = ("modulates", "targets")) -> Column:
    return ~F.col("etype").isin(*dropped) & ~(F.col("etype").isin(*masked) & F.col("dst").isin(*enzymes))


def assert_no_label_leak(edges: DataFrame, **how) -> None:
    if not edges.where(~F.coalesce(_unmasked(**how), F.lit(False))).isEmpty():
        raise AssertionError("edges that labels derive from are left")


def assign_folds(ids: DataFrame, k: int = 5, seed: int = 0, key: str = "id") -> DataFrame:
    """key, fold: balanced to one, the same for a seed whatever the order of rows.

    Rows are dealt by place in md5 order.  The place is counted within 4096 ranges of the hash and carried across
    them, so no task sorts all ids.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    rows = ids.select(key).distinct().withColumn("h", h).withColumn("range", F.substring("h", 1, 3))
    sizes = rows.groupBy("range").count()
    before = sizes.select("range", (F.sum("count").over(Window.partitionBy(F.lit(1)).orderBy("range")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", key)) - 1
    return rows.withColumn("place", place).join(F.broadcast(before), "range").select(key, ((F.col("place") + F.col("before")) % k).cast("int").alias("fold"))


def herb_holdout(contains: DataFrame, test: DataFrame) -> DataFrame:
    """compound, role: train (in no held-out herb), test (in held-out herbs only) or shared (dropped)."""
    held = test.select(F.col("herb").alias("src")).distinct().withColumn("held", F.lit(True))
    both = contains.join(held, "src", "left").groupBy(F.col("dst").alias("compound")).agg(F.bool_or(F.coalesce("held", F.lit(False))).alias("any"), F.bool_and(F.coalesce("held", F.lit(False))).alias("every"))
    return both.select("compound", F.when(~F.col("any"), "train").when(F.col("every"), "test").otherwise("shared").alias("role"))


def herb_group_folds(contains: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """fold, compound, role for each of k hold-outs, in one pass over the compound's herbs."""
    folds = assign_folds(contains.select(F.col("src").alias("id")), k, seed)
    held = contains.join(folds.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("compound")).agg(F.collect_set("fold").alias("in"))
    every = held.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    role = F.when(~F.array_contains("in", F.col("fold")), "train").when(F.size("in") == 1, "test").otherwise("shared")
    return every.select("fold", "compound", role.alias("role"))


def assert_disjoint(a: DataFrame, b: DataFrame) -> None:
    if a.intersect(b).limit(1).count():
        raise AssertionError("the two sides share ids")


SPLITS = ("cold_compound", "cold_herb", "cold_drug", "random_pair")


def make_folds(split: str, labels: DataFrame, contains: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """fold, compound, drug, label, role (train or test) of every pair labelled 0 or 1 in each of k folds.

    cold_compound, cold_drug: a fold's compounds (drugs) are in its test only.  cold_herb: compounds of held-out herbs
    only are tested, those that other herbs have too are in neither.  random_pair: pairs are dealt one by one.
    """
    rows = labels.where(F.col("label").isin(0, 1)).select("compound", "drug", "label")
    role = lambda own: F.when(F.col(own) == F.col("fold"), "test").otherwise("train").alias("role")
    out = ["fold", "compound", "drug", "label"]
    if split == "cold_herb":
        return rows.join(herb_group_folds(contains, k, seed).where("role <> 'shared'"), "compound").select(*out, "role")
    if split in ("cold_compound", "cold_drug"):
        key = split[5:]
        dealt = assign_folds(labels.select(F.col(key).alias("id")), k, seed)
        rows = rows.join(dealt.select(F.col("id").alias(key), F.col("fold").alias("own")), key)
    elif split == "random_pair":
        pair = F.concat_ws("|", F.col("compound").cast("string"), F.col("drug").cast("string"))
        dealt = assign_folds(rows.select(pair.alias("id")), k, seed)
        rows = rows.withColumn("id", pair).join(dealt.withColumnRenamed("fold", "own"), "id")
    else:
        raise ValueError(f"unknown split {split!r}; choose from {SPLITS}")
    return rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(*out, role("own"))


def cross_validate(folds: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame], k_top: int = 100) -> DataFrame:
    """fold, n_train, n, n_pos, auroc, auprc, precision_at_k of all folds at once.

    predict(train, test), both with a column fold, returns test's rows with p; it must keep folds apart.
    """
    from graphloom.functions.metrics import ranking_metrics

    train, test = (folds.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    scored = predict(train, test)
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("p"), "compound", "drug"))
    best = scored.withColumn("place", place).where(F.col("place") <= k_top).groupBy("fold").agg(F.avg(F.col("label").cast("double")).alias("precision_at_k"))
    return ranking_metrics(scored, ["fold"]).join(train.groupBy("fold").agg(F.count("*").alias("n_train")), "fold", "left").join(best, "fold").select("fold", "n_train", "n", "n_pos", "auroc", "auprc", "precision_at_k")


def prior_by_fold(train: DataFrame, test: DataFrame) -> DataFrame:
    """A predictor for cross_validate: the drug's share of ones among the fold's training rows, else the fold's."""
    rate = train.groupBy("fold", "drug").agg(F.avg("label").alias("rate"))
    overall = train.groupBy("fold").agg(F.avg("label").alias("overall"))
    return test.join(rate, ["fold", "drug"], "left").join(F.broadcast(overall), "fold", "left").withColumn("p", F.coalesce("rate", "overall")).drop("rate", "overall")


def averaged_predictions(predictions: DataFrame) -> DataFrame:
    """(seed, fold, compound, drug, p) to compound, drug, p (mean), n of each pair."""
    return predictions.groupBy("compound", "drug").agg(F.avg("p").alias("p"), F.count("*").alias("n"))


def label_histogram(labels: DataFrame) -> DataFrame:
    """drug, n_pos, n_neg, n_unknown, share_pos (of the known; null if there are none)."""
    one = lambda x: F.count_if(F.col("label") == x)
    out = labels.groupBy("drug").agg(one(1).alias("n_pos"), one(0).alias("n_neg"), one(-1).alias("n_unknown"))
    return out.withColumn("share_pos", F.col("n_pos") / F.nullif(F.col("n_pos") + F.col("n_neg"), F.lit(0)))


def prior_scores(train: DataFrame, test: DataFrame, key: str = "drug") -> DataFrame:
    """Test rows with p: the key's share of ones in training, else the global share."""
    rate = train.groupBy(key).agg(F.avg("label").alias("rate"))
    overall = train.agg(F.avg("label").alias("overall"))
    return test.join(rate, key, "left").crossJoin(F.broadcast(overall)).withColumn("p", F.coalesce("rate", "overall")).drop("rate", "overall")
