"""Pair models on masked graphs: features, message passing, inductive subgraphs, out-of-fold scores, learners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shuffles
from .labels import CYP5, assign_folds, by_pattern, prior_scores, with_percentiles

#: Levels that an interaction profile counts, before its total.
PROFILE = ["Major", "Moderate", "Minor"]

FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def frequent_targets(edges: DataFrame, most: int = 256) -> list:
    """Targets with the most distinct sources, ties by name: at most `most` values reach the driver."""
    top = edges.groupBy("dst").agg(F.count_distinct("src").alias("n")).orderBy(F.desc("n"), "dst").limit(most)
    return [r["dst"] for r in top.collect()]


def flags(ids: DataFrame, edges: DataFrame, targets: list, name: str) -> DataFrame:
    """(id, name): an array of 1.0 and 0.0, one entry a target, for every id."""
    own = edges.where(F.col("dst").isin(targets)).groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("own"))
    kind = dict(edges.dtypes)["dst"]
    have = F.coalesce("own", F.array().cast(f"array<{kind}>"))
    hot = F.array(*[F.array_contains(have, t).cast("double") for t in targets]) if targets else F.array().cast("array<double>")
    return ids.select("id").join(own, "id", "left").select("id", hot.alias(name))


def interaction_profile(ids: DataFrame, pairs: DataFrame, levels: list[str] = PROFILE) -> DataFrame:
    """(id, profile): interactions (src, dst, level) of an id at each level, and all of them."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id"), "level")
    counts = ends.groupBy("id").agg(F.array(*[F.count_if(F.col("level") == v).cast("double") for v in levels], F.count("*").cast("double")).alias("p"))
    return ids.select("id").join(counts, "id", "left").select("id", F.coalesce("p", F.array(*[F.lit(0.0)] * (len(levels) + 1))).alias("profile"))


def compound_features(compounds: DataFrame, modulates: DataFrame, pgp: DataFrame, most: int = 256) -> DataFrame:
    """(id, x): optional `fingerprint` array of the compound, its frequent targets, and whether pgp (src) has it."""
    hot = flags(compounds, modulates, frequent_targets(modulates, most), "hot")
    listed = pgp.select(F.col("src").alias("id")).distinct().withColumn("pgp", F.lit(1.0))
    first = F.col("fingerprint").cast("array<double>") if "fingerprint" in compounds.columns else F.array().cast("array<double>")
    return compounds.join(hot, "id").join(listed, "id", "left").select("id", F.concat(first, "hot", F.array(F.coalesce("pgp", F.lit(0.0)))).alias("x"))


def drug_features(drugs: DataFrame, targets: DataFrame, pairs: DataFrame, classes: list[str], levels: list[str] = PROFILE, most: int = 256) -> DataFrame:
    """(id, x): frequent targets, class (cls) as flags, interaction profile."""
    hot = flags(drugs, targets, frequent_targets(targets, most), "hot")
    cls = F.array(*[F.coalesce((F.col("cls") == c).cast("double"), F.lit(0.0)) for c in classes])
    return drugs.join(hot, "id").join(interaction_profile(drugs, pairs, levels), "id").select("id", F.concat("hot", cls, "profile").alias("x"))


def leaky_features(ids: DataFrame, edges: list[DataFrame], enzymes: list[str] = CYP5) -> DataFrame:
    """(id, x): flags of the label enzymes from each unmasked edge set.  For the leakage ablation only."""
    out = ids.select("id", F.array().cast("array<double>").alias("x"))
    for e in edges:
        out = out.join(flags(ids, e, enzymes, "more"), "id").select("id", F.concat("x", "more").alias("x"))
    return out


def inductive_edges(edges: DataFrame, train: DataFrame, held_types: list[str]) -> DataFrame:
    """(etype, src, dst) whose ends are no held-out node: nodes (id) of `held_types` edges must both be in `train`."""
    keep = train.select("id").distinct()
    bound = edges.where(F.col("etype").isin(held_types))
    for end in ("src", "dst"):
        bound = bound.join(keep.withColumnRenamed("id", end), end, "left_semi")
    return edges.where(~F.col("etype").isin(held_types)).unionByName(bound.select(*edges.columns))


def linear(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """weights (out x in) times x plus bias; both are constants of the plan."""
    w = F.array(*[F.array(*map(F.lit, row)) for row in weights])
    b = F.array(*map(F.lit, bias or [0.0] * len(weights)))
    return F.zip_with(w, b, lambda r, c: F.aggregate(F.zip_with(r, x, lambda p, q: p * q), c, lambda s, v: s + v))


def message_passing(nodes: DataFrame, edges: DataFrame, layer: dict[str, tuple[list[list[float]], list[list[float]], list[float]]]) -> DataFrame:
    """One round over (id, x): relu(sum over relations of (W_nb mean of neighbours + W_own x + b) + x).

    edges: etype, src, dst, read from src to dst.  layer: per relation W_nb, W_own and b.  A relation without edges
    into a node adds its own part only where one of its edges ends at a node of that node's type (`type` of nodes).
    The mean is a column per element, so the shuffle combines on the map side whatever a node's degree is; nodes meet the
    edges whole, and the ends that edges have are made distinct before their types are looked up.
    """
    size = len(next(iter(layer.values()))[2])
    n = shuffles.tasks(edges, nodes)
    used = edges.where(F.col("etype").isin(list(layer))).select("etype", "src", "dst")
    known = nodes.where(F.size("x") > 0).select(F.col("id").alias("src"), "x")
    means = used.repartition(n, "src").join(known, "src").groupBy("etype", "dst").agg(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(size)])
    vectors = means.select("etype", "dst", F.array(*[f"m{i}" for i in range(size)]).alias("m"))
    into = used.select("etype", "dst").distinct().join(nodes.select(F.col("id").alias("dst"), "type"), "dst").select("etype", "type").distinct()
    spread = nodes.join(F.broadcast(into), "type", "left").join(vectors.withColumnRenamed("dst", "id"), ["etype", "id"], "left")
    zero = F.array(*[F.lit(0.0)] * size)
    part = F.lit(None).cast("array<double>")
    for name, (neighbour, own, bias) in layer.items():
        both = F.zip_with(linear(F.coalesce("m", zero), neighbour, bias), linear(F.col("x"), own), lambda p, q: p + q)
        part = F.when(F.col("etype") == name, both).otherwise(part)
    summed = spread.groupBy("id", "type").agg(*[F.sum(F.coalesce(F.get(part, F.lit(i)), F.lit(0.0))).alias(f"s{i}") for i in range(size)], F.first("x").alias("x"))
    return summed.select("id", "type", F.array(*[F.greatest(F.col(f"s{i}") + F.col("x")[i], F.lit(0.0)) for i in range(size)]).alias("x"))


def pair_features(pairs: DataFrame, compounds: DataFrame, drugs: DataFrame) -> DataFrame:
    """Pairs (compound, drug, ...) with x: both sides' features after one another."""
    return pairs.join(compounds.select(F.col("id").alias("compound"), F.col("x").alias("xc")), "compound").join(drugs.select(F.col("id").alias("drug"), F.col("x").alias("xd")), "drug").withColumn("x", F.concat("xc", "xd")).drop("xc", "xd")


def forest_learner(trees: int = 200, seed: int = 0, least: int = 2, depth: int = 12) -> FitPredict:
    """Random forest on `x`, a sqrt of features a split.  Trained in parallel over partitions; bins stand for values."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        model = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=trees, minInstancesPerNode=least, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(train.select(array_to_vector("x").alias("v"), F.col("label").cast("double").alias("y")))
        return model.transform(test.withColumn("v", array_to_vector("x"))).withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")

    return run


def prior_learner(key: str = "drug") -> FitPredict:
    """A key's share of ones, else the global one."""
    return lambda train, test: prior_scores(train, test, key)


def perceptron_learner(hidden: int = 64, rounds: int = 100, seed: int = 0) -> FitPredict:
    """A network with one hidden layer on `x`, trained by full-batch steps over the partitions."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        width = len(train.select("x").first()["x"])
        model = MultilayerPerceptronClassifier(featuresCol="v", labelCol="y", layers=[width, hidden, 2], maxIter=rounds, seed=seed).fit(train.select(array_to_vector("x").alias("v"), F.col("label").cast("double").alias("y")))
        return model.transform(test.withColumn("v", array_to_vector("x"))).withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")

    return run


def propagated_features(nodes: DataFrame, edges: DataFrame, size: int, relations: list[str]) -> DataFrame:
    """(id, x): a node's own x and, per relation, the mean x of the sources of its edges (zeros without one).

    A graph network whose weights all lie behind the propagation: it is done once, and any learner above follows.
    """
    long = nodes.select(F.col("id").alias("src"), F.posexplode("x").alias("dim", "v"))
    means = edges.where(F.col("etype").isin(relations)).join(long, "src").groupBy("etype", "dst", "dim").agg(F.avg("v").alias("v"))
    cells = means.groupBy(F.col("dst").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "etype", "dim"), "v"))).alias("m"))
    keys = F.array(*[F.lit(f"{r}|{i}") for r in relations for i in range(size)])
    near = F.transform(keys, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return nodes.join(cells, "id", "left").select("id", F.concat("x", near).alias("x"))


def _fit_rows(seen: np.ndarray, y: np.ndarray, v: np.ndarray, reg: float, steps: int = 12) -> np.ndarray:
    """A vector for each row that fits y where `seen`, given the columns' v (last entry: the row's own bias, fixed at 1)."""
    u = np.zeros((len(y), v.shape[1]))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(u @ v.T, -30, 30)))
        grad = (seen * (p - y)) @ v + reg * u
        curve = np.einsum("ij,jk,jl->ikl", seen * p * (1 - p), v, v) + reg * np.eye(v.shape[1])
        u -= np.linalg.solve(curve, grad[:, :, None])[:, :, 0]
    return u


def factor_learner(rank: int = 8, rounds: int = 6, reg: float = 0.3, seed: int = 0, most_drugs: int = 4096) -> FitPredict:
    """Logistic factors with biases of compound and drug; a pair of an unseen compound or drug gets the prior.

    The drug side is a catalogue of `most_drugs` at most (else an error) and its vectors are all the driver holds.
    Compounds stay in partitions: each round fits their vectors to the drugs' and sends back sums per drug.
    """

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        names = [r["drug"] for r in train.select("drug").distinct().limit(most_drugs + 1).collect()]
        if len(names) > most_drugs:
            raise ValueError(f"over {most_drugs} drugs")
        names.sort()
        at, d, width = {n: i for i, n in enumerate(names)}, len(names), rank + 2
        v = np.random.default_rng(seed).normal(0, 0.3, (d, width))
        v[:, rank], v[:, rank + 1] = 1.0, 0.0  # meets the compound's bias; the drug's own bias
        lists = train.groupBy("compound").agg(F.collect_list(F.struct("drug", F.col("label").cast("int").alias("label"))).alias("own")).persist()

        def dense(own) -> tuple[np.ndarray, np.ndarray]:
            seen, y = np.zeros((len(own), d)), np.zeros((len(own), d))
            for i, pairs in enumerate(own):
                for p in pairs:
                    seen[i, at[p["drug"]]] += 1
                    y[i, at[p["drug"]]] = p["label"]
            return seen, y

        def rows_of(seen: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
            fitted = _fit_rows(seen, y, v[:, : rank + 1], reg)
            return np.hstack([fitted, np.ones((len(y), 1))])

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grad, curve = np.zeros((d, width)), np.zeros((d, width, width))
            for df in frames:
                for a in range(0, len(df), 512):
                    seen, y = dense(df["own"].iloc[a : a + 512])
                    u = rows_of(seen, y, v)
                    p = 1 / (1 + np.exp(-np.clip(u @ v.T, -30, 30)))
                    grad += (seen * (p - y)).T @ u
                    curve += np.einsum("ij,ik,il->jkl", seen * p * (1 - p), u, u)
            yield pd.DataFrame({"g": [grad.ravel()], "h": [curve.ravel()]})

        free = np.r_[np.arange(rank), rank + 1]
        for _ in range(rounds):
            grad, curve = np.zeros(d * width), np.zeros(d * width * width)
            for r in lists.mapInPandas(sums, "g array<double>, h array<double>").toLocalIterator():
                grad += np.array(r["g"])
                curve += np.array(r["h"])
            g, h = grad.reshape(d, width)[:, free] + reg * v[:, free], curve.reshape(d, width, width)[:, free][:, :, free] + reg * np.eye(rank + 1)
            v[:, free] -= np.linalg.solve(h, g[:, :, None])[:, :, 0]

        def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                out = [rows_of(*dense(df["own"].iloc[a : a + 512]), v) for a in range(0, len(df), 512)]
                yield pd.DataFrame({"compound": df["compound"], "u": list(np.vstack(out)) if out else []})

        known = lists.mapInPandas(vectors, f"compound {dict(train.dtypes)['compound']}, u array<double>")
        drugs = train.sparkSession.createDataFrame([(n, v[i].tolist()) for n, i in at.items()], f"drug {dict(train.dtypes)['drug']}, v array<double>")
        z = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        scored = prior_scores(train, test).join(known, "compound", "left").join(F.broadcast(drugs), "drug", "left")
        return scored.select(*test.columns, F.coalesce(1 / (1 + F.exp(-z)), "p").alias("p"))

    return run


def out_of_fold(pairs: DataFrame, learner: FitPredict, k: int = 5, seed: int = 0, key: str = "compound", features: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(compound, drug, fold, p): every pair once, scored by a model that saw no pair of its compound.

    Labels 0 and 1 are learned from; other pairs are scored only.  Pairs and folds are made once and kept, as every
    training and scoring reads them.  `features`: compounds and drugs of `pair_features`, joined on each reading, so
    that what is kept has no x.  Drugs are a catalogue; they are broadcast.
    """
    n = shuffles.tasks(pairs, *(features or ()))
    folds = assign_folds(pairs.select(key), k, seed, key)
    rows = pairs.repartition(n, key).join(folds.repartition(n, key), key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)
    if features:
        compounds = features[0].select(F.col("id").alias("compound"), F.col("x").alias("xc")).repartition(n, "compound").sortWithinPartitions("compound").persist(StorageLevel.MEMORY_AND_DISK)
        drugs = features[1].select(F.col("id").alias("drug"), F.col("x").alias("xd")).persist(StorageLevel.MEMORY_AND_DISK)
        rows = rows.join(compounds, "compound").join(F.broadcast(drugs), "drug").withColumn("x", F.concat("xc", "xd")).drop("xc", "xd")
    out = None
    for f in range(k):
        one = learner(rows.where((F.col("fold") != f) & F.col("label").isin(0, 1)).drop("fold"), rows.where(F.col("fold") == f).drop("label"))
        one = one.select("compound", "drug", "fold", "p")
        out = one if out is None else out.unionByName(one)
    return out


def herb_drug_risk(scored: DataFrame, contains: DataFrame) -> DataFrame:
    """(herb, drug, risk, n_compounds): mean p of a herb's compounds, each counted equally."""
    rows = by_pattern(contains, scored, "p")
    known = F.when(F.col("value").isNotNull(), F.col("m"))
    return rows.groupBy("herb", "drug").agg((F.sum(F.col("value") * F.col("m")) / F.nullif(F.sum(known), F.lit(0))).alias("risk"), F.sum("n").alias("n_compounds"))


def model_scores(scored: DataFrame, contains: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold pairs with their mean score and its percentile among all herb and drug pairs.

    Means are held to 12 digits, so that pairs tie alike in whatever order they were summed.
    """
    risk = herb_drug_risk(scored, contains).withColumn("risk", F.round("risk", 12))
    ranked = with_percentiles(risk, "risk", "pct")
    return gold.join(ranked, ["herb", "drug"], "left")


def random_shares(keys: DataFrame, by: list[str], member: str, seeds: int = 5) -> DataFrame:
    """(by, member, seed, share): flat Dirichlet draws per group and seed from a hash of the names, the same every run."""
    spark = keys.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = keys.select(*by, member).repartition(tasks, *by).distinct()  # the only shuffle; seeds are columns up to the end
    text = lambda s: F.concat_ws("|", F.lit(str(s)), *[F.col(c).cast("string") for c in by], F.col(member).cast("string"))
    u = lambda s: (F.conv(F.substring(F.md5(text(s)), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    rows = rows.select(*by, member, *[(-F.ln(u(s))).alias(f"__e{s}") for s in range(seeds)])
    own = Window.partitionBy(*by)
    rows = rows.withColumns({f"__t{s}": F.sum(f"__e{s}").over(own) for s in range(seeds)})
    drawn = F.array(*[F.struct(F.lit(s).alias("seed"), (F.col(f"__e{s}") / F.col(f"__t{s}")).alias("share")) for s in range(seeds)])
    return rows.select(*by, member, F.inline(drawn))
