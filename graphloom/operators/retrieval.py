"""Dense search, rank fusion, text graph and facts for batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """question, id, rank, score; queries (question, q) are a batch, held against all vectors (id, v).

    Norms are taken once a side.  The join has no key, so Spark's planner broadcasts the batch only below its limit.
    """
    q = queries.select("question", "q", norm(F.col("q")).alias("qn"))
    v = vectors.select("id", "v", norm(F.col("v")).alias("vn"))
    score = F.round(F.coalesce(dot(F.col("q"), F.col("v")) / F.nullif(F.col("qn") * F.col("vn"), F.lit(0.0)), F.lit(0.0)), digits)
    every = v.crossJoin(q).select("question", "id", score.alias("score"))
    return top_k(every, ["question"], [F.desc("score"), F.col("id")], k)


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; `order` must end in a unique column."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """question, id, score: sum of 1 / (k + rank) over the rankings (question, id, rank)."""
    every = rankings[0].select("question", "id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("question", "id", "rank"))
    return every.groupBy("question", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def mentions(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, entity, first (word place) of one-word surfaces (surface, entity) in docs (doc_id, text).

    Words are runs of letters and digits, lower-cased; surfaces of under three characters or of two entities are left
    out.
    """
    usable = lexicon.where(F.length("surface") >= 3).groupBy("surface").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n")).where("n = 1").drop("n")
    words = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("place", "surface")).where("surface <> ''")
    return words.join(usable, "surface").groupBy("doc_id", "entity").agg(F.min("place").alias("first"))


def cooccurrence(found: DataFrame, left: str, right: str, least: int = 2) -> DataFrame:
    """a, b, n: entities with the two prefixes in `least` documents or more (doc_id, entity)."""
    a = found.where(F.col("entity").startswith(left)).select("doc_id", F.col("entity").alias("a"))
    b = found.where(F.col("entity").startswith(right)).select("doc_id", F.col("entity").alias("b"))
    return a.join(b, "doc_id").groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= least)


def text_graph(cooccurring: DataFrame, triples: DataFrame) -> DataFrame:
    """a, b, relation, chunks, weight from (a, b, chunk) and (a, b, relation, chunk)."""
    every = cooccurring.select("a", "b", F.lit("co-mentioned").alias("relation"), "chunk").unionByName(triples.select("a", "b", "relation", "chunk"))
    return every.groupBy("a", "b", "relation").agg(F.array_sort(F.collect_set("chunk")).alias("chunks"), F.count_distinct("chunk").alias("weight"))


def neighbours(graph: DataFrame) -> DataFrame:
    """entity, other, relation, weight, place: heaviest first, co-mentions after other relations of a weight."""
    both = graph.select(F.col("a").alias("entity"), F.col("b").alias("other"), "a", "b", "relation", "weight").unionByName(graph.where("a <> b").select(F.col("b").alias("entity"), F.col("a").alias("other"), "a", "b", "relation", "weight"))
    by = Window.partitionBy("entity").orderBy(F.desc("weight"), F.col("relation") == "co-mentioned", "a", "b", "relation")
    return both.withColumn("place", F.row_number().over(by)).drop("a", "b")


def top_facts(risk: DataFrame, by: str, other: str, k: int = 3) -> DataFrame:
    """The k riskiest partners of each key, ties by name, with a sentence."""
    rows = top_k(risk.where("risk is not null"), [by], [F.desc("risk"), F.col(other)], k)
    return rows.withColumn("fact", F.format_string("%s with %s: %.3f", F.col("herb").cast("string"), F.col("drug").cast("string"), F.col("risk")))
