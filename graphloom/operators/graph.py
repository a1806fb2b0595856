"""Assembly and validation of node and edge tables: grouped edges, entity resolution, aliases, lookups, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge type, source node type, target node type.
SCHEMA = [
    ("contains", "herb", "compound"), ("modulates", "compound", "target"), ("predicted_cyp_inhibitor", "compound", "target"), ("predicted_pgp_substrate", "compound", "target"),
    ("targets", "drug", "target"), ("substrate_of", "drug", "target"), ("non_substrate_of", "drug", "target"), ("ddi", "drug", "drug"),
]
#: Severity levels, mild to grave.
LEVELS = ["Unknown", "Minor", "Moderate", "Major"]
GENE_SYMBOL = r"\A[A-Z][A-Z0-9]*\d[A-Z0-9]*\z"


def joined(c: Column | str, sep: str = "; ") -> Column:
    """Distinct non-empty strings of a group, sorted, in one string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat_ws(sep, F.array_sort(F.collect_set(F.nullif(c, F.lit("")))))


def contains_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, part, reference) rows to edges with parts and number of references."""
    return rows.groupBy("src", "dst").agg(joined("part").alias("parts"), F.count_distinct("reference").alias("n_refs"))


def merge_edge_sources(*frames: DataFrame) -> DataFrame:
    """Edges of all frames (src, dst, source); an edge's sources in one string."""
    every = frames[0].select("src", "dst", "source")
    for f in frames[1:]:
        every = every.unionByName(f.select("src", "dst", "source"))
    return every.groupBy("src", "dst").agg(joined("source").alias("source"))


def worst_level_pairs(rows: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """(a, b, level) in any order to unordered pairs src < dst with the gravest known level."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("level"))
    return rows.where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max_by("level", rank).alias("level"))


def alias_map(names: DataFrame) -> DataFrame:
    """(id, name, aliases) to (alias, id) of upper-case aliases that belong to one id."""
    one = names.select("id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return one.select("id", F.upper(F.trim("alias")).alias("alias")).where("alias <> ''").groupBy("alias").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")


def resolve_first_match(rows: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows (key1, key2) get the id that `first` (key1, id) has, else that of `second` (key2, id); others are left out."""
    a, b = first.select("key1", F.col("id").alias("id1")), second.select("key2", F.col("id").alias("id2"))
    return rows.join(a, "key1", "left").join(b, "key2", "left").withColumn("id", F.coalesce("id1", "id2")).where("id is not null").drop("id1", "id2")


def drug_target_edges(rows: DataFrame) -> DataFrame:
    """(src, gene, source, kind, score text) to edges with sources, kinds and the best readable score."""
    score = F.expr("try_cast(score as double)")
    return rows.where(F.col("gene").rlike(GENE_SYMBOL)).groupBy("src", F.col("gene").alias("dst")).agg(joined("source").alias("sources"), joined("kind").alias("interaction_types"), F.max(F.when(~F.isnan(score), score)).alias("score"))


def chained_lookup(rows: DataFrame, parents: DataFrame, drugs: DataFrame, genes: list[str]) -> DataFrame:
    """(child, gene) by way of (child, parent) and (parent, id) to distinct (src, dst) of the given genes."""
    return rows.withColumn("dst", F.upper("gene")).where(F.col("dst").isin(genes)).join(parents, "child").join(drugs, "parent").select(F.col("id").alias("src"), "dst").distinct()


def resolve_entities(details: DataFrame) -> DataFrame:
    """(page, key, name, synonyms) to one row per key (the page where there is none), attributes of the first page."""
    key = F.coalesce(F.nullif("key", F.lit("")), F.col("page"))
    return details.groupBy(key.alias("key")).agg(F.min_by("name", "page").alias("name"), F.array_join(F.array_sort(F.collect_list("page")), ";").alias("pages"), F.count("*").alias("n_merged"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("synonyms")))), ";").alias("synonyms"))


def any_page_flag(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, pages array) with has_flag: some page is in `pages` (page)."""
    hit = entities.select("id", F.explode_outer("pages").alias("page")).join(pages.select("page", F.lit(True).alias("hit")).distinct(), "page", "left")
    return hit.groupBy("id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("has_flag"))


def check_nodes(nodes: DataFrame) -> DataFrame:
    """(type, id) to problems (problem, subject): an id twice in a type, or in two types."""
    twice = nodes.groupBy("type", "id").count().where("count > 1").select(F.lit("duplicate id").alias("problem"), F.concat_ws(":", "type", "id").alias("subject"))
    both = nodes.groupBy("id").agg(F.count_distinct("type").alias("n")).where("n > 1").select(F.lit("id in two types").alias("problem"), F.col("id").alias("subject"))
    return twice.unionByName(both)


def check_edges(nodes: DataFrame, edges: DataFrame, schema: list[tuple[str, str, str]] = SCHEMA) -> DataFrame:
    """(etype, src, dst) to problems: unknown edge type, endpoint without a node, endpoint of another type."""
    known = edges.sparkSession.createDataFrame(schema, "etype string, src_type string, dst_type string")
    types = nodes.select("id", F.col("type").alias("found")).distinct()
    named = F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string"))
    unknown = edges.join(F.broadcast(known), "etype", "left_anti").groupBy("etype").count().select(F.lit("unknown edge type").alias("problem"), F.col("etype").alias("subject"))
    typed = edges.join(F.broadcast(known), "etype")
    out = unknown
    for end in ("src", "dst"):
        side = typed.join(types.withColumnRenamed("id", end), end, "left")
        out = out.unionByName(side.where("found is null").select(F.lit(f"dangling {end}").alias("problem"), named.alias("subject")))
        out = out.unionByName(side.where(f"found <> {end}_type").select(F.lit(f"{end} type mismatch").alias("problem"), named.alias("subject")))
    return out


def missing_members(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of a scope (id) that no node has."""
    return wanted.select("id").join(nodes.select("id"), "id", "left_anti")


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node type: nodes, and nodes at no edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().withColumn("hit", F.lit(1))
    return nodes.join(ends, "id", "left").groupBy("type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("without_edge"))


#: Fixed values of gold rows.
MECHANISMS = ["PK", "PD", "none", "unclear"]
EVIDENCE = ["human_crossover_pk", "human_patient_pk", "case_report", "review"]
CONFIDENCE = ["high", "medium", "low"]


def gold_problems(gold: DataFrame, herbs: list[str], drugs: list[str]) -> DataFrame:
    """subject, problem of gold rows (text columns, label as a number)."""
    c = F.col
    text = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    blank = lambda x: F.trim(text(x)) == ""
    rules = {
        "unknown herb": ~text("herb").isin(herbs), "unknown drug": ~text("drug").isin(drugs), "label must be 0 or 1": ~F.coalesce(c("label").cast("int"), F.lit(-1)).isin(0, 1), "bad mechanism": ~text("mechanism").isin(MECHANISMS),
        "bad evidence": ~text("evidence").isin(EVIDENCE), "bad confidence": ~text("confidence").isin(CONFIDENCE), "pmid must be numeric": ~F.coalesce(c("pmid"), F.lit("")).rlike(r"\A\d+\z"),
        "missing verification": blank("verification"), "missing citation": blank("citation"),
        "label 0 requires mechanism none": (c("label") == 0) & (text("mechanism") != "none"), "label 1 cannot have mechanism none": (c("label") == 1) & (c("mechanism") == "none"),
    }
    return problems_of(gold, rules, ["herb", "drug", "pmid"])


def problems_of(rows: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """One row per broken rule (a true condition is a problem) and per key that occurs twice."""
    told = F.explode(F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in rules.items()]), lambda x: x.isNotNull()))
    subject = F.concat_ws("|", *key)
    twice = rows.groupBy(*key).count().where("count > 1").select(subject.alias("subject"), F.lit("duplicate").alias("problem"))
    return rows.select(subject.alias("subject"), told.alias("problem")).unionByName(twice)
