"""Questions to citable items: phrase links, query expansion, graph and score facts, fused passages, question sets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import cosine_top_k, reciprocal_rank_fusion, top_k

CO = "co-mentioned"
MOST_SURFACES = 2**18  # surfaces of a lexicon that are broadcast


def _base_characters() -> tuple[str, str]:
    pairs = {}
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(n))[:1].lower()
        if base.isascii() and base:
            pairs[chr(n)] = base
    return "".join(pairs), "".join(pairs.values())


MARKED, PLAIN = _base_characters()


def folded(text: Column) -> Column:
    """Lower case without marks; runs of other characters than letters and digits are one blank; a blank at both ends."""
    flat = F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), MARKED, PLAIN)), "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(flat), F.lit(" "))


def usable_surfaces(lexicon: DataFrame) -> DataFrame:
    """(surface, entity) folded; surfaces of under three characters or of two entities are left out."""
    rows = lexicon.select(F.trim(folded(F.col("surface"))).alias("surface"), "entity").where(F.length("surface") >= 3)
    return rows.groupBy("surface").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n")).where("n = 1").drop("n")


def linked_phrases(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, entity, place, words): left to right, the longest phrase first, without overlaps.

    Runs of as many words as the surfaces have, one row each and no row with more of its text, meet the lexicon in a join.
    Up to MOST_SURFACES surfaces are broadcast, so runs that no surface has never reach a shuffle; beyond, neither side
    needs to fit in a task.  A fold over the hits of one text drops those that start within a longer or earlier one.
    """
    counts = usable_surfaces(lexicon).groupBy(F.size(F.split("surface", " ")).alias("words")).count().collect()  # numbers of words, not surfaces
    sizes = [r["words"] for r in counts]
    surfaces = usable_surfaces(lexicon)
    if sum(r["count"] for r in counts) <= MOST_SURFACES:
        surfaces = F.broadcast(surfaces)
    words = F.filter(F.split(folded(F.col("text")), " "), lambda w: w != "")
    run = lambda i, n: F.struct(n.alias("words"), F.array_join(F.slice("w", i + 1, n), " ").alias("surface"))
    runs = F.transform("w", lambda x, i: F.transform(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.size("w") - i), lambda n: run(i, n)))
    at = docs.select("doc_id", words.alias("w")).select("doc_id", F.posexplode(runs).alias("place", "runs"))
    hits = at.select("doc_id", "place", F.inline("runs")).join(surfaces, "surface")
    best = hits.groupBy("doc_id", "place").agg(F.max_by(F.struct("words", "entity"), "words").alias("hit"))
    row = F.struct("place", F.col("hit.words").alias("words"), F.col("hit.entity").alias("entity"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<place:int,words:int,entity:string>>").alias("kept"))
    step = lambda s, x: F.when(x["place"] < s["free"], s).otherwise(F.struct((x["place"] + x["words"]).alias("free"), F.array_append(s["kept"], x).alias("kept")))
    kept = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("hits")).select("doc_id", F.aggregate("hits", start, step)["kept"].alias("kept"))
    return kept.select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.entity", "k.place", "k.words")


def first_mentions(linked: DataFrame) -> DataFrame:
    """(question, entity, place) of each entity's first link."""
    return linked.groupBy(F.col("doc_id").alias("question"), "entity").agg(F.min("place").alias("place"))


def expand_queries(questions: DataFrame, found: DataFrame, lexicon: DataFrame, prefix: str = "herb:", most: int = 4) -> DataFrame:
    """(question, text) with other surfaces of linked entities behind the text: fewest words first, `most` an entity.

    Surfaces that the text has already are not among them; entities come in order of their first mention.
    """
    named = found.where(F.col("entity").startswith(prefix)).join(questions, "question").join(usable_surfaces(lexicon), "entity")
    new = named.where(~F.contains(folded(F.col("text")), F.col("surface"))).withColumn("n", F.size(F.split("surface", " ")))
    new = top_k(new, ["question", "entity"], [F.col("n"), F.col("surface")], most)
    extra = new.groupBy("question").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "rank", "surface"))), lambda x: x["surface"])), " ").alias("extra"))
    return questions.join(extra, "question", "left").select("question", F.concat_ws(" ", "text", "extra").alias("text"))


def hashed_embedding(texts: DataFrame, key: str, size: int = 64) -> DataFrame:
    """(key, text) to (key, v): counts of hashed words, an encoder that needs no model.

    Words are hashed once each and counted on the map side.  Any other function of this form can take its place.
    """
    words = F.explode_outer(F.filter(F.split(folded(F.col("text")), " "), lambda w: w != ""))
    slot = (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % size).cast("int")
    slots = texts.select(key, words.alias("w")).select(key, slot.alias("slot"))
    return slots.groupBy(key).agg(F.array(*[F.count_if(F.col("slot") == i).cast("double") for i in range(size)]).alias("v"))


def graph_items(found: DataFrame, graph: DataFrame, most: int = 4) -> DataFrame:
    """(question, rank, a, b, relation, weight, chunks, fact) of the heaviest edges at a question's entities.

    Each edge counts once a question; co-mentions come after stated relations of a weight; ties go by names.
    """
    ends = graph.withColumn("entity", F.explode(F.array_distinct(F.array("a", "b"))))
    rows = found.select("question", "entity").join(ends, "entity").drop("entity").dropDuplicates(["question", "a", "b", "relation"])
    rows = top_k(rows, ["question"], [F.desc("weight"), F.col("relation") == CO, F.col("a"), F.col("b"), F.col("relation")], most)
    name = lambda c: F.substring_index(c, ":", -1)
    co = F.format_string("%s is co-mentioned with %s in %d passage(s) (co-occurrence only; neither is said to affect the other).", name("a"), name("b"), F.col("weight"))
    told = F.format_string("%s %s %s (stated in %d passage(s)).", name("a"), F.col("relation"), name("b"), F.col("weight"))
    return rows.withColumn("fact", F.when(F.col("relation") == CO, co).otherwise(told))


def provenance_ranking(items: DataFrame) -> DataFrame:
    """(question, id, rank): passages of the graph items in order, each at its first place."""
    every = items.select("question", F.col("rank").alias("item"), F.posexplode("chunks").alias("place", "id"))
    first = every.groupBy("question", "id").agg(F.min(F.struct("item", "place")).alias("at"))
    return top_k(first, ["question"], [F.col("at"), F.col("id")], 2**31 - 1).select("question", "id", "rank")


def score_facts(found: DataFrame, risk: DataFrame, k: int = 3, most: int = 4) -> DataFrame:
    """(question, rank, fact) from (herb, drug, risk, n_compounds).

    With herbs and drugs in a question: its pairs, riskiest first.  With one side only: the k riskiest partners of
    each, in order of mention.
    """
    side = lambda p: found.where(F.col("entity").startswith(p + ":")).select("question", "place", F.substring_index("entity", ":", -1).alias(p))
    herbs, drugs = side("herb"), side("drug")
    told = risk.where("risk is not null")
    pairs = herbs.drop("place").join(drugs.drop("place"), "question").join(told, ["herb", "drug"])
    fact = F.format_string("%s with %s: predicted probability %.2f (%d compounds). Research score, not advice.", "herb", "drug", "risk", "n_compounds")
    out = pairs.select("question", F.lit(0).alias("place"), (-F.col("risk")).alias("o"), F.concat_ws("|", "herb", "drug").alias("name"), fact.alias("fact"))
    for own, other, asked, lacking in (("herb", "drug", herbs, drugs), ("drug", "herb", drugs, herbs)):
        alone = asked.join(lacking.select("question").distinct(), "question", "left_anti")
        top = top_k(told, [own], [F.desc("risk"), F.col(other)], k)
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", other, "risk"))), lambda x: F.format_string("%s %.2f", x[other], x["risk"])), "; ")
        lists = top.groupBy(own).agg(parts.alias("list"))
        row = alone.join(lists, own).select("question", "place", F.lit(0.0).alias("o"), F.col(own).alias("name"), F.format_string("Highest scores of %s: %s. Research score, not advice.", own, "list").alias("fact"))
        out = out.unionByName(row)
    return top_k(out, ["question"], [F.col("place"), F.col("o"), F.col("name")], most).select("question", "rank", "fact")


def passages(dense: DataFrame, provenance: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(question, id, rank, score): the k best of the fused rankings, ties by id."""
    fused = reciprocal_rank_fusion([dense] if provenance is None else [dense, provenance])
    return top_k(fused, ["question"], [F.desc(F.round("score", 12)), F.col("id")], k)


def hybrid_retrieve(
    questions: DataFrame, chunks: DataFrame, lexicon: DataFrame, graph: DataFrame, risk: DataFrame, embed: Callable[[DataFrame, str], DataFrame] = hashed_embedding,
    alias: bool = True, use_graph: bool = True, facts: bool = True, k_dense: int = 20, k: int = 5, most_graph: int = 4, most_facts: int = 3,
) -> DataFrame:
    """(question, item, kind, chunk, text) of a batch of questions; each switch turns a part on.

    questions: question, text.  chunks: id, text.  graph: a, b, relation, chunks, weight.
    """
    found = first_mentions(linked_phrases(questions.withColumnRenamed("question", "doc_id"), lexicon))
    asked = expand_queries(questions, found, lexicon) if alias else questions
    dense = cosine_top_k(embed(asked, "question").withColumnRenamed("v", "q"), embed(chunks, "id"), k_dense)
    items = graph_items(found, graph, most_graph) if use_graph else None
    best = passages(dense, provenance_ranking(items) if use_graph else None, k)
    row = lambda kind, chunk, text: ["question", F.concat(F.lit(kind), F.col("rank").cast("string")).alias("item"), F.lit(kind).alias("kind"), chunk.alias("chunk"), F.col(text).alias("text")]
    none = F.lit(None).cast(dict(chunks.dtypes)["id"])
    out = best.join(chunks, "id").select(*row("P", F.col("id"), "text"))
    if use_graph:
        out = out.unionByName(items.select(*row("G", none, "fact")))
    if facts:
        out = out.unionByName(score_facts(found, risk).where(F.col("rank") <= most_facts).select(*row("K", none, "fact")))
    return out


def gap_questions(triples: DataFrame, chunks: DataFrame, names: DataFrame, relation: str, most: int = 60) -> DataFrame:
    """(place, s, o, question, n, gold) on accepted triples (chunk, s, r, o) whose passage names the herb in neither way.

    names: s, common, latin.  Pairs with most passages first; ties by name.
    """
    rows = triples.where((F.col("r") == relation) & F.col("o").startswith("condition:")).join(names, "s").join(chunks.select(F.col("id").alias("chunk"), "text"), "chunk")
    text = folded(F.col("text"))
    rows = rows.where(~F.contains(text, folded(F.col("common"))) & ~F.contains(F.lower("text"), F.lower("latin")))
    pairs = rows.groupBy("s", "o", "common").agg(F.array_sort(F.collect_set("chunk")).alias("gold")).withColumn("n", F.size("gold"))
    first = pairs.orderBy(F.desc("n"), "s", "o").limit(most).withColumn("all", F.lit(1))
    said = F.concat(F.lit("What does the text say about "), F.lower("common"), F.lit(" for "), F.substring_index("o", ":", -1), F.lit("?"))
    return top_k(first, ["all"], [F.desc("n"), F.col("s"), F.col("o")], most).select(F.col("rank").alias("place"), "s", "o", said.alias("question"), "n", "gold")


def name_recall(answer: Column, gold: Column) -> Column:
    """Share of the gold names that the answer has as whole words, brackets aside; null without names."""
    said = F.lower(F.regexp_replace(answer, r"\[[^\]]*\]", " "))
    hit = lambda g: F.regexp_like(said, F.concat(F.lit(r"(?<![a-z])\Q"), F.lower(g), F.lit(r"\E(?![a-z])")))
    return F.size(F.filter(gold, hit)) / F.nullif(F.size(gold), F.lit(0))


def number_hit(answer: Column, gold: Column, tolerance: float = 0.03) -> Column:
    """A decimal number of the answer, brackets aside, is within the tolerance of gold."""
    said = F.regexp_extract_all(F.regexp_replace(answer, r"\[[^\]]*\]", " "), F.lit(r"\d*\.\d+"), F.lit(0))
    return F.exists(said, lambda x: F.abs(x.cast("double") - gold) <= tolerance)


def parsed_question(raw: Column, least_words: int = 6) -> Column:
    """The question of a JSON answer; null if there is none or it has too few words."""
    q = F.trim(F.get_json_object(raw, "$.question"))
    return F.when(F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) >= least_words, q)


def too_verbatim(question: Column, passage: Column, n: int = 6) -> Column:
    """Some n words of the question in a row are in the passage's text of words."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))
    q, p = words(question), F.array_join(words(passage), " ")
    starts = F.when(F.size(q) >= n, F.sequence(F.lit(1), F.size(q) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.contains(p, F.array_join(F.slice(q, i, n), " ")))


def answer_grid(questions: DataFrame, systems: DataFrame, done: DataFrame) -> DataFrame:
    """Each question for each system (a short list), without what `done` (question, system) has."""
    return questions.crossJoin(systems).join(done.select("question", "system").distinct(), ["question", "system"], "left_anti")
