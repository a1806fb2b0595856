"""Triples that a model read from passages, held against the passage and the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import INCREASE, REDUCE

from .hybrid import MARKED, PLAIN, linked_phrases

#: Kinds of entities that a triple may start from and lead to.
SUBJECTS = r"\A(herb|drug):"
OBJECTS = r"\A(condition|dosha):"


def plain(text: Column) -> Column:
    """Lower case without marks, hyphens and underscores as blanks, single blanks."""
    flat = F.translate(F.lower(F.translate(F.coalesce(text, F.lit("")), MARKED, PLAIN)), "-_", "  ")
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def phrase_in(phrase: Column, text: Column) -> Column:
    """The phrase is in the text, not inside a word; an empty one never is."""
    own = plain(phrase)
    pattern = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(own, F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E(?![a-z0-9])"))
    return (own != "") & F.rlike(plain(text), pattern)


def first_entity(names: DataFrame, lexicon: DataFrame, kind: str, out: str) -> DataFrame:
    """(name, out): the entity of a kind that is mentioned first in a name."""
    named = names.distinct().withColumnRenamed("name", "text").withColumn("doc_id", F.col("text"))
    found = linked_phrases(named, lexicon).where(F.col("entity").rlike(kind))
    return found.groupBy(F.col("doc_id").alias("name")).agg(F.min_by("entity", "place").alias(out))


def ground_triples(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(chunk, passage, raw JSON) to (chunk, s, r, o, subject, relation_raw, object, reason); reason is null for an accepted triple.

    A triple has three strings, a known verb, both names in the passage, a herb or drug as subject and a condition or
    dosha as object.  The relation is aggravates, or treats for a condition and pacifies for a dosha.  Of accepted triples
    of a chunk that say the same, the first stays.
    """
    every = rows.withColumn("v", F.try_parse_json("raw"))
    listed = every.withColumn("items", F.try_variant_get("v", "$.triples", "array<variant>"))
    broken = listed.where("items is null").select("chunk", F.when(F.col("v").isNull(), "malformed output").otherwise("no triples list").alias("reason"))
    part = lambda c: F.trim(F.expr(f"case when schema_of_variant(variant_get(item, '$.{c}', 'variant')) = 'STRING' then variant_get(item, '$.{c}', 'string') end"))
    flat = listed.where("items is not null").select("chunk", "passage", F.posexplode("items").alias("place", "item"))
    flat = flat.select("chunk", "passage", "place", part("subject").alias("subject"), F.lower(part("relation")).alias("relation_raw"), part("object").alias("object"))
    for c, kind, out in (("subject", SUBJECTS, "s"), ("object", OBJECTS, "o")):
        names = first_entity(flat.where(F.col(c).isNotNull()).select(F.col(c).alias("name")), lexicon, kind, out)
        flat = flat.join(names.withColumnRenamed("name", c), c, "left")
    reason = (
        F.when(F.col("subject").isNull() | F.col("relation_raw").isNull() | F.col("object").isNull(), "malformed triple").when(~F.col("relation_raw").isin(REDUCE + INCREASE), "relation not allowed")
        .when(~phrase_in(F.col("subject"), F.col("passage")), "subject not in passage").when(~phrase_in(F.col("object"), F.col("passage")), "object not in passage")
        .when(F.col("s").isNull(), "subject not a known entity").when(F.col("o").isNull(), "object not a known entity")
    )
    verb = F.when(F.col("relation_raw").isin(INCREASE), "aggravates").when(F.col("o").startswith("condition:"), "treats").otherwise("pacifies")
    told = flat.withColumn("reason", reason).withColumn("r", F.when(F.col("reason").isNull(), verb))
    said = F.row_number().over(Window.partitionBy("chunk", "s", "r", "o", "reason").orderBy("place"))
    told = told.withColumn("n", said).where("n = 1 or reason is not null")
    only = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    none = [F.lit(None).cast("string").alias(c) for c in ("s", "r", "o", "subject", "relation_raw", "object")]
    return told.select("chunk", only("s"), only("r"), only("o"), "subject", "relation_raw", "object", "reason").unionByName(broken.select("chunk", *none, "reason"))
