"""Formulation records, edges of compound pages and assay tables, and pair explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shuffles
from .labels import with_percentiles
from .retrieval import top_k


def herb_lookup(herbs: DataFrame) -> DataFrame:
    """(herb, aliases array) to (key, herb): names and aliases in small letters; a key of two herbs is the last one's."""
    names = herbs.select("herb", F.explode(F.concat(F.array("herb"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key"))
    return names.groupBy(F.lower("key").alias("key")).agg(F.max("herb").alias("herb"))


def formulation_records(ingredients: DataFrame, lookup: DataFrame) -> DataFrame:
    """(formulation, place, ingredient) to formulation, n_ingredients, in_scope (herbs in order, each as often as named), n_in_scope, optimisable.

    Ingredients are looked up in small letters; a formulation without ingredients has no row.  in_scope is one
    formulation's list, a handful of names.
    """
    found = ingredients.withColumn("key", F.lower("ingredient")).join(lookup, "key", "left").select("formulation", "place", "herb")
    found = found.repartition(shuffles.tasks(ingredients), "formulation")  # nothing to combine before; each task's lists stay few
    listed = F.array_sort(F.collect_list(F.when(F.col("herb").isNotNull(), F.struct("place", "herb"))))
    out = found.groupBy("formulation").agg(F.count("*").alias("n_ingredients"), F.transform(listed, lambda x: x["herb"]).alias("in_scope"))
    return out.withColumn("n_in_scope", F.size(F.array_distinct("in_scope"))).withColumn("optimisable", F.col("n_in_scope") >= 2)


def record_weights(records: DataFrame) -> DataFrame:
    """formulation, herb, w0: how often a herb is named over the number of all ingredients, those out of scope too."""
    each = records.select("formulation", "n_ingredients", F.explode("in_scope").alias("herb"))
    return each.groupBy("formulation", "herb", "n_ingredients").agg(F.count("*").alias("times")).select("formulation", "herb", (F.col("times") / F.col("n_ingredients")).alias("w0"))


def uses_of_herbs(rows: DataFrame) -> DataFrame:
    """(herb, use) to herb, uses: the distinct uses in order."""
    return rows.where(F.col("use").isNotNull()).groupBy("herb").agg(F.array_sort(F.collect_set("use")).alias("uses"))


def modulates_edges(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, gene, source) by way of (page, compound) to src, dst, sources: all distinct sources of a pair in one text."""
    rows = targets.join(pages, "page").select(F.col("compound").alias("src"), F.concat(F.lit("gene:"), "gene").alias("dst"), "source")
    return rows.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"))


#: The source and the assay names of page predictions.
ADME_SOURCE = "SwissADME (via IMPPAT)"
INHIBITOR = r"\A(CYP\w+) inhibitor\z"
PGP = "P-glycoprotein substrate"


def adme_edges(adme: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, key, value) to etype, src, dst, source: inhibited enzymes and transported compounds where the value is Yes."""
    rows = adme.where("value = 'Yes'").join(pages, "page").withColumn("enzyme", F.regexp_extract("key", INHIBITOR, 1))
    kind = F.when(F.col("enzyme") != "", "predicted_cyp_inhibitor").when(F.col("key") == PGP, "predicted_pgp_substrate")
    gene = F.concat(F.lit("gene:"), F.when(F.col("enzyme") != "", F.col("enzyme")).otherwise("ABCB1"))
    return rows.select(kind.alias("etype"), F.col("compound").alias("src"), gene.alias("dst"), F.lit(ADME_SOURCE).alias("source")).where("etype is not null").distinct()


def assay_edges(rows: DataFrame, names: DataFrame, source: str = "TDC Carbon-Mangels") -> DataFrame:
    """(gene, name, y) by way of (key, id) to etype, src, dst, source: substrate_of where y is 1, else non_substrate_of."""
    found = rows.withColumn("key", F.upper(F.trim(F.col("name").cast("string")))).join(names, "key")
    kind = F.when(F.col("y").cast("int") == 1, "substrate_of").otherwise("non_substrate_of")
    return found.select(kind.alias("etype"), F.col("id").alias("src"), F.concat(F.lit("gene:"), "gene").alias("dst"), F.lit(source).alias("source")).distinct()


def supplement_edges(rows: DataFrame, names: DataFrame, source: str = "curated literature") -> DataFrame:
    """(drug, enzyme) by way of (key, id) to src, dst, source; a drug that no key names is an error, never left out."""
    found = rows.withColumn("key", F.upper(F.trim("drug"))).join(names, "key", "left")
    unknown = F.raise_error(F.concat(F.lit("drug out of scope: "), F.coalesce("drug", F.lit("null"))))
    return found.select(F.when(F.col("id").isNull(), unknown).otherwise(F.col("id")).alias("src"), F.concat(F.lit("gene:"), F.upper(F.trim("enzyme"))).alias("dst"), F.lit(source).alias("source"))


def strided_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n of every (rows / n)-th row by key, from the first on; key is unique.

    Sampling is the feature.  Places come from counts of key ranges, so no task sorts all rows.
    """
    step = max(1, rows.count() // n)
    return numbered(rows, key, "__place").where((F.col("__place") % step == 0) & (F.col("__place") < n * step)).drop("__place")


def numbered(rows: DataFrame, key: str, out: str, ranges: int = 64) -> DataFrame:
    """rows with their place (from 0) by key; `ranges` key ranges are sorted each on its own and begin after those before them."""
    bounds = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10000).alias("b")).first()["b"] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    cut = rows.withColumn("__range", F.size(F.filter(edges, lambda b: b < F.col(key))))
    sizes = cut.groupBy("__range").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return cut.withColumn("__own", own).join(F.broadcast(sizes.select("__range", "before")), "__range").withColumn(out, F.col("__own") + F.col("before")).drop("__range", "__own", "before")


def pair_scores(risk: DataFrame) -> DataFrame:
    """(herb, drug, risk, ...) with percentile_for_drug and percentile_overall: shares of risks that aren't above."""
    return with_percentiles(with_percentiles(risk, "risk", at_most="percentile_for_drug", by=["drug"]), "risk", at_most="percentile_overall")


def explain_pairs(contains: DataFrame, predicted: DataFrame, labels: DataFrame, inhibits: DataFrame, substrate: DataFrame, top: int = 5) -> DataFrame:
    """Per herb and drug the `top` compounds by p (ties by compound), and for those labelled 1 a row per enzyme.

    contains: herb, compound; predicted: compound, drug, p; labels: compound, drug, label, enzymes ("a;b"); inhibits:
    compound, enzyme, source; substrate: drug, enzyme, source.  herb, drug, rank, compound, p, label, enzyme,
    inhibitor_source, substrate_source; a path without a known source has "n/a"; without a label 1 there is no path.
    A compound's scores cross the shuffle to its herbs as one list; rows are multiplied by the drugs only where they are ranked.
    """
    n = shuffles.tasks(contains, predicted)
    scores = predicted.select("compound", "drug", "p").repartition(n, "compound").groupBy("compound").agg(F.sort_array(F.collect_list(F.struct("p", "drug"))).alias("s"))
    scores = scores.select("compound", F.col("s.p").alias("p"), F.col("s.drug").alias("drug"))  # equal scores side by side take less room
    listed = contains.select("herb", "compound").repartition(n, "compound").distinct().join(scores, "compound").repartition(n, "herb")
    each = listed.select("herb", "compound", F.inline(F.arrays_zip("drug", "p")))
    best = top_k(each, ["herb", "drug"], [F.desc("p"), F.col("compound")], top)
    known = best.join(labels, ["compound", "drug"], "left")
    step = F.when(F.col("label") == 1, F.filter(F.split("enzymes", ";"), lambda e: e != ""))
    steps = known.withColumn("enzyme", F.explode_outer(step)).drop("enzymes")
    first = lambda df, side: df.groupBy(side, "enzyme").agg(F.min("source").alias(f"{'inhibitor' if side == 'compound' else 'substrate'}_source"))
    out = steps.join(first(inhibits, "compound"), ["compound", "enzyme"], "left").join(first(substrate, "drug"), ["drug", "enzyme"], "left")
    told = lambda c: F.when(F.col("enzyme").isNotNull(), F.coalesce(c, F.lit("n/a"))).alias(c)
    return out.select("herb", "drug", "rank", "compound", "p", "label", "enzyme", told("inhibitor_source"), told("substrate_source"))


def question_set(risk: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """Questions whose answers are in the risk table (herb, drug, risk): id, type, gold.

    top_drugs of each herb, top_herbs of each drug (names in one text, ties by name) and pair_score of the pairs that
    have a score.
    """
    def best(own: str, other: str, kind: str) -> DataFrame:
        ranked = top_k(risk, [own], [F.desc("risk"), F.col(other)], k)
        names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(other).cast("string").alias("name")))), lambda x: x["name"]), "; ")
        return ranked.groupBy(own).agg(names.alias("gold")).select(F.concat(F.lit(f"{kind}-"), F.col(own).cast("string")).alias("id"), F.lit(kind).alias("type"), "gold")

    asked = pairs.join(risk, ["herb", "drug"]).select(F.concat(F.lit("pair_score-"), F.col("place").cast("string")).alias("id"), F.lit("pair_score").alias("type"), F.col("risk").cast("string").alias("gold"))
    return best("herb", "drug", "top_drugs").unionByName(best("drug", "herb", "top_herbs")).unionByName(asked)


def text_statistics(rows: DataFrame, by: str) -> DataFrame:
    """(by, text) to by, texts, words (all), longest, median words of a text."""
    words = rows.withColumn("words", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")))
    return words.groupBy(by).agg(F.count("*").alias("texts"), F.sum("words").alias("words"), F.max("words").alias("longest"), F.median("words").alias("median"))
