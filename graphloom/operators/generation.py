"""Answers and extractions by an injected client: prompts, calls that never fail a job, checks of what came back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.functions.text import INCREASE, REDUCE

from .hybrid import CO

#: The refusal and the note that go with answers.
NOT_ENOUGH = "The retrieved sources do not contain enough information to answer this question."
DISCLAIMER = "Research use only: this is not medical advice or a diagnosis; consult a qualified clinician."
RULES = ["Use the sources below and nothing else.", "Cite a source in square brackets after each claim, as [P1].", f"Without an answer in the sources say exactly: {NOT_ENOUGH}", "Use 120 words at most; no advice and no doses."]
STRICT = ["Co-mentioned means no more than in one passage; infer no effect from it.", "Report a [K] score as a research hypothesis; call no combination safe or unsafe."]
#: Formats of a template's numbers.
FILTERS = {"pct": "{:.0%}", "pct1": "{:.1%}", "f2": "{:.2f}", "f3": "{:.3f}", "int": "{:,}"}


def answer_prompts(questions: DataFrame, items: DataFrame, order: str = "PGK", strict: bool = True) -> DataFrame:
    """(question, text) and (question, item, kind, text) to (question, prompt); kinds in the given order, ids as they are."""
    line = F.struct(F.coalesce(F.nullif(F.instr(F.lit(order), F.col("kind")), F.lit(0)), F.lit(len(order) + 1)).alias("at"), F.substring("item", 2, 9).cast("int").alias("n"), F.concat(F.lit("["), "item", F.lit("] "), "text").alias("line"))
    sources = items.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("sources"))
    head = "\n".join(["Answer from numbered sources.", *("- " + r for r in RULES + (STRICT if strict else []))])
    prompt = F.concat(F.lit(head + "\n\nSOURCES:\n"), F.coalesce("sources", F.lit("(none)")), F.lit("\n\nQUESTION: "), "text", F.lit("\nANSWER:"))
    return questions.join(sources, "question", "left").select("question", prompt.alias("prompt"))


def extraction_prompts(chunks: DataFrame, focus: Column | None = None) -> DataFrame:
    """(id, text) to (chunk, prompt) that asks for triples as JSON; `focus`: an array of terms that matter, if any."""
    head = 'Give JSON only: {"triples": [{"subject": "", "relation": "", "object": ""}]}.\nSubjects and objects as the passage writes them. Relations: ' + ", ".join(REDUCE + INCREASE) + "."
    terms = F.lit("") if focus is None else F.when(F.size(focus) > 0, F.concat(F.lit("\nTerms of interest: "), F.array_join(focus, ", "))).otherwise("")
    return chunks.select(F.col("id").alias("chunk"), F.concat(F.lit(head), terms, F.lit("\n\nPASSAGE:\n"), "text").alias("prompt"))


def call_client(prompts: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """prompts with `raw` and `error`: an exception of the client is a value of its row and never ends the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            raw, error = [], []
            for p in df["prompt"]:
                try:
                    raw.append(str(client(p)).strip())
                    error.append("")
                except Exception as e:  # the contract: a failed call is logged and tried again later
                    raw.append("")
                    error.append(f"{type(e).__name__}: {e}")
            yield df.drop(columns="prompt").assign(raw=raw, error=error)

    kept = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes if n != "prompt")
    return prompts.mapInPandas(run, f"{kept}, raw string, error string")


def extract_pending(chunks: DataFrame, log: DataFrame, client: Callable[[str], str], most: int | None = None) -> DataFrame:
    """(chunk, raw, error) of chunks (id, text) without a success in log (chunk, error); `most` caps the calls of a run."""
    todo = chunks.join(log.where("error = ''").select(F.col("chunk").alias("id")).distinct(), "id", "left_anti")
    todo = todo if most is None else todo.orderBy("id").limit(most)
    return call_client(extraction_prompts(todo), client)


def checked_answers(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(question, raw, error) and (question, item, kind, text) to each answer's text and checks.

    valid, invalid: cited ids; validity null without citations.  n_sentences, n_uncited.  support: share of sentences
    with half their content words in the cited sources, or in all where none is cited; null if none counts or the
    answer refuses.  n_cocite, n_overclaim: sentences that cite co-mentions only, and those of them that claim a benefit.
    """
    source = F.struct("item", "kind", "text", text.content_words(F.col("text")).alias("words"))
    own = items.groupBy("question").agg(F.collect_list(source).alias("items"))
    empty = F.array().cast("array<struct<item:string,kind:string,text:string,words:array<string>>>")
    a = answers.join(own, "question", "left").withColumn("items", F.coalesce("items", empty)).withColumn("cited", text.citations(F.col("raw")))
    ids = F.transform("items", lambda i: i["item"])
    a = a.withColumn("valid", F.array_intersect("cited", ids)).withColumn("invalid", F.array_except("cited", ids)).withColumn("refused", F.contains("raw", F.lit(NOT_ENOUGH)))

    def part(s: Column) -> Column:
        cites, words = text.citations(s), text.content_words(s)
        chosen = F.filter("items", lambda i: F.array_contains(cites, i["item"]))
        used = F.when(F.size(chosen) > 0, chosen).otherwise(F.col("items"))
        share = F.size(F.array_intersect(words, F.flatten(F.transform(used, lambda i: i["words"])))) / F.nullif(F.size(words), F.lit(0))
        co = (F.size(chosen) > 0) & F.forall(chosen, lambda i: (i["kind"] == "G") & F.contains(i["text"], F.lit(CO)))
        return F.struct((F.size(cites) == 0).alias("bare"), share.alias("share"), co.alias("co"), (co & text.overclaims(s)).alias("over"))

    a = a.withColumn("parts", F.transform(text.sentences(F.col("raw")), part))
    n = lambda test: F.size(F.filter("parts", test))
    counted, good = n(lambda p: p["share"].isNotNull()), n(lambda p: p["share"] >= 0.5)
    shown = F.when(F.col("raw") == "", "(the model was unavailable)").otherwise(F.col("raw"))
    return a.select(
        "question", F.concat(shown, F.lit("\n\n" + DISCLAIMER)).alias("text"), "error", "refused", "valid", "invalid", (F.size("valid") / F.nullif(F.size("cited"), F.lit(0))).alias("validity"),
        F.size("parts").alias("n_sentences"), n(lambda p: p["bare"]).alias("n_uncited"), F.when(~F.col("refused"), good / F.nullif(counted, F.lit(0))).alias("support"),
        n(lambda p: p["co"]).alias("n_cocite"), n(lambda p: p["over"]).alias("n_overclaim"),
    )


def summarise_answers(checked: DataFrame, by: list[str]) -> DataFrame:
    """Means of the checks per group, nulls aside, and the over-reading share (null without co-mention sentences)."""
    return checked.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("validity").alias("validity"), F.avg("support").alias("support"), F.avg(F.col("refused").cast("double")).alias("refused"),
        F.sum("n_cocite").alias("n_cocite"), F.sum("n_overclaim").alias("n_overclaim"), (F.sum("n_overclaim") / F.nullif(F.sum("n_cocite"), F.lit(0))).alias("over_reading"),
    )


def without_caution(items: DataFrame) -> DataFrame:
    """Graph items as they read before the co-occurrence note, for the before and after comparison."""
    plain = F.regexp_replace("text", r" \(co-occurrence only[^)]*\)", "")
    return items.withColumn("text", F.when(F.col("kind") == "G", plain).otherwise(F.col("text")))


def render_template(template: str, facts: DataFrame) -> str:
    """Fill {{name}} and {{name|filter}} from facts (k, v), a short list; a name without a value or an unknown filter is an error."""
    slots = re.findall(r"\{\{\s*(\w+)(?:\|(\w+))?\s*\}\}", template)
    values = {r["k"]: r["v"] for r in facts.where(F.col("k").isin([n for n, _ in slots])).collect() if r["v"] is not None}
    lacking = sorted({n for n, _ in slots} - set(values))
    if lacking:
        raise KeyError(f"no value for {', '.join(lacking)}")
    if odd := sorted({f for _, f in slots if f} - set(FILTERS)):
        raise ValueError(f"unknown filter {', '.join(odd)}")
    show = lambda v, f: str(v) if not f else FILTERS[f].format(round(v) if f == "int" else v)
    return re.sub(r"\{\{\s*(\w+)(?:\|(\w+))?\s*\}\}", lambda m: show(values[m[1]], m[2]), template)
