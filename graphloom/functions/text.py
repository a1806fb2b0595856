"""Text rules: line and paragraph filters, chunks, citations, sentence support, grounded triples."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verbs of a relation that lowers or raises something.
REDUCE = ["treats", "cures", "relieves", "allays", "alleviates", "removes", "destroys", "checks", "heals", "pacifies", "subdues", "soothes", "reduces"]
INCREASE = ["aggravates", "increases", "excites", "provokes", "vitiates", "exacerbates"]
#: Words that claim a benefit, and words that deny one.
CLAIM = r"(?i)\b(balanc\w*|treat\w*|cure\w*|heal\w*|relie\w*|pacif\w*|role in|benefici\w*|therap\w*|remed\w*|used (?:for|to|in))\b"
NEG = r"(?i)\b(not|no|never|neither|nor|without|cannot)\b|n't"
#: Characters of a token of clean text.
TOKEN = r"[A-Za-z0-9.,;:()'\-—\"’“”\[\]?!]+"


def fold_text(s: str) -> str:
    """Base characters, lower case, hyphen and underscore as blanks; the length stays."""
    out = []
    for ch in s:
        base = unicodedata.normalize("NFKD", ch)[:1].lower() or ch
        out.append(" " if base in "-_" else base if len(base) == 1 else ch)
    return "".join(out)


def bad_token(t: Column) -> Column:
    """Characters that clean text has not, a capital after a small letter, or three characters and more without a vowel."""
    return ~t.rlike(f"\\A{TOKEN}\\z") | t.rlike("[a-z][A-Z]") | ((F.length(t) >= 3) & ~t.rlike("[aeiouyAEIOUY]"))


def garbage_line(line: Column, share: float = 0.3) -> Column:
    """At least `share` of the words are bad; a blank line is none."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & (F.size(F.filter(words, bad_token)) >= share * F.size(words))


def kept_lines(text: Column) -> Column:
    """Lines with single blanks, without page numbers, short headers in capitals and garbage; blank ones stay."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    header = lambda x: x.rlike(r"\A[A-Z][A-Z\s.\-]*\z") & (F.size(F.split(x, " ")) <= 4)
    return F.filter(lines, lambda x: (x == "") | ~(x.rlike(r"\A\d{1,4}\z") | header(x) | garbage_line(x)))


def clean_text(text: Column) -> Column:
    """kept_lines in one text; a line that ends in one hyphen after a letter or in the OCR sign takes up the next one if that is in small letters."""
    return F.regexp_replace(F.array_join(kept_lines(text), "\n"), r"(?:[¬\-]*¬-?|(?<=[A-Za-z])-)\n(?=\p{Ll})", "")


def paragraphs(text: Column, least_words: int = 5) -> Column:
    """Paragraphs between blank lines that have enough words."""
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: F.size(F.filter(F.split(F.trim(p), r"\s+"), lambda w: w != "")) >= least_words)


def merged_paragraphs(text: Column, least_words: int = 5, short_words: int = 12) -> Column:
    """Paragraphs on one line each; short ones in a row are one, so that notes of a few words stay; then the rule above."""
    words = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    lines = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != "")
    last = lambda done: F.coalesce(F.get(done, F.size(done) - 1), F.lit(""))
    joins = lambda done, p: (F.size(done) > 0) & (words(p) < short_words) & (words(last(done)) < short_words)
    grow = lambda done, p: F.when(joins(done, p), F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.concat(last(done), F.lit(" "), p))).otherwise(F.array_append(done, p))
    return F.filter(F.aggregate(lines, F.array().cast("array<string>"), grow), lambda p: words(p) >= least_words)


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def pack_paragraphs(paras: list[str], target: int = 170, most: int = 260, overlap: int = 40) -> list[str]:
    """Chunks of whole paragraphs: a chunk ends at `target` words or before it would pass `most`.

    Its last paragraph opens the next chunk too if it has `overlap` words at most.  A paragraph of more than `most`
    words makes chunks of its own.  What is left at the end is a chunk unless all of it was in the one before.
    """
    out: list[str] = []
    held: list[str] = []
    new = False  # held has a paragraph that is in no chunk yet
    size = lambda ps: sum(len(p.split()) for p in ps)

    def end(carry: bool) -> None:
        nonlocal held, new
        if held:
            out.append("\n".join(held))
            held = held[-1:] if carry and overlap and size(held[-1:]) <= overlap else []
        new = False

    for p in paras:
        words = p.split()
        if len(words) > most:
            end(False)
            out += [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
            continue
        if held and size(held) + len(words) > most:
            end(True)
        held, new = [*held, p], True
        if size(held) >= target:
            end(True)
    if new:
        end(False)
    return out


def chunk_documents(docs: DataFrame, target: int = 170, most: int = 260, overlap: int = 40, least: int = 15) -> DataFrame:
    """(key, text) to (id, key, text, n_words): numbered chunks of a document; a fold over each text on its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for key, text in zip(df["key"], df["text"], strict=True):
                kept = [c for c in pack_paragraphs(re.split(r"\n\s*\n", text or ""), target, most, overlap) if len(c.split()) >= least]
                rows += [(f"{key}-{i:05d}", str(key), c, len(c.split())) for i, c in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["id", "key", "text", "n_words"])

    return docs.select("key", "text").mapInPandas(run, "id string, key string, text string, n_words int")


def citations(text: Column) -> Column:
    """Distinct ids of [P1], [G1, P2] and ranges [G1-G4] or [G1-4], in order; a reversed range is its start.

    A bracket with anything else, such as a semicolon, cites nothing.
    """
    groups = F.regexp_extract_all(text, F.lit(r"\[([A-Z]\d+(?:\s*[-,]\s*[A-Z]?\d+)*)\]"), F.lit(1))
    items = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x))
    span = r"\A([A-Z])(\d+)\s*-\s*[A-Z]?(\d+)\z"

    def expand(x: Column) -> Column:
        kind, a, b = (F.regexp_extract(x, span, i) for i in (1, 2, 3))
        first, last = a.try_cast("long"), b.try_cast("long")
        numbers = F.sequence(first, F.greatest(first, last))
        return F.when(x.rlike(span), F.transform(numbers, lambda n: F.concat(kind, n.cast("string")))).otherwise(F.array(x))

    return F.array_distinct(F.flatten(F.transform(items, expand)))


#: Words without content.
STOP = (
    "this that with from have been were will would could should their there which these those into than then them they also such "
    "when where what while about after before because between both each other some only over very more most like used uses using"
).split()


def content_words(text: Column, stop: list[str] = STOP) -> Column:
    """Distinct runs of four letters and more outside brackets, without stop words and plural endings."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"\[[^\]]*\]", " ")), F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(stop)), lambda w: F.regexp_replace(w, "s+$", "")))


def support(sentence: Column, sources: Column) -> Column:
    """Share of a sentence's content words that the sources have; null without content words."""
    own = content_words(sentence)
    return F.size(F.array_intersect(own, content_words(sources))) / F.nullif(F.size(own), F.lit(0))


def overclaims(sentence: Column) -> Column:
    """The sentence outside brackets claims a benefit and doesn't deny it."""
    body = F.regexp_replace(sentence, r"\[[^\]]*\]", " ")
    return body.rlike(CLAIM) & ~body.rlike(NEG)


def make_chunks(docs: DataFrame, **how) -> DataFrame:
    """Raw texts (key, text) to chunks: cleaned lines, merged paragraphs, then chunk_documents."""
    ready = F.array_join(merged_paragraphs(clean_text(F.col("text"))), "\n\n")
    return chunk_documents(docs.select("key", ready.alias("text")), **how)
