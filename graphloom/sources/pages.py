"""Landed HTML pages to rows: visible text, tables with their headers, and the records of each page layout."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column names and labels that pages carry.
INGREDIENT, PART, NAME, IDENTIFIER, USE = "Ingredient name", "Plant part", "Formulation name", "Formulation identifier", "Therapeutic use"
PARSED = "id {kind}, text string, tables array<struct<kind:string,head:array<string>,body:array<array<string>>>>"
SILENT = {"script", "style", "template"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.words: list[str] = []
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.cell: list[str] | None = None
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "table":
            self.open.append({"kind": dict(attrs).get("class") or "", "head": [], "body": []})
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1]["body"].append([])
            self.cell = None
        elif tag in ("td", "th") and self.open:
            table, self.cell = self.open[-1], []
            if tag == "td" and not table["body"]:
                table["body"].append([])
            (table["head"] if tag == "th" else table["body"][-1]).append(self.cell)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.open:
            self.open.pop()
            self.cell = None
        elif tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.silent or not data.strip():
            return
        self.words.append(data)
        if self.cell is not None:
            self.cell.append(data)

    def result(self) -> tuple[str, list[dict]]:
        flat = lambda parts: re.sub(r"\s+", " ", " ".join(parts)).strip()
        tables = [{"kind": t["kind"], "head": [flat(c) for c in t["head"]], "body": [[flat(c) for c in row] for row in t["body"] if row]} for t in self.tables]
        return flat(self.words), tables


def parse_pages(pages: DataFrame) -> DataFrame:
    """(id, html) to (id, text, tables); null and broken pages give what could be read of them."""
    kind = dict(pages.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for html in df["html"]:
                page = _Page()
                page.feed(html or "")
                page.close()
                out.append(page.result())
            yield pd.DataFrame({"id": df["id"], "text": [t for t, _ in out], "tables": [t for _, t in out]})

    return pages.select("id", "html").mapInPandas(run, PARSED.format(kind=kind))


def after(text: Column, label: str, stops: list[str]) -> Column:
    """What follows a label up to the next of the stops or the end, without blanks around it; empty without the label."""
    quoted = lambda s: "\\Q" + s + "\\E"
    return F.trim(F.regexp_extract(text, "(?s)" + quoted(label) + r"\s*(.*?)\s*(?:" + "|".join(map(quoted, stops)) + "|\\z)", 1))


def detail_records(pages: DataFrame) -> DataFrame:
    """One record a page (P2): identifiers, name, synonyms and structure fields; missing ones are empty."""
    t, p = F.col("text"), parse_pages(pages).select("id", "text")
    ext = after(t, "External chemical identifiers:", ["Chemical structure information"])
    names = F.split(after(t, "Synonymous chemical names:", ["External chemical identifiers:"]), ",")
    return p.select(
        "id", after(t, "IMPPAT Phytochemical identifier:", ["Phytochemical name:"]).alias("phy_id"),
        after(t, "Phytochemical name:", ["Synonymous chemical names:", "External chemical identifiers:"]).alias("name"),
        F.filter(F.transform(names, lambda s: F.trim(s)), lambda s: s != "").alias("synonyms"), F.regexp_extract(ext, r"CID:CID_(\d+)", 1).alias("cid"),
        F.regexp_extract(ext, r"ChEMBL[:_]\s*(?:CID_)?([A-Za-z0-9_]+)", 1).alias("chembl_id"), after(t, "SMILES:", ["InChI:"]).alias("smiles"),
        after(t, "InChI:", ["InChIKey:"]).alias("inchi"), after(t, "InChIKey:", ["DeepSMILES:"]).alias("inchikey"),
    )


def _cells(pages: DataFrame) -> DataFrame:
    return parse_pages(pages).select("id", F.explode("tables").alias("t")).select("id", F.explode("t.body").alias("c"))


def target_rows(pages: DataFrame) -> DataFrame:
    """(id, gene, ensembl, entrez, source) of rows of five cells whose first is a target id (P3)."""
    c = F.col("c")
    return _cells(pages).where((F.size(c) == 5) & c[0].startswith("TAR_")).select("id", c[2].alias("gene"), c[1].alias("ensembl"), c[3].alias("entrez"), c[4].alias("source"))


def adme_rows(pages: DataFrame) -> DataFrame:
    """(id, property, value) of rows of three cells that end in inhibitor or substrate (P3); the last of a property stays."""
    c = F.col("c")
    rows = parse_pages(pages).select("id", F.posexplode("tables").alias("i", "t")).select("id", "i", F.posexplode("t.body").alias("j", "c"))
    rows = rows.where((F.size(c) == 3) & c[0].rlike(r"(inhibitor|substrate)\z"))
    return rows.groupBy("id", c[0].alias("property")).agg(F.max_by(c[2], F.struct("i", "j")).alias("value"))


def formulation_records(pages: DataFrame) -> DataFrame:
    """(id, formulation, name, dosage, ingredients) from the first table with name and ingredient columns (P4).

    Columns are found by their headers.  The identifier of the text goes before that of a cell.
    """
    text = F.col("text")
    fits = lambda t: F.array_contains(t["head"], NAME) & F.array_contains(t["head"], INGREDIENT)
    rows = parse_pages(pages).withColumn("t", F.get(F.filter("tables", fits), F.lit(0)))
    column = lambda label: F.nullif(F.array_position("t.head", label), F.lit(0))
    cell = lambda row, label: F.coalesce(F.get(row, column(label).cast("int") - 1), F.lit(""))
    body = F.coalesce(F.filter("t.body", lambda r: cell(r, INGREDIENT) != ""), F.array().cast("array<array<string>>"))
    first = lambda label: F.coalesce(F.get(F.filter(F.transform(body, lambda r: cell(r, label)), lambda x: x != ""), F.lit(0)), F.lit(""))
    own, title = F.regexp_extract(text, IDENTIFIER + r":\s*([A-Z]+\d+)", 1), F.regexp_extract(text, "Ingredients of (.*?) " + NAME, 1)
    dose = F.regexp_extract(text, r"Dosage \(according to [^)]*\):\s*(.*?)(?:\s+Ingredients of|\s+Ayurvedic principles|\z)", 1)
    made = F.transform(body, lambda r: F.struct(cell(r, INGREDIENT).alias("ingredient"), cell(r, PART).alias("part")))
    return rows.select("id", F.when(own != "", own).otherwise(first(IDENTIFIER)).alias("formulation"), F.when(title != "", F.trim(title)).otherwise(first(NAME)).alias("name"), F.substring(F.trim(dose), 1, 200).alias("dosage"), made.alias("ingredients"))


def therapeutic_uses(pages: DataFrame) -> DataFrame:
    """(id, uses): distinct sorted uses of all tables with such a column; none gives an empty array (P5)."""
    place = lambda t: F.array_position(F.transform(t["head"], lambda h: F.contains(h, F.lit(USE))), True)
    used = F.transform("tables", lambda t: F.when(place(t) > 0, F.transform(t["body"], lambda r: F.get(r, place(t).cast("int") - 1))).otherwise(F.array().cast("array<string>")))
    return parse_pages(pages).select("id", F.array_sort(F.array_distinct(F.filter(F.flatten(used), lambda x: x.isNotNull() & (x != "")))).alias("uses"))


def formulation_links(pages: DataFrame) -> DataFrame:
    """Distinct (kind, name) of links to formulation pages, percent signs decoded (P6)."""
    hit = F.explode(F.regexp_extract_all("html", F.lit(r"/imppat/((?:afi|api)formulationdetails/[^\"']+)"), F.lit(1))).alias("link")
    rows = pages.select(hit).select(F.substring("link", 1, 3).alias("kind"), F.substring_index("link", "formulationdetails/", -1).alias("name"))
    plain = F.try_url_decode(F.replace("name", F.lit("+"), F.lit("%2B")))
    for mark, sign in (("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(mark), F.lit(sign))
    return rows.select("kind", F.coalesce(plain, "name").alias("name")).distinct()


def molecule_ids(searches: DataFrame) -> DataFrame:
    """(name, json of a search page) to (name, id): parents first, then the latest phase, then the greatest id (P7)."""
    schema = "molecules array<struct<molecule_chembl_id:string,pref_name:string,max_phase:double,molecule_hierarchy:struct<parent_chembl_id:string>,molecule_synonyms:array<struct<molecule_synonym:string>>>>"
    rows = searches.select("name", F.explode(F.from_json("json", schema)["molecules"]).alias("m"))
    known = F.concat(F.array(F.coalesce("m.pref_name", F.lit(""))), F.coalesce(F.col("m.molecule_synonyms.molecule_synonym"), F.array().cast("array<string>")))
    hit = F.exists(known, lambda n: F.lower(n) == F.lower(F.trim("name")))
    parent = F.nullif("m.molecule_hierarchy.parent_chembl_id", F.lit(""))
    best = F.struct(F.coalesce(parent == F.col("m.molecule_chembl_id"), F.lit(False)).alias("own"), F.coalesce("m.max_phase", F.lit(0.0)).alias("phase"), F.coalesce(parent, "m.molecule_chembl_id").alias("id"))
    return rows.where(hit).groupBy("name").agg(F.max(best).alias("best")).select("name", "best.id")
