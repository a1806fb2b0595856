"""Sources and sinks: graph tables, delimited and JSON files, landed pages, manifests, append logs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Delimited text with a header, "NULL" as null; the file's name without ending is in `file`."""
    return spark.read.csv(path, sep=sep, header=True, nullValue="NULL", schema=schema).withColumn("file", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1))


def read_pages(spark: SparkSession, path: str, rows: str, schema: str) -> DataFrame:
    """Landed JSON pages; the array `rows` as rows of `schema`."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{rows}"), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The named tables below path; without names all that are called nodes_* or edges_*, in order."""
    if names is None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        names = sorted(n for n in (f.getPath().getName() for f in found) if n.startswith(("nodes_", "edges_")))
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def read_gold(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Curated rows of a file with a header, all as text (ids of papers too); an empty cell is ''."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns)).na.fill("")


#: Fixed format: names of prediction files.
PREDICTIONS = r"\A(cold_compound|cold_herb|cold_drug|random_pair)_([a-z_]+)_s(\d+)_f(\d+)\.parquet\z"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of prediction files with split, model, seed and fold from the file's name; another name is an error."""
    name = F.col("_metadata.file_name")
    part = lambda i: F.regexp_extract(name, PREDICTIONS, i)
    split = F.when(name.rlike(PREDICTIONS), part(1)).otherwise(F.raise_error(F.concat(F.lit("not a prediction file: "), name)))
    return spark.read.parquet(path).select("*", split.alias("split"), part(2).alias("model"), part(3).cast("int").alias("seed"), part(4).cast("int").alias("fold"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, size, sha256 of each file under path."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files (file, sha256) that are missing or differ."""
    return expected.join(found.select("file", F.col("sha256").alias("now")), "file", "left").where("now is null or now <> sha256").select("file")


def last_write_wins(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The latest row of each key in an append log."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("__n = 1").drop("__n")


def pending_keys(wanted: DataFrame, log: DataFrame, key: str, failed: str) -> DataFrame:
    """Keys without a success in the log: new ones and those whose rows all failed."""
    return wanted.select(key).distinct().join(log.where(~F.col(failed)).select(key).distinct(), key, "left_anti")


class _Tables(HTMLParser):
    """Cells of each row of each table, with the table's class."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[str, list[str]]] = []
        self.kind, self.cells, self.inside = "", None, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.kind = dict(attrs).get("class") or ""
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
            self.inside = True

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.inside = False
        elif tag == "tr" and self.cells is not None:
            self.rows.append((self.kind, [re.sub(r"\s+", " ", c).strip() for c in self.cells]))
            self.cells = None

    def handle_data(self, data):
        if self.inside and self.cells:
            self.cells[-1] += data


def table_rows(pages: DataFrame) -> DataFrame:
    """(id, html) to (id, kind, row, cells): every table row of a page; pages that can't be parsed have none."""
    kind = dict(pages.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for i, html in zip(df["id"], df["html"], strict=True):
                p = _Tables()
                p.feed(html or "")
                out += [(i, k, n, c) for n, (k, c) in enumerate(p.rows)]
            yield pd.DataFrame(out, columns=["id", "kind", "row", "cells"])

    return pages.select("id", "html").mapInPandas(run, f"id {kind}, kind string, row int, cells array<string>")


def plant_rows(pages: DataFrame) -> DataFrame:
    """Rows of tables of class phytochem with five cells whose third starts with IMPPAT."""
    c = F.col("cells")
    return table_rows(pages).where((F.col("kind") == "phytochem") & (F.size("cells") >= 5) & F.get("cells", F.lit(2)).startswith("IMPPAT")).select("id", c[0].alias("plant"), c[1].alias("part"), c[2].alias("phy_id"), c[3].alias("phy_name"), c[4].alias("reference"))


def page_links(pages: DataFrame) -> DataFrame:
    """(id, html) to distinct (id, link)."""
    return pages.select("id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("link")).distinct()
