"""Exact dedup by a heavy-hitter split.

A mergeable Misra-Gries summary of each partition finds digests that may be frequent; their exact counts decide the
winners, which are broadcast (at most 2 * `counters` rows whatever the input) so that copies of a very frequent text
never meet in one task.  All other digests are grouped by an ordinary shuffle of 40-byte rows; texts are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, lean, materialize, ship, without


def misra_gries(counts: dict[bytes, int], digests: np.ndarray, counters: int) -> None:
    """Add digests to a summary in place.  A count is too low by at most rows / (counters + 1), and never too high."""
    values, n = np.unique(digests, return_counts=True)
    for v, c in zip(values.tolist(), n.tolist(), strict=True):
        counts[v] = counts.get(v, 0) + c
    if len(counts) > counters:
        cut = sorted(counts.values(), reverse=True)[counters]
        for v in [v for v, c in counts.items() if c <= cut]:
            del counts[v]
        for v in counts:
            counts[v] -= cut


def heavy_digests(digests: DataFrame, counters: int = 1024) -> DataFrame:
    """Digests that make up 2 / counters of all rows or more are among the result (digest, n, last), n and last exact.

    Args:
        digests: columns doc_id and digest (no nulls).
    Returns at most 2 * counters rows: with threshold t = 2 / counters, a digest is a candidate if its summed lower
    bound is at least (t - 1 / (counters + 1)) of all rows, and the lower bounds add up to no more than the rows.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            if b.num_rows:
                misra_gries(counts, b.column(0).to_numpy(zero_copy_only=False).astype("S64"), counters)
        yield pa.RecordBatch.from_pydict({"digest": [k.decode() for k in counts], "low": list(counts.values())}, pa.schema([("digest", pa.string()), ("low", pa.int64())]))

    total = digests.count()
    least = max(2, int(total * (2 / counters - 1 / (counters + 1))))
    candidates = digests.select("digest").mapInArrow(lean(summarise), "digest string, low long").groupBy("digest").agg(F.sum("low").alias("low")).where(F.col("low") >= least).select("digest")
    return digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are; a null text is the empty text.  The row with the largest id stays.  Repeated
    rows with one id and text are copies of each other and all carry kept = true, as the id is what is kept; a null
    id is smaller than any other and keeps only a group of null ids.  An empty table gives no rows; other columns of
    docs are ignored.
    """
    text = F.col(text) if isinstance(text, str) else text
    rows = materialize(ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("digest")), "digests")
    heavy = materialize(heavy_digests(rows, counters), "heavy").select("digest", F.col("n").alias("heavy_n"), F.col("last").alias("heavy_last"))
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    rest = marked.where(F.col("heavy_n").isNull()).select("doc_id", "digest")
    groups = rest.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    light = rest.join(groups, "digest")
    frequent = marked.where(F.col("heavy_n").isNotNull()).select("doc_id", "digest", F.col("heavy_n").alias("n"), F.col("heavy_last").alias("last"))
    return frequent.unionByName(light).select(
        "doc_id", F.col("last").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("last")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row of docs for each text, with docs' columns: of the rows with the largest id the first in no set order.

    Null texts are empty ones and so one group.  Rows of one id are judged each by its text.  An empty table gives no
    rows; columns of any name pass through.  Only rows that are there several times with one id and text are shuffled.
    """
    text = F.col(text) if isinstance(text, str) else text
    found = materialize(exact_duplicates(docs, id_col, text), "exact")
    digest = fresh("__digest", docs)
    own = docs.withColumn(digest, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    keys = (F.col(id_col).cast("long"), F.col(digest))
    gone = materialize(found.where("not kept").select("doc_id", "text_sha256").distinct(), "gone")
    again = materialize(found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256"), "again")
    kept = without(own, gone, *keys)
    if not again.isEmpty():
        kept = without(kept, again, *keys).unionByName(without(kept, again, *keys, how="left_semi").dropDuplicates([digest]))
    return kept.drop(digest)
