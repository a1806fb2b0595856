"""Token counts of documents in flat, unindexed token files.

A file is token ids of two or four bytes with an end-of-document id after each document, and no index.  Blocks of a
file are searched for the end id at once as arrays; a document that spans blocks gets its length from the place of its
end and the last end in any earlier block, which a prefix maximum over the blocks carries across.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import lean, materialize, ship
from .textkit import column, slices

END = 50256
BLOCK = 1 << 18  # ids


def token_blocks(docs: DataFrame, tokenizer: str | None = None, end: int = END, block: int = BLOCK, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """Write docs as flat files, one per task, held as rows: shard, block, data (ids as little-endian 16 bits), ids.

    ids are the documents in the order of their ends within the block, kept beside the data to name the counts.
    """
    text = F.col(text) if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .bpe import BatchEncoder

        enc, shard, number = BatchEncoder(tokenizer), TaskContext.get().partitionId(), 0
        held, names = np.zeros(0, np.uint32), []

        def row(part: np.ndarray, own: list) -> pa.RecordBatch:
            wide = "<u2" if enc.enc.max_token_value < 1 << 16 and end < 1 << 16 else "<u4"
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number]), pa.array([part.astype(wide).tobytes()], pa.binary()), pa.array([own], pa.list_(pa.int64())), pa.array([np.dtype(wide).itemsize], pa.int32())], names=["shard", "block", "data", "ids", "width"])

        for batch, data, off in slices(batches, "text"):
            ids, _ = enc.encode(data, off, end)
            held, names = np.concatenate([held, ids]), names + column(batch, "doc_id").to_pylist()
            while len(held) >= block:
                n = int((held[:block] == end).sum())
                yield row(held[:block], names[:n])
                held, names, number = held[block:], names[n:], number + 1
        if len(held):
            yield row(held, names)

    return ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), "shard long, block long, data binary, ids array<long>, width int")


def file_blocks(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """The files of a path (a file, a folder or a pattern) as blocks: shard (the file's address), block, data, width.

    Each row is read on its own as a range of bytes, so a file may have any size.  Bytes after the last whole id are left
    out; a file without ids has no blocks.  Addresses must be of a kind that pyarrow reads.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x for y in fs.globStatus(p) or [] for x in (fs.listStatus(y.getPath()) if y.isDirectory() else [y])]
    files = [(x.getPath().toString(), x.getLen() // width) for x in found if x.isFile()]
    rows = spark.createDataFrame(files, "shard string, ids long").where("ids > 0")
    rows = rows.select("shard", "ids", F.explode(F.expr(f"sequence(0L, (ids - 1) div {block})")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for b in batches:
            for shard, ids, k in zip(*(column(b, c).to_pylist() for c in ("shard", "ids", "block")), strict=True):
                own, at = FileSystem.from_uri(shard)
                with own.open_input_file(at) as f:
                    data = f.read_at(min(block, ids - k * block) * width, k * block * width)
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([k]), pa.array([data], pa.binary()), pa.array([width], pa.int32())], names=["shard", "block", "data", "width"])

    return ship(rows).repartition(max(1, min(1 << 16, sum(n for _, n in files) // block)), "shard", "block").mapInArrow(lean(run), "shard string, block long, data binary, width int")


def separator_scan(blocks: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """shard, ordinal (of the document in its file, from 0), n_tokens (without the end id), open (no end id follows).

    blocks: shard, block, data, width; all of a shard's blocks but the last hold `block` ids.  Ids after the last end
    are an open document.  A file without ids has no documents; two ends in a row are an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (k, w, raw) in enumerate(zip(column(b, "block").to_pylist(), column(b, "width").to_pylist(), column(b, "data"), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), f"<u{w}")
                ends = np.flatnonzero(ids == end) + k * block
                yield pa.RecordBatch.from_arrays([column(b, "shard").slice(i, 1), pa.array([k]), pa.array([len(ids) + k * block]), pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["shard", "block", "stop", "ends"])

    kind = dict(blocks.dtypes)["shard"]
    found = materialize(ship(blocks).select("shard", "block", "data", "width").mapInArrow(lean(run), f"shard {kind}, block long, stop long, ends array<long>"), "ends")
    size = F.size("ends")
    summary = found.select("shard", "block", "stop", size.alias("n"), F.when(size > 0, F.element_at("ends", -1)).alias("last"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("before"))
    joined = found.join(carried, ["shard", "block"])
    inside = joined.select("shard", "first", "before", "ends", F.posexplode("ends").alias("i", "at"))
    closed = inside.select("shard", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("at") - F.when(F.col("i") == 0, F.col("before")).otherwise(F.element_at("ends", F.greatest("i", F.lit(1)))) - 1).alias("n_tokens"), F.lit(False).alias("open"))
    whole = summary.groupBy("shard").agg(F.sum("n").alias("ordinal"), F.max("stop").alias("stop"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    return closed.unionByName(whole.where("stop > last + 1").select("shard", "ordinal", (F.col("stop") - F.col("last") - 1).alias("n_tokens"), F.lit(True).alias("open")))


def document_token_counts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_tokens, shard, ordinal of each row of docs, by way of flat token files.

    A null or empty text has 0 tokens.  Repeated rows are counted each on its own; a null id stays null.  An empty table
    gives no rows; other columns are ignored.
    """
    blocks = materialize(token_blocks(docs, **how), "tokens")
    scan = {k: v for k, v in how.items() if k in ("end", "block")}
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = blocks.select("shard", "block", F.coalesce(F.sum(F.size("ids")).over(earlier), F.lit(0)).alias("first"), "ids")
    names = names.select("shard", "first", F.posexplode("ids").alias("i", "doc_id")).select("shard", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return names.join(separator_scan(blocks, **scan), ["shard", "ordinal"]).select("doc_id", "n_tokens", "shard", "ordinal")
