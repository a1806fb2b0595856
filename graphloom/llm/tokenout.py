"""Packed token-id matrices: best-fit-decreasing with a segment tree over room left.

Each task packs what it reads, a few million ids at a time, so nothing is shuffled and no task holds more than that
(one document at least).  Lines therefore depend on how the input is split, and each such pack may end in a part-filled line.  A row is one line of the matrix: `size` ids (the rest is `pad`), cumulative segment lengths
and positions that start again at 0 in each segment.  Overlong documents are cut losslessly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import cut_points
from .shared import lean, ship
from .textkit import column, slices

SIZE, CHUNK = 2048, 4 << 20
SCHEMA = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class RoomTree:
    """Numbers 0..size in a segment tree of counts: the least number >= n that is present, in log2(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, n: int) -> int | None:
        i = n + self.leaves
        if self.count[i]:
            return n
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Lines of item numbers; each line's lengths add up to `size` at most."""
    tree, lines = RoomTree(size), []
    room: dict[int, list[int]] = {}
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        free = tree.least(n)
        if free is None:
            lines.append([])
            line, free = len(lines) - 1, size
        else:
            line = room[free].pop()
            tree.add(free, -1)
        lines[line].append(item)
        room.setdefault(free - n, []).append(line)
        tree.add(free - n, 1)
    return lines


def packed_matrices(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = 0, pad: int = 0, chunk: int = CHUNK, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """Lines of the matrix: sequence_id, n_tokens, doc_ids, pieces, starts, cu_seqlens, input_ids, position_ids.

    input_ids and position_ids are `size` little-endian unsigned 32-bit numbers; each document ends in `end`.  A null
    or empty text is its end alone.  Repeated rows are packed each on its own; a null id stays null.  An empty table
    gives no rows; other columns are ignored.
    """
    text = F.col(text) if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .bpe import BatchEncoder

        enc, number = BatchEncoder(tokenizer), TaskContext.get().partitionId() << 40
        steps = np.arange(size, dtype="<u4")
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            lines = best_fit_decreasing(np.array([len(x[3]) for x in held], np.int64), size)
            for first in range(0, len(lines), 256):
                some = lines[first : first + 256]
                ids, at = np.full((len(some), size), pad, "<u4"), np.zeros((len(some), size), "<u4")
                out: list[tuple] = []
                for j, line in enumerate(some):
                    own = [held[i] for i in line]
                    bounds = [0, *accumulate(len(x[3]) for x in own)]
                    for (_, _, _, x), a, b in zip(own, bounds[:-1], bounds[1:], strict=True):
                        ids[j, a:b] = x
                        at[j, a:b] = steps[: b - a]
                    out.append((number + j, bounds[-1], [x[0] for x in own], [x[1] for x in own], [x[2] for x in own], bounds))
                number += len(some)
                yield batch_of(out, ids, at)
            held.clear()

        for batch, data, off in slices(batches, "text"):
            ids, at = enc.encode(data, off, end)
            for doc, a, b in zip(column(batch, "doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                starts = cut_points(b - a, size)
                held += [(doc, k, x, ids[a + x : a + y]) for k, (x, y) in enumerate(zip(starts, [*starts[1:], b - a], strict=True))]
            total += len(ids)
            if total >= chunk:
                yield from flush()
                total = 0
        if held:
            yield from flush()

    return ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), SCHEMA)


TYPES = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
NAMES = ("sequence_id", "n_tokens", "doc_ids", "pieces", "starts", "cu_seqlens", "input_ids", "position_ids")


def batch_of(rows: list[tuple], *matrices: np.ndarray) -> pa.RecordBatch:
    """Columns of the rows, and each matrix as a column whose values are its lines' bytes."""
    offsets = [pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * m[0].nbytes) for m in matrices]
    lines = [pa.Array.from_buffers(pa.binary(), len(m), [None, o, pa.py_buffer(m)]) for m, o in zip(matrices, offsets, strict=True)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)), *lines], names=list(NAMES))


def write_matrices(packed: DataFrame, path: str) -> None:
    """The matrix as zstd Parquet, a line a row; any reader of Parquet gets the id matrix back."""
    packed.write.option("compression", "zstd").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """The lines with unsigned crc32 of ids and positions in place of their bytes."""
    return packed.select("sequence_id", "n_tokens", "doc_ids", "pieces", "starts", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


__all__ = ["best_fit_decreasing", "digests", "packed_matrices", "write_matrices"]
