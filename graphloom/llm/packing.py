"""Best-fit packing by patterns: as few sequences as possible of at most `size` tokens.

Only a histogram of piece lengths reaches the driver (at most `size` numbers).  Patterns of two lengths that fill a
sequence are enumerated on a grid of lengths, patterns of up to `depth` lengths that leave little room are generated from
the lengths that occur, non-negative least squares gives each pattern's repeats against the histogram, the repeats are
rounded down, and what is left goes by best fit into the room that is left or into new
sequences, whole runs of equal lengths at a time.  Rows then find their place from their number among the rows of
their length, which is counted in salted groups, so that one frequent length doesn't meet in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, materialize, parts, ship
from .textkit import column, slices

SIZE = 2048
FREE = 4.0  # weight of room left free against that of a length's count
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, size: int) -> list[int]:
    """Starts of a document's pieces: whole ones of `size`, after a first piece that may be shorter."""
    return [0, *range(n - size * ((n - 1) // size), n, size)] if n > size else [0]


def document_pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = 0, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (unsigned, over little-endian unsigned 32-bit ids) of each piece."""
    text = F.col(text) if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import BatchEncoder

        enc = BatchEncoder(tokenizer)
        for batch, data, off in slices(batches, "text"):
            ids, at = enc.encode(data, off, end)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            out: list[tuple] = []
            for doc, a, b in zip(column(batch, "doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                starts = cut_points(b - a, size)
                for k, (x, y) in enumerate(zip(starts, [*starts[1:], b - a], strict=True)):
                    out.append((doc, k, x, y - x, zlib.crc32(raw[4 * (a + x) : 4 * (a + y)])))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), PIECES)


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x that makes |a x - b| small: accelerated projected gradients."""
    x = y = np.zeros(a.shape[1])
    rate = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * (a.T @ (a @ y - b)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        step = (t - 1) / t2
        if (new - x) @ (y - new) > 0:
            step, t2 = 0.0, 1.0
        y, x, t = new + step * (new - x), new, t2
    return x


def patterns(grid: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to `depth` numbers of 1..grid that add up to grid."""
    out: list[tuple[int, ...]] = []

    def extend(prefix: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(prefix)
        elif len(prefix) < depth:
            for n in range(min(left, prefix[-1] if prefix else grid), 0, -1):
                if n * (depth - len(prefix)) < left:
                    break
                extend((*prefix, n), left - n)

    extend((), grid)
    return out


def _matrix(kinds: list[tuple[int, ...]], grid: int) -> np.ndarray:
    """How often a pattern has each length; row 0: FREE times the share of a sequence it leaves free, which is to be none."""
    a = np.zeros((grid + 1, len(kinds)))
    for j, kind in enumerate(kinds):
        for n in kind:
            a[n, j] += 1
        a[0, j] = FREE * (1 - sum(kind) / grid)
    return a


def generate_patterns(share: np.ndarray, depth: int, rounds: int = 8) -> list[tuple[int, ...]]:
    """Patterns of up to `depth` lengths against the share of each: for each length the one that lowers the error most, added in rounds."""
    grid = len(share) - 1
    own = np.flatnonzero(share)
    kinds = [k for k in patterns(grid, min(2, depth)) if all(share[n] for n in k)]
    seen = set(kinds)
    for _ in range(rounds):
        a = _matrix(kinds, grid)
        error = share - a @ nnls(a, share) if kinds else share
        best = np.full((depth, grid + 1), -np.inf)  # by most lengths and their sum
        best[0, 0] = 0
        last = np.zeros((depth, grid + 1), int)
        for k in range(1, depth):
            best[k] = best[k - 1]
            for n in own:
                more = best[k - 1, : grid + 1 - n] + error[n]
                better = more > best[k, n:]
                best[k, n:][better], last[k, n:][better] = more[better], n
        new = []
        for n in own:
            gain = error[n] + best[-1, : grid + 1 - n] + error[0] * FREE * np.arange(grid - n, -1, -1) / grid
            u, k, kind = int(gain.argmax()), depth - 1, [int(n)]
            if gain[u] <= 1e-9:
                continue
            while k:
                if last[k, u]:
                    kind.append(int(last[k, u]))
                    u -= last[k, u]
                k -= 1
            kind = tuple(sorted(kind, reverse=True))
            if kind not in seen:
                seen.add(kind)
                new.append(kind)
        if not new:
            break
        kinds += new
    return kinds


def plan_packs(histogram: dict[int, int], size: int = SIZE, grid: int = 512, depth: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Sequence contents (lengths in order) and how often each is used; every length is used as often as counted.

    Of the plans by patterns of up to two and of up to `depth` lengths, the one with fewer sequences.
    """
    share = np.zeros(grid + 1)
    for n, c in histogram.items():
        if n < size:
            share[int(np.ceil(n * grid / size))] += c
    share /= max(share.sum(), 1)
    plans = [_plan(histogram, size, grid, kinds) for kinds in (patterns(grid, min(2, depth)), generate_patterns(share, depth))]
    return min(plans, key=lambda packs: sum(c for _, c in packs))


def _plan(histogram: dict[int, int], size: int, grid: int, kinds: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    left = defaultdict(int, {n: c for n, c in histogram.items() if c})
    packs: list[tuple[list[int], int]] = []
    if left.get(size):
        packs.append(([size], left.pop(size)))
    unit = size / grid
    cells = [defaultdict(int) for _ in range(grid + 1)]
    for n, c in left.items():
        cells[int(np.ceil(n / unit))][n] += c
    counts = np.array([sum(c.values()) for c in cells], float)
    if counts.sum() > 0 and kinds:
        a = _matrix(kinds, grid)
        scale = counts.sum()
        repeats = np.floor(nnls(a, counts / scale) * scale).astype(int)
        for j in np.argsort(-repeats, kind="stable"):
            kind, times = kinds[j], int(repeats[j])
            need = np.bincount(kind, minlength=grid + 1)
            times = min([times, *(int(sum(cells[n].values()) // need[n]) for n in set(kind))])
            while times > 0:
                taken: list[int] = []
                run = times
                for n in set(kind):  # the longest lengths of each cell first; a run lasts while they do
                    longest = max(n2 for n2, c in cells[n].items() if c)
                    if cells[n][longest] < need[n]:
                        own = sorted((n2 for n2, c in cells[n].items() for _ in range(min(c, int(need[n])))), reverse=True)[: need[n]]
                        run = 1
                    else:
                        own, run = [longest] * int(need[n]), min(run, cells[n][longest] // int(need[n]))
                    taken += own
                for n2 in taken:
                    cells[int(np.ceil(n2 / unit))][n2] -= run
                    left[n2] -= run
                packs.append((sorted(taken, reverse=True), run))
                times -= run
    # what is left: best fit, longest first, a run of equal lengths at a time
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for taken, c in packs:
        room[size - sum(taken)].append((tuple(taken), c))
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            free = min((r for r, x in room.items() if x and r >= n), default=None)
            if free is None:
                per = size // n
                full, rest = divmod(c, per)
                if full:
                    room[size - n * per].append(((n,) * per, full))
                if rest:
                    room[size - n * rest].append(((n,) * rest, 1))
                c = 0
            else:
                taken, k = room[free].pop()
                used = min(k, c)
                if k > used:
                    room[free].append((taken, k - used))
                room[free - n].append(((*taken, n), used))
                c -= used
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for x in room.values():
        for taken, c in x:
            out[taken] += c
    return sorted(out.items())


def slots(packs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the rows of a length go: its rows number first, first+1, ... go to sequences seq, seq+1, ... at offset."""
    used: dict[int, int] = defaultdict(int)
    rows, seq = [], 0
    for taken, c in packs:
        at = 0
        for n in taken:
            rows.append((n, used[n], seq, at))
            used[n] += c
            at += n
        seq += c
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "seq", "offset"), cols, strict=True))


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = 0, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone.  Only documents of more than `size` ids are cut, losslessly.  Repeated
    rows are packed each on its own.  An empty table gives no rows; other columns are ignored.
    """
    pieces = materialize(document_pieces(docs, tokenizer, size, end, id_col, text), "pieces")
    salts = max(1, parts(docs))
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts))
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    table = slots(plan_packs(histogram, size))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long")).join(before, ["length", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 1 << 44  # rows of one length
        keys = table["length"] * shift + table["first"]
        for b in batches:
            if not b.num_rows:
                continue
            own = column(b, "number").to_numpy()
            k = np.searchsorted(keys, column(b, "length").to_numpy() * shift + own, "right") - 1
            seq = table["seq"][k] + own - table["first"][k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names), pa.array(seq), pa.array(table["offset"][k])], names=[*names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered.select(*columns, (F.col("number") - 1 + F.col("before")).alias("number")).mapInArrow(lean(place), PIECES + ", sequence_id long, offset long")
