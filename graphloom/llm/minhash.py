"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

SuperMinHash walks, for each element, a random permutation of the signature's places and puts rank + uniform value
there; the minimum at each place is kept.  The walk of all elements of a document goes rank by rank at once and ends
as soon as every place has a value below the next rank, which can't improve any more.  So long documents need a step
or two, and no result differs from the full walk.

Documents with one and the same shingle set are one class, and only classes are linked.  Classes that share a band are
compared on full sets, a bucket at a time, large buckets in blocks of so many sets and shingles.  In a task a set that is
already linked to another is not compared again with what it has led to, and a forest of links is returned, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shared import lean, materialize, parts, ship, split_join, without
from .textkit import U64, column, mix, signed, slices, span_hashes, word_spans

BANDS, ROWS = 20, 4  # a pair of similarity 0.85 shares no band in 4 of 10**7 cases, of 0.8 in 3 of 10**5
BLOCK = 1024  # members of a block of a bucket; a task compares two blocks
WEIGHT = 1 << 19  # shingles of a block, one member at least
_rng = np.random.Generator(np.random.PCG64(5551212))
_ORDER = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, one after another, and n+1 offsets.

    A text with fewer words is one shingle; a text without words has none.
    """
    s, e, at = word_spans(data, off)
    h = span_hashes(data, s, e)
    n = np.diff(at)
    sets: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(h) - k + 1), U64)
        for i in range(k):
            grams += h[i : i + len(grams)] * _ORDER[i]
        grams = mix(grams)
        for a, words in zip(at[:-1].tolist(), n.tolist(), strict=True):
            if words >= k:
                sets.append(np.unique(grams[a : a + words - k + 1]))
            elif words:
                sets.append(mix((h[a : a + words] * _ORDER[:words]).sum(keepdims=True, dtype=U64) + U64(words)))
            else:
                sets.append(h[:0])
    out = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=out[1:])
    return np.concatenate(sets) if sets else h[:0], out


def superminhash(h: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows x m, uint64: rank << 48 | value) of sets of hashes; a set without elements has the largest values."""
    rows = len(off) - 1
    sig = np.full(rows * m, np.iinfo(U64).max, U64)
    row = np.repeat(np.arange(rows), np.diff(off))
    perm = None
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(h):
                break
            x = mix(h + U64(2 * j + 1) * U64(0x9E3779B97F4A7C15))
            y = mix(x + U64(0xD1B54A32D192ED03)) >> U64(32)
            k = (j + ((y * U64(m - j)) >> U64(32))).astype(np.int64)
            if j:
                if perm is None:
                    perm = np.tile(np.arange(m, dtype=np.int16), (len(h), 1))
                    own = np.arange(len(h))
                    perm[own, 0], perm[own, first] = first, 0
                own = np.arange(len(h))
                place = perm[own, k].astype(np.int64)
                perm[own, k] = perm[:, j]
                perm[own, j] = place
            else:
                place = first = k
            np.minimum.at(sig, row * m + place, (U64(j) << U64(48)) | (x >> U64(16)))
            open_ = (sig.reshape(rows, m) >= (U64(j + 1) << U64(48))).any(axis=1)[row]
            if not open_.all():
                h, row = h[open_], row[open_]
                first = first[open_]
                perm = perm[open_] if perm is not None else None
    return sig.reshape(rows, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, m = sig.shape
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(m // rows, dtype=U64), (n, 1))
        for i in range(rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, i::rows][:, : m // rows])
    return key


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in slices(batches, "text"):
            h, at = shingle_sets(data, off, k)
            n = np.diff(at)
            keys = signed(band_keys(superminhash(h, at, bands * rows), rows))
            with np.errstate(over="ignore"):
                d = [np.concatenate([[U64(0)], np.cumsum(mix(h ^ c), dtype=U64)]) for c in _ORDER[-2:]]
                d1, d2 = (signed(x[at[1:]] - x[at[:-1]]) for x in d)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(keys[n > 0].ravel()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n), pa.array(d1), pa.array(d2), lists], names=["doc_id", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _linked(sets: list[np.ndarray], ids: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of all links (100 * intersection >= percent * union) within a few sets.

    From each set the search goes on to the sets that it is linked with and that nothing has led to yet.  Only sets not
    reached so far, of a size that can be linked, are looked at, by counting the shingles that carry a mark.
    """
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size, ids = size[order], ids[order]
    codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1].astype(np.int32)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    pool, pool_codes, pool_at = np.arange(len(size)), codes, at  # the sets not reached when it was last made
    left = np.ones(len(size), bool)
    a, b = [], []
    for start in range(len(size)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            x = todo.pop()
            if 2 * left.sum() < len(pool):
                pool = pool[left[pool]]
                pool_codes = np.concatenate([codes[at[i] : at[i + 1]] for i in pool]) if len(pool) else codes[:0]
                pool_at = np.concatenate([[0], np.cumsum(size[pool])])
            own = size[pool]
            lo, hi = np.searchsorted(100 * own, percent * size[x]), np.searchsorted(percent * own, 100 * size[x], "right")
            if lo >= hi or not left[pool[lo:hi]].any():
                continue
            mark[codes[at[x] : at[x + 1]]] = True
            both = np.add.reduceat(mark[pool_codes[pool_at[lo] : pool_at[hi]]], pool_at[lo:hi] - pool_at[lo], dtype=np.int64)
            mark[codes[at[x] : at[x + 1]]] = False
            found = pool[lo:hi][(100 * both >= percent * (size[x] + own[lo:hi] - both)) & left[pool[lo:hi]]]
            left[found] = False
            todo += found.tolist()
            a.append(np.full(len(found), ids[x]))
            b.append(ids[found])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, weight: int = WEIGHT, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * intersection >= percent * union of their sets of k-word shingles (A-Z as a-z, words
    between ASCII white space).  component_id is the smallest id reachable over links; kept: it is the row's own.
    A null text is empty; a text without words is linked with nothing and kept.  Repeated rows (one id, one text)
    come out repeated; an id with several texts has the links of all of them.  A null id is in its text's component,
    and has none if no other row has that text's shingles.  An empty table gives no rows; other columns are ignored.
    """
    text = F.col(text) if isinstance(text, str) else text
    docs = ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    sketch = materialize(sketches(docs, k, bands, rows), "sketches")
    total = sketch.count()
    some = sketch.where("n > 0")
    grouped = some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialize(grouped, "classes")
    banded = classes.where("rep is not null").select("rep", "d1", "n", F.explode("bands").alias("key"))
    one = F.xxhash64("rep", "d1")
    buckets = banded.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.bit_xor(one).alias("x"), F.bit_xor(F.xxhash64("rep", "d1", F.lit(1))).alias("y")).where("c > 1")
    buckets = buckets.groupBy("c", "w", "x", "y").agg(F.min("key").alias("key")).select("key", "c", "w")  # the same members in several bands: one bucket
    in_bucket = materialize(split_join(banded.select("rep", "d1", "key"), buckets, ["key"], "c", total), "buckets")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in slices(batches, "text"):
            h, at = shingle_sets(data, off, k)
            with np.errstate(over="ignore"):
                d = np.concatenate([[U64(0)], np.cumsum(mix(h ^ _ORDER[-2]), dtype=U64)])
                d1 = signed(d[at[1:]] - d[at[:-1]])
            raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 8), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(d1), raw.cast(pa.binary())], names=["rep", "d1", "set"])

    wanted = materialize(in_bucket.select("rep").distinct(), "wanted")
    sets = without(docs, wanted, F.col("doc_id"), how="left_semi").mapInArrow(lean(full), "rep long, d1 long, set binary").dropDuplicates(["rep", "d1"])
    blocks = F.ceil(F.greatest(F.col("c") / block, F.col("w") / weight)).cast("int")
    own = F.pmod(F.xxhash64("rep", "d1", "key"), blocks).cast("int")
    tasks = in_bucket.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tasks = tasks.select("rep", "d1", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        task, ids, held = None, [], []
        for batch in batches:
            for t, rep, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if t != task:
                    if len(ids) > 1:
                        yield _linked(held, np.array(ids, np.int64), percent)
                    task, ids, held = t, [], []
                ids.append(rep)
                held.append(np.frombuffer(raw.as_buffer(), U64))
        if len(ids) > 1:
            yield _linked(held, np.array(ids, np.int64), percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield forest(found(batches))

    links = tasks.join(sets, ["rep", "d1"]).select("task", "rep", "set").repartition(parts(docs) * 2, "task").sortWithinPartitions("task").mapInArrow(lean(compare), "a long, b long")
    roots = connected_components(links, forests=True)
    rooted = classes.select("d1", "d2", "n", "copies", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("d1", "d2", "n", "copies", F.coalesce("root", "rep").alias("component_id"))
    full_rows = split_join(some.select("doc_id", "d1", "d2", "n"), materialize(rooted, "rooted"), ["d1", "d2", "n"], "copies", total).select("doc_id", "n", "component_id")
    empty = sketch.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full_rows.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that stay, with docs' columns: one document of each group.

    Rows are known by their id, of which all rows stay or go.  A null text, one without words and a row with a null id
    stay.  An empty table gives no rows; columns of any name pass through.
    """
    near = near_duplicates(docs, id_col=id_col, **how)
    return without(docs, materialize(near.where("not kept and doc_id is not null").select("doc_id").distinct(), "gone"), F.col(id_col).cast("long"))


__all__ = ["drop_near_duplicates", "near_duplicates", "shingle_sets", "superminhash"]
