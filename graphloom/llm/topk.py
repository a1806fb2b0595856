"""Exact top-k by integer inner product over a pivot-distance index.

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest distance.
Each vector is keyed by its nearest pivot and its distance from it; a pivot's vectors are cut into annuli of growing
distance.  A query first reads a block of the annuli nearest to it, which bounds its k-th distance, then exactly those
annuli that the triangle inequality can't rule out.  Pivots come from a bounded sample; every vector is in the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, materialize, ship
from .textkit import column

PIVOTS, RINGS, SAMPLE, BLOCK = 32, 8, 4096, 4096
LARGEST = 2.0**400  # integers beyond have no squares to reckon with
EXACT = 2.0**53


def integer_vectors(vectors: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as a matrix (shorter vectors end in zeros), and which rows take part."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    n = len(vectors)
    at = vectors.offsets.to_numpy()
    flat = vectors.values
    x = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    ok = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    row = np.repeat(np.arange(n), np.diff(at))
    own = x[at[0] : at[-1]]
    bad = ~(np.abs(own) < LARGEST)
    ok[row[bad]] = False
    out = np.zeros((n, dim))
    out[row, np.arange(len(own)) - np.repeat(at[:-1] - at[0], np.diff(at))] = np.floor(scale * np.where(bad, 0, own))
    return out, ok & (np.abs(out) < LARGEST).all(1)


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a = np.concatenate([v, extra[:, None]], 1)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * a @ pivots.T, 0))


def choose_pivots(sample: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Centres of a few rounds of k-means over the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(8):
        near = ((centres * centres).sum(1)[None, :] - 2 * sample @ centres.T).argmin(1)
        centres = np.stack([sample[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
    return centres


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= least)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))[:k]]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector: Column | str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best among all vectors but its own id.

    The score is the inner product of floor(scale * x); ties go to the smaller vec_id.  queries and vectors have the
    columns `id_col` and `vector`.  Rows with a null id, null vectors and vectors with null or non-finite components
    (or one beyond 2**400) take no part; shorter vectors count as ending in zeros.  Scores are exact; one beyond 64 bits
    counts as the largest or smallest long.  Repeated rows (one id, one vector) count once.  Empty
    tables give no rows; other columns are ignored.
    """
    vector = F.col(vector) if isinstance(vector, str) else vector
    columns = [F.col(id_col).cast("long").alias("vec_id"), vector.cast("array<double>").alias("v")]
    vectors = ship(vectors).select(*columns).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    queries = queries.select(*columns).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    dim = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(dim, queries.agg(F.max(F.size("v"))).first()[0] or 0, 1)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, ok = integer_vectors(column(b, "v"), dim, scale)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array([float((v[ok] ** 2).sum(1).max())])], names=["m"])

    largest = vectors.mapInArrow(lean(norms), "m double").agg(F.max("m")).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if largest is None:
        return vectors.sparkSession.createDataFrame([], schema)
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    sample, ok = integer_vectors(drawn.column("v").combine_chunks(), dim, scale)
    sample = sample[ok] if ok.any() else np.zeros((1, dim))
    pivots = choose_pivots(np.concatenate([sample, np.sqrt(np.maximum(largest - (sample**2).sum(1), 0))[:, None]], 1), PIVOTS)
    close = largest < EXACT  # else distances are too coarse to rule anything out, and scores are reckoned in Python's integers
    slack = 1e-6 * (1 + math.sqrt(largest))
    width = max(1e-9, 4 * math.sqrt(largest) / 1024)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, ok = integer_vectors(column(b, "v"), dim, scale)
            v, ids = v[ok], column(b, "vec_id").to_numpy()[ok]
            d = _distances(v, np.sqrt(np.maximum(largest - (v**2).sum(1), 0)), pivots)
            near = d.argmin(1) if len(d) else np.zeros(0, int)
            own = d[np.arange(len(d)), near]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.astype(np.int32)), pa.array((own / width).astype(np.int32)), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "pivot", "bin", "v"])

    index = materialize(vectors.mapInArrow(lean(key), "vec_id long, pivot int, bin int, v binary").dropDuplicates(["vec_id"]), "index")
    bins = sorted((r["pivot"], r["bin"], r["count"]) for r in index.groupBy("pivot", "bin").count().collect())  # PIVOTS * 1024 at most
    sizes = {p: sum(n for q, _, n in bins if q == p) for p in {b[0] for b in bins}}
    cells: list[list] = []  # pivot, first bin, last bin, vectors
    for p, b, n in bins:
        if not cells or cells[-1][0] != p or cells[-1][3] >= sizes[p] / RINGS:
            cells.append([p, b, b, 0])
        cells[-1][2], cells[-1][3] = b, cells[-1][3] + n
    cell_pivot, cell_first, cell_last, cell_n = np.array(cells, np.int64).T
    low, high = cell_first * width - slack, (cell_last + 1) * width + slack
    subs = np.maximum(1, -(-cell_n // BLOCK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = cell_pivot * (1 << 32) + cell_first
        for b in batches:
            cell = np.searchsorted(starts, column(b, "pivot").to_numpy().astype(np.int64) * (1 << 32) + column(b, "bin").to_numpy(), "right") - 1
            ids = column(b, "vec_id").to_numpy()
            sub = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % subs[cell]
            yield pa.RecordBatch.from_arrays([pa.array((cell << 32 | sub)), column(b, "vec_id"), column(b, "v")], names=["block", "vec_id", "v"])

    blocks = index.mapInArrow(lean(place), "block long, vec_id long, v binary")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, ok = integer_vectors(column(b, "v"), dim, scale)
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "vec_id").to_numpy()[ok]), pa.array([x.tobytes() for x in v[ok]], pa.binary())], names=["query_id", "q"])

    asked = materialize(queries.mapInArrow(lean(numbers), "query_id long, q binary").dropDuplicates(["query_id"]), "queries")
    groups = max(1, -(-asked.count() // BLOCK))

    def bounds(q: np.ndarray) -> np.ndarray:
        """Least distance that a vector of each cell can have from each query."""
        d = _distances(q, np.zeros(len(q)), pivots)[:, cell_pivot]
        return np.maximum(0, np.maximum(d - high, low - d))

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q = np.frombuffer(b"".join(column(b, "q").to_pylist()), np.float64).reshape(-1, dim)
                least = bounds(q)
                if first:
                    near = np.argsort(least, 1, kind="stable")[:, :3]
                    row, cell = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
                    sub = np.zeros(len(cell), np.int64)
                else:
                    reach = column(b, "kth").to_numpy(zero_copy_only=False).astype(float)
                    reach = np.where(np.isnan(reach), np.inf, np.sqrt(np.maximum((q * q).sum(1) + largest - 2 * np.nan_to_num(reach), 0)))
                    row, cell = np.nonzero((least <= reach[:, None] + slack) | (not close))
                    times = subs[cell]
                    sub = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                yield pa.RecordBatch.from_arrays([pa.array(cell << 32 | sub), column(b, "query_id").take(pa.array(row)), column(b, "q").take(pa.array(row))], names=["block", "query_id", "q"])

        return run

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            q = np.frombuffer(b"".join(left.column("q").to_pylist()), np.float64).reshape(-1, dim)
            v = np.frombuffer(b"".join(right.column("v").to_pylist()), np.float64).reshape(-1, dim)
            ids = right.column("vec_id").to_numpy()
            if not close:
                q, v = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(-1, dim) for m in (q, v))
            for i, query in enumerate(left.column("query_id").to_pylist()):
                other = np.flatnonzero(ids != query)
                score = v[other] @ q[i]
                if not close:
                    score = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score], dtype=object)
                top = best(score, ids[other], k) if close else sorted(range(len(other)), key=lambda j: (-score[j], ids[other[j]]))[:k]
                out += [(query, int(ids[other[j]]), int(score[j])) for j in top]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    def top(found: DataFrame) -> DataFrame:
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    def search(asks: DataFrame, first: bool) -> DataFrame:
        asks = asks.mapInArrow(lean(visits(first)), "block long, query_id long, q binary").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
        parts = blocks.join(materialize(asks.select("block", "part").distinct(), "pairs"), "block")  # a block goes to the groups of queries that ask for it
        return top(asks.groupBy("block", "part").cogroup(parts.groupBy("block", "part")).applyInArrow(compare, "query_id long, vec_id long, score long"))

    kth = search(asked, True).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    known = materialize(asked.join(kth, "query_id", "left"), "bounds")
    return search(known, False).select("query_id", "rank", "vec_id", "score")
