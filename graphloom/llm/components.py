"""Connected components: union-find inside partitions, large-star and small-star rounds between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialize, split_join


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the least of their component, and the least ones, for links a[i] - b[i]."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(a)
    for x, y in zip(both[:n].tolist(), both[n:].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], np.int64)
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def forest(links: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One batch (a, b) of a forest of many links; no more than it and some of the links is held."""
    held, n = [(np.zeros(0, np.int64),) * 2], 0
    for x in links:
        held.append(x)
        n += len(x[0])
        if n > max(1 << 16, 2 * len(held[0][0])):
            held, n = [union_find(*(np.concatenate(y) for y in zip(*held, strict=True)))], 0
    a, b = union_find(*(np.concatenate(y) for y in zip(*held, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield forest((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches)


def connected_components(edges: DataFrame, rounds: int = 60, forests: bool = False) -> DataFrame:
    """node, root (least node of its component) of every node of `edges` (a, b: long) that isn't a root itself.

    Self links and repeated links change nothing; no edges give no rows.  Each round works on joins and grouped
    minima alone, so a node with very many neighbours is no list in one task.  forests: each partition of edges is a
    forest already, which isn't made again.
    """
    links = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(links if forests else links.mapInArrow(lean(_forest), "a long, b long"), "forest")
    state, total = None, now.count()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("c"))
        large = split_join(both, least, ["a"], "c", 2 * total).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(small, "stars")
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        total = seen[0]
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
