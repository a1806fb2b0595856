"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their first bytes (stems of inflected insults), hashed to 2**22 buckets.  From a bounded
sample of labelled rows the buckets that tell the classes apart, alone or where another one occurs, are learned, each at
three levels of its count in a text.  The machine learns a weight for each and a vector for pairwise interactions, which raise a term that is harmless
alone and lower one that other terms explain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialize, ship
from .textkit import PUNCT, column, rows_of, slices, span_hashes, word_spans

BITS = 22
PREFIXES = (4, 5, 6, 8)  # bytes
LEVELS = (1, 2, 4)  # a term counts once from each of these numbers of occurrences
SAMPLE = 4000  # labelled rows of a class that are learned from, at most


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted buckets
    bias: float
    weight: np.ndarray  # terms x levels
    factor: np.ndarray  # terms x levels x k

    def scores(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities, from (row, place in terms, count) triples without repeats."""
        logit = np.full(rows, self.bias)
        s = np.zeros((rows, self.factor.shape[2]))
        q = np.zeros(rows)
        for j, least in enumerate(LEVELS):
            on = count >= least
            r, t = row[on], term[on]
            v = self.factor[t, j]
            np.add.at(logit, r, self.weight[t, j])
            np.add.at(s, r, v)
            np.add.at(q, r, (v * v).sum(1))
        return 1 / (1 + np.exp(-np.clip(logit + 0.5 * ((s * s).sum(1) - q), -30, 30)))


def term_counts(data: np.ndarray, off: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of each text's terms, without repeats; `only`: flags of the buckets that are wanted."""
    s, e, at = word_spans(data, off, PUNCT)
    row = rows_of(at)
    found_row, found = [], []
    for n in (0, *PREFIXES):
        long = e - s > n if n else np.ones(len(s), bool)
        a = s[long]
        bucket = (span_hashes(data, a, a + n if n else e) >> np.uint64(64 - BITS)).astype(np.int64)
        r = row[long]
        if only is not None:
            wanted = only[bucket]
            bucket, r = bucket[wanted], r[wanted]
        found_row.append(r)
        found.append(bucket)
    key = (np.concatenate(found_row) << BITS) | np.concatenate(found)
    key, count = np.unique(key, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def _sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[dict], dict[int, int]]:
    """Terms of at most `most` labelled rows of each class, and how many rows each class has."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
    docs = ship(docs).select("doc_id", "text")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen.groupBy("doc_id").agg(F.max("y").alias("y")), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in slices(batches, "text"):
            row, bucket, count = term_counts(data, off)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            raw = lambda x, t, w: pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * w), pa.py_buffer(np.ascontiguousarray(x.astype(t)))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), raw(bucket, "<i4", 4), raw(np.minimum(count, 255), "u1", 1)], names=["doc_id", "y", "terms", "counts"])

    rows = docs.join(F.broadcast(chosen), "doc_id").mapInArrow(lean(run), "doc_id long, y int, terms binary, counts binary")  # 2 * most rows at most are broadcast
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("y", "terms", "counts"), "terms").alias("x"))
    got = one.select("doc_id", "x.*").orderBy("doc_id").toArrow()
    return got, sizes


def likelihood_ratio(a: np.ndarray, c: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Half the G2 of the class against a presence that a of n1 and c of n0 rows have."""

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0)

    p = (a + c) / (n1 + n0)
    return part(a, p * n1) + part(c, p * n0) + part(n1 - a, (1 - p) * n1) + part(n0 - c, (1 - p) * n0)


def term_evidence(row: np.ndarray, term: np.ndarray, y: np.ndarray, terms: int, own: float, joint: float) -> np.ndarray:
    """What each term tells of the class: alone, or among the rows that hold another one.

    A term's own likelihood ratio counts from `own` on.  Each that reaches `joint` with 8 rows or more is an anchor: in
    the rows that hold an anchor all other terms are held against the class again, and what reaches `joint` counts, as
    many pairs are tried.  So a term that is as frequent in both classes enters with the one that it interacts with.
    """
    one = y[row] == 1
    a, c = np.bincount(term[one], minlength=terms).astype(float), np.bincount(term[~one], minlength=terms).astype(float)
    alone = likelihood_ratio(a, c, y.sum(), (1 - y).sum())
    evidence = np.where((alone >= own) & (a + c >= 4), alone, 0)
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    anchor = (evidence >= joint) & (a + c >= 8)
    at = np.flatnonzero(anchor[term])
    at = at[np.argsort(term[at], kind="stable")]
    for rows in np.split(row[at], np.flatnonzero(np.diff(term[at])) + 1) if len(at) else ():
        ones, n = y[rows].sum(), len(rows)
        if not 0 < ones < n:
            continue
        held = np.concatenate([term[begin[i] : begin[i + 1]] for i in rows])
        is_one = np.repeat(y[rows] == 1, begin[rows + 1] - begin[rows])
        found, back = np.unique(held, return_inverse=True)
        with_one = np.bincount(back[is_one], minlength=len(found)).astype(float)
        ratio = likelihood_ratio(with_one, np.bincount(back, minlength=len(found)) - with_one, ones, n - ones)
        good = ratio >= joint
        evidence[found[good]] = np.maximum(evidence[found[good]], ratio[good] - joint + own)
    return evidence


def _sums(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(at, kind="stable")
    return order, *np.unique(at[order], return_index=True)


def fit(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, y: np.ndarray, weight_of: np.ndarray, bias: float, k: int, epochs: int, seed: int, shrink: float, own: float, joint: float) -> FactorizationMachine:
    """The machine of (row, bucket, count) triples in order of row, the rows' classes and weights that sum to 1.

    All buckets are tried; those with evidence are learned, the less they have the closer to 0 (penalties grow with the
    square of 20 / evidence).  Interactions are computed on the terms that a row holds, so cost grows with these alone.
    """
    seen, term = np.unique(bucket, return_inverse=True)
    evidence = term_evidence(row, term, y, len(seen), own, joint)
    place = np.cumsum(evidence > 0) - 1
    on = evidence[term] > 0
    row, term, count = row[on], place[term[on]], count[on]
    chosen, evidence = seen[evidence > 0], evidence[evidence > 0]
    width = len(chosen) * len(LEVELS)
    of = np.concatenate([row[count >= n] for n in LEVELS])
    cell = np.concatenate([term[count >= n] * len(LEVELS) + j for j, n in enumerate(LEVELS)])
    (row_order, row_at, row_from), (cell_order, cell_at, cell_from) = _sums(of), _sums(cell)
    cells, rows = cell[row_order], of[cell_order]
    penalty = np.repeat(np.maximum((20 / evidence) ** 2, 1), len(LEVELS))
    rng = np.random.default_rng(seed)
    params = [np.array([bias]), np.zeros(width), rng.normal(0, 0.05, (width, k))]
    m1, m2 = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params]
    by_row, by_cell = np.zeros((k + 2, len(y)), np.float32), np.zeros((k + 1, width), np.float32)
    for t in range(1, epochs + 1 if width else 1):
        b, w, v = params
        for j, x in enumerate(np.vstack([v.T, (v * v).sum(1), w]).astype(np.float32)):
            by_row[j, row_at] = np.add.reduceat(x[cells], row_from)
        s = by_row[:k]
        z = b[0] + by_row[k + 1] + 0.5 * ((s * s).sum(0) - by_row[k])
        g = (weight_of * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32)
        for j, x in enumerate(np.vstack([g * s, g])):
            by_cell[j, cell_at] = np.add.reduceat(x[rows], cell_from)
        xg = by_cell[k]
        grads = [np.array([g.sum()]), xg + 1e-4 * penalty * w, by_cell[:k].T + (shrink * penalty - xg)[:, None] * v]
        for i, d in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * d
            m2[i] = 0.999 * m2[i] + 0.001 * d * d
            params[i] = params[i] - 0.08 * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    b, w, v = params
    return FactorizationMachine(chosen, float(b[0]), w.reshape(-1, len(LEVELS)), v.reshape(-1, len(LEVELS), k))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, k: int = 8, epochs: int = 100, seed: int = 7, shrink: float = 3e-3, own: float = 6.0, joint: float = 24.0) -> FactorizationMachine:
    """Learn from docs (doc_id, text; other columns are ignored) and labels (doc_id, `label` 0 or 1; others are left out).

    Without rows of both classes every text scores the share of ones, or 0 without labelled rows.  A null id is no
    labelled row; a null or empty text has no terms.  An id with both labels has label 1; of an id's several texts one
    is learned from, the same in every run.  At most `most` labelled rows of a class are learned from, whole texts each.
    shrink: penalty on the interaction vectors, without which few rows are learned by heart.  own, joint: see
    `term_evidence`; no number of terms is set.
    """
    got, sizes = _sample(docs, labels, label, most)
    y = got.column("y").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.zeros((0, len(LEVELS))), np.zeros((0, len(LEVELS), k)))
    buckets = [np.frombuffer(x.as_buffer(), "<i4") for x in got.column("terms")]
    counts = [np.frombuffer(x.as_buffer(), "u1") for x in got.column("counts")]
    row = np.repeat(np.arange(len(y)), [len(x) for x in buckets])
    bucket, count = np.concatenate(buckets), np.concatenate(counts)
    del got, buckets, counts
    weight_of = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    return fit(row, bucket, count, y, weight_of / weight_of.sum(), float(np.log(sizes[1] / sizes[0])), k, epochs, seed, shrink, own, joint)


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) of each row.

    A null or empty text has no terms and gets the score of none.  Repeated rows score alike; an empty table gives no
    rows; other columns are ignored.  The model's terms come from the bounded sample and go
    along with the function.
    """
    text = F.col(text) if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = np.zeros(1 << BITS, bool)
        only[model.terms] = True
        for batch, data, off in slices(batches, "text"):
            row, bucket, count = term_counts(data, off, only)
            score = model.scores(row, np.searchsorted(model.terms, bucket), count, batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with docs' columns, in one pass.

    A null or empty text has the score of no terms.  Repeated rows stay or go alike; an empty table gives no rows;
    columns of any name pass through.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = np.zeros(1 << BITS, bool)
        only[model.terms] = True
        for batch, data, off in slices(batches, text):
            row, bucket, count = term_counts(data, off, only)
            yield batch.filter(pa.array(model.scores(row, np.searchsorted(model.terms, bucket), count, batch.num_rows) < 0.5))

    return ship(docs).mapInArrow(lean(run), schema)
