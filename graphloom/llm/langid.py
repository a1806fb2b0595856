"""Language of whole texts: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are runs of 3 and 4 bytes of the lower-cased text, spaces included, hashed to 2**16 buckets.  As the layers
are linear, a bucket's embedding times the softmax weights is one row of a small table, so scoring a text is an average
of table rows.  Probabilities are tempered on rows that training left out; a text whose best probability is below the
level that keeps 99 % of these is flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialize, ship
from .textkit import SPACE, column, slices, utf8

BITS = 16
SAMPLE = 3000  # rows of a language that are learned from, at most
PARTS = 16
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages, float32: embedding times weights
    bias: np.ndarray
    temperature: float
    least: float  # best probabilities below are rejected


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and n+1 offsets.  White space is one blank; subwords don't cross texts."""
    n = len(data)
    own = np.where(SPACE[data], 32, data).astype(np.uint32)
    left = np.diff(off)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    three = own[:-2] << 16 | own[1:-1] << 8 | own[2:]
    four = three[:-1] << 8 | own[3:]
    out = np.empty((n, 2), np.int64)
    out[: n - 2, 0] = (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    out[: n - 3, 1] = (four * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
    to_end = np.repeat(off[1:], left) - np.arange(n)
    keep = np.stack([to_end >= 3, to_end >= 4], 1)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(keep.sum(1), out=at[1:])
    return out[keep], at[off]


def lower_text(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the lower-cased texts, and whether a text has a letter."""
    low = pc.utf8_lower(column(batch, name).cast(pa.large_string()).fill_null(""))
    letter = pc.match_substring_regex(low, r"\p{L}").to_numpy(zero_copy_only=False)
    return *utf8(pa.RecordBatch.from_arrays([low], names=["t"]), "t"), letter


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, dim: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and softmax by stochastic gradients over (buckets, shares) rows."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    w, b = np.zeros((dim, classes), np.float32), np.zeros(classes, np.float32)
    steps, t = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, share = rows[i]
            h = share @ emb[bucket]
            z = h @ w + b
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            rate = 0.5 * (1 - t / steps)
            emb[bucket] -= (rate * 20) * share[:, None] * (w @ g)
            w -= rate * np.outer(h, g)
            b -= 0.1 * rate * g
            t += 1
    return emb @ w, b


def train(docs: DataFrame, most: int = SAMPLE, dim: int = 16, epochs: int = 4, seed: int = 11) -> LanguageModel:
    """Learn from docs (text, lang); rows with null text or lang, or without a letter, are left out.

    About `most` distinct texts of a language are learned from, chosen by a hash of the text, all if there are no more;
    the learning rows hold the shares of all subwords of the whole text.  Repeated rows count once, an empty text or one
    of less than three bytes isn't learned from, and other columns are ignored.  With one language every text gets it; with none, every text is undetermined.
    """
    rows = ship(docs).where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    total = {r[0]: r[1] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}  # languages, not rows
    if not total:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rate = F.lit(0.0)
    for name, n in total.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, most / n))).otherwise(rate)
    drawn = rows.where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 20)) < rate * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, *_ in slices(batches, "text"):
            data, off, letter = lower_text(batch, "text")
            bucket, at = subwords(data, off)
            out = []
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                v, c = np.unique(bucket[a:b], return_counts=True)
                if len(v) and letter[i]:
                    out.append((i, v.astype("<u2").tobytes(), (c / c.sum()).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([column(batch, "lang").take(pa.array([o[0] for o in out], pa.int64())), column(batch, "h").take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["lang", "h", "buckets", "shares"])

    found = materialize(drawn.mapInArrow(lean(run), "lang string, h long, buckets binary, shares binary").dropDuplicates(["h", "lang"]), "language_rows")
    langs: list[str] = []
    own: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(PARTS):  # about `most` rows a language in all, a part at a time through the JVM
        got = found.where(F.pmod("h", F.lit(PARTS)) == i).toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
        langs += got.column("lang").to_pylist()
        own += [(np.frombuffer(b.as_buffer(), "<u2"), np.frombuffer(s.as_buffer(), "<f4")) for b, s in zip(got.column("buckets"), got.column("shares"), strict=True)]
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    index = {n: i for i, n in enumerate(names)}
    y = np.array([index[x] for x in langs])
    held = np.arange(len(y)) % 8 == 0 if len(y) >= 80 else np.zeros(len(y), bool)
    learn = np.flatnonzero(~held)
    table, bias = _fit([own[i] for i in learn], y[learn], len(names), dim, epochs, seed)
    test = np.flatnonzero(held) if held.any() else learn
    z = np.stack([own[i][1] @ table[own[i][0]] + bias for i in test])
    ts = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(test)), y[test]], 1e-12)).mean() for t in ts]
    t = float(ts[int(np.argmin(loss))])
    return LanguageModel(names, table.astype(np.float32), bias, t, float(np.quantile(_softmax(z / t).max(1), 0.01)))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability of it), rejected (that is too low to trust).

    A null text, one without a letter, and every text where nothing was learned, is `und` with score 0, rejected.
    A text too short for a subword gets the most likely language of none.  An empty table gives no rows.
    """
    text = F.col(text) if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch, *_ in slices(batches, "text"):
            data, off, letter = lower_text(batch, "text")
            bucket, at = subwords(data, off)
            n = np.diff(at)
            sums = np.zeros((batch.num_rows, len(model.languages)))
            for j in range(len(model.languages)):
                c = np.zeros(len(bucket) + 1)
                np.cumsum(model.table[:, j][bucket], out=c[1:])
                sums[:, j] = c[at[1:]] - c[at[:-1]]
            if model.languages:
                p = _softmax((sums / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
                best, score = p.argmax(1), p.max(1)
            else:
                best, score, letter = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), letter & False
            best, score = np.where(letter, best, len(model.languages)), np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(score < max(model.least, 1e-12))], names=["doc_id", "lang_pred", "score", "rejected"])

    return ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), "doc_id long, lang_pred string, score double, rejected boolean")
