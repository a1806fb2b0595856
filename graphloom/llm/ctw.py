"""Language-model scores by context-tree weighting over bytes, and a word-unigram base score.

A byte is eight binary decisions.  Each decision has, after each context of 0 to `DEPTH` bytes, a Krichevsky-Trofimov
estimate from the counts in the training texts, and weighting mixes the estimates of all depths: a node's probability
is half its own block probability and half the product of its children's.  Every context of the training texts is kept.

What a byte scores depends on its run of DEPTH + 1 bytes only, so the model is a table of such runs, which grows with
the input.  It is made in two passes over the distinct runs, dealt by their newest TOP + 1 context bytes: a subtree below
such a context needs nothing but its own runs.  Only the contexts of up to TOP bytes (65,536 at most) reach the driver.
The most frequent runs (HEAD_RUNS at most) are looked up without a shuffle, all others by one, as words are.

The model codes what the base score counts: A-Z as a-z, words separated by one blank, then one end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialize, ship
from .textkit import SPACE, column, rows_of, signed, slices, span_hashes, word_spans

DEPTH = 5
TOP = 2
CHUNK = 1 << 17  # runs whose subtrees are held at a time
HEAD_RUNS = 1 << 21
HEAD = 1 << 16  # words with at least 1 / HEAD of all tokens are looked up without a shuffle
END = np.int64(0x5EED0E4D)  # stands for the end token among word hashes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class ContextTree:
    """A tree in memory."""

    children: list[np.ndarray]  # by depth: (contexts + 1) x 256 to the next depth's context; the last one is none
    first: list[int]  # by depth: row of its first context in logp
    logp: np.ndarray  # rows x 256, float32, log10

    def byte_scores(self, codes: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        row = np.zeros(len(codes), np.int32)
        at = np.zeros(len(codes), np.int32)
        for d, child in enumerate(self.children):
            at = child.ravel()[at * np.int32(256) + before[d]]
            row = np.where(at < self.first[d + 2] - self.first[d + 1], at + self.first[d + 1], row)
        return self.logp.ravel()[row.astype(np.int64) * 256 + codes]


def coded(data: np.ndarray, off: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the model codes for each text (each word followed by a blank, the last by 0), and n+1 offsets."""
    s, e, at = spans
    words = np.diff(at)
    empty = words == 0
    sums = np.concatenate([[0], np.cumsum(e - s + 1)])
    out_at = sums[at] + np.concatenate([[0], np.cumsum(empty)])
    out = np.full(out_at[-1], 32, np.uint8)
    if len(s):
        inside = _LOWER[data[~SPACE[data]]]
        shift = np.arange(len(s)) + np.cumsum(empty)[rows_of(at)]
        out[np.arange(len(inside)) + np.repeat(shift, e - s)] = inside
    out[out_at[1:] - 1] = 0
    return out, out_at


def before(codes: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The byte 1, 2, ... `depth` places before each byte; 0 before a text's first byte."""
    place = np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at))
    out = []
    for d in range(1, depth + 1):
        x = np.zeros(len(codes), np.uint8)
        x[d:] = codes[:-d]
        x[place < d] = 0
        out.append(x)
    return out


def byte_runs(codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Each byte and the `depth` before it, the newest lowest."""
    run = codes.astype(np.int64)
    for d, x in enumerate(before(codes, at, depth), 1):
        run |= x.astype(np.int64) << (8 * d)
    return run


def token_hashes(data: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    return signed(span_hashes(data, spans[0], spans[1]))


class _Counter:
    """Counts of 64-bit keys that are merged as they grow."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        self.new.append(np.unique(keys, return_counts=True))
        if sum(len(k) for k, _ in self.new) > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        n = np.concatenate([self.n, *(c for _, c in self.new)])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        self.keys, self.n, self.new = keys[fresh], np.add.reduceat(n, fresh) if len(keys) else n, []


def corpus_counts(training: DataFrame, docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind (0: word, 1: run of depth + 1 bytes), key, n in the texts of training, m in those of docs (runs only)."""

    def counts(learn: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = (_Counter(), _Counter())

            def out() -> Iterator[pa.RecordBatch]:
                for kind, c in enumerate(held):
                    c.merge()
                    for a in range(0, len(c.keys), 1 << 16):
                        k, n = c.keys[a : a + (1 << 16)], c.n[a : a + (1 << 16)]
                        none = np.zeros(len(k), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n if learn else none), pa.array(none if learn else n)], names=["kind", "key", "n", "m"])
                    c.__init__()

            for batch, data, off in slices(batches, "text"):
                spans = word_spans(data, off)
                if learn:
                    held[0].add(np.concatenate([token_hashes(data, spans), np.full(batch.num_rows, END)]))
                held[1].add(byte_runs(*coded(data, off, spans), depth))
                if max(len(c.keys) for c in held) > 1 << 20:
                    yield from out()
            yield from out()

        return run

    schema = "kind int, key long, n long, m long"
    rows = training.select("text").mapInArrow(lean(counts(True)), schema).unionByName(docs.select("text").mapInArrow(lean(counts(False)), schema))
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma, x >= 0.5."""
    product = x.copy()
    for i in range(1, 8):
        product *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of each of a byte's 255 decisions (numbered 1 .. 255 as 1 and the bits before)."""
    n = len(counts)
    zero, one = np.zeros((n, 256)), np.zeros((n, 256))
    for b in range(8):
        x = counts.reshape(n, 1 << b, 2, 1 << (7 - b)).sum(3)
        zero[:, 1 << b : 2 << b], one[:, 1 << b : 2 << b] = x[:, :, 0], x[:, :, 1]
    return zero, one


def _kt(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log block probability and probability of a one."""
    return _estimates(*_bits(counts))


def _estimates(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        log = np.where(zero + one > 0, _lgamma(zero + 0.5) + _lgamma(one + 0.5) - _lgamma(zero + one + 1) - 2 * _lgamma(np.array(0.5)), 0.0)
    return log, (one + 0.5) / (zero + one + 1)


def build_tree(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> ContextTree:
    """levels[d]: context, byte and count of the kept contexts of d bytes (the newest byte lowest)."""
    depth = len(levels) - 1
    contexts, counts = [], []
    for d, (ctx, byte, n) in enumerate(levels):
        own = np.unique(ctx) if d else np.zeros(1, np.int64)
        dense = np.zeros((len(own), 256))
        dense[np.searchsorted(own, ctx), byte] = n
        contexts.append(own)
        counts.append(dense)
    parents = [None] + [np.searchsorted(contexts[d - 1], contexts[d] & ((1 << (8 * (d - 1))) - 1)) for d in range(1, depth + 1)]
    alpha, rest_kt = [np.ones((1, 1))] * (depth + 1), [None] * (depth + 1)
    below = None
    for d in range(depth, -1, -1):
        own, _ = _kt(counts[d])
        if d == depth:
            weighted = own
            alpha[d] = np.ones_like(own)
        else:
            rest = counts[d].copy()
            np.subtract.at(rest, parents[d + 1], counts[d + 1])
            split, rest_kt[d] = _kt(np.maximum(rest, 0))
            np.add.at(split, parents[d + 1], below)
            weighted = np.logaddexp(own, split) - np.log(2)
            alpha[d] = np.exp(own - np.log(2) - weighted)
        below = weighted
    first, tables, children = [0], [], []
    a_up = b_up = None
    for d in range(depth + 1):
        _, kt = _kt(counts[d])
        a0, b0 = (np.zeros((1, 256)), np.ones((1, 256))) if d == 0 else (a_up[parents[d]], b_up[parents[d]])
        a_up, b_up = a0 + b0 * alpha[d] * kt, b0 * (1 - alpha[d])
        p = np.clip(a_up + (b_up * rest_kt[d] if d < depth else 0), 1e-12, 1 - 1e-12)
        log = np.zeros((len(p), 1))
        for b in range(8):
            q = p[:, 1 << b : 2 << b]
            log = np.stack([log + np.log10(1 - q), log + np.log10(q)], 2).reshape(len(p), 2 << b)
        tables.append(log.astype(np.float32))
        first.append(first[-1] + len(p))
        if d < depth:
            child = np.full((len(p) + 1, 256), len(contexts[d + 1]), np.int32)
            child[parents[d + 1], contexts[d + 1] >> (8 * d)] = np.arange(len(contexts[d + 1]))
            children.append(child)
    return ContextTree(children, first, np.concatenate(tables))


@dataclass
class _Level:
    """Decisions after contexts of one depth, with key context << 8 | decision."""

    key: np.ndarray
    up: np.ndarray  # of each decision that was summed, its place in key
    zero: np.ndarray
    one: np.ndarray
    weighted: np.ndarray  # log probability
    alpha: np.ndarray  # weight of the own estimate
    kt: np.ndarray  # the own estimate


def _level(at: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray | None = None) -> _Level:
    """Sums by key `at`; below: weighted log probabilities of the decisions that are summed, none at the last depth."""
    key, up = np.unique(at, return_inverse=True)
    zero, one = np.bincount(up, zero, len(key)), np.bincount(up, one, len(key))
    own, kt = _estimates(zero, one)
    if below is None:
        return _Level(key, up, zero, one, own, np.ones_like(own), kt)
    weighted = np.logaddexp(own, np.bincount(up, below, len(key))) - np.log(2)
    return _Level(key, up, zero, one, weighted, np.exp(own - np.log(2) - weighted), kt)


def _shorter(key: np.ndarray, d: int) -> np.ndarray:
    """Keys of the same decisions after the newest d bytes."""
    return key & ((1 << (8 * (d + 1))) - 1)


def _subtrees(run: np.ndarray, n: np.ndarray, depth: int, low: int) -> tuple[list[_Level], np.ndarray]:
    """Levels `depth` to `low`, and the eight bits of each run's byte."""
    byte, i = run & 255, np.arange(8)[:, None]
    bit = (byte >> (7 - i)) & 1
    levels = [_level(((run & ~255) | (1 << i) | (byte >> (8 - i))).ravel(), ((1 - bit) * n).ravel(), (bit * n).ravel())]
    for d in range(depth - 1, low - 1, -1):
        x = levels[-1]
        levels.append(_level(_shorter(x.key, d), x.zero, x.one, x.weighted))
    return levels, bit


def _mixed(levels: list[_Level], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a one and the weight left for deeper contexts, at the first (deepest) of levels; a, b: the same above the last."""
    for i in range(len(levels) - 1, -1, -1):
        x = levels[i]
        a, b = a + b * x.alpha * x.kt, b * (1 - x.alpha)
        if i:
            a, b = a[x.up], b[x.up]
    return a, b


def _whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Sorted runs in tables of about CHUNK rows that don't cut through the runs of a context of `width` bytes."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            t = pa.Table.from_batches(held)
            group = _shorter(t.column("key").to_numpy() >> 8, width - 1)
            cut = int(np.argmax(group == group[-1]))
            if cut:
                yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def run_scores(runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, m, score (log10 of the byte's probability) of the rows of runs (key, n in training, m) with m > 0."""
    top = min(TOP, depth - 1)
    dealt = runs.select("key", "n", "m", F.expr(f"shiftright(key, 8) & {(1 << (8 * (top + 1))) - 1}").alias("suffix")).repartition("suffix").sortWithinPartitions("suffix").select("key", "n", "m")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, top + 1):
            x = _subtrees(t.column("key").to_numpy(), t.column("n").to_numpy(), depth, top + 1)[0][-1]
            key, to = np.unique(_shorter(x.key, top), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.bincount(to, v, len(key))) for v in (x.zero, x.one, x.weighted))], names=["key", "zero", "one", "below"])

    sums = dealt.mapInArrow(lean(up), "key long, zero double, one double, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "below")])
    got = sums.orderBy("key").toArrow()  # 255 decisions of 65,536 contexts at most
    levels = [_level(*(got.column(c).to_numpy() for c in ("key", "zero", "one", "below")))]
    for d in range(top - 1, -1, -1):
        x = levels[-1]
        levels.append(_level(_shorter(x.key, d), x.zero, x.one, x.weighted))
    top_key = levels[0].key
    top_a, top_b = _mixed(levels, np.zeros(len(levels[-1].key)), np.ones(len(levels[-1].key)))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, top + 1):
            own, bit = _subtrees(t.column("key").to_numpy(), t.column("n").to_numpy(), depth, top + 1)
            k = np.searchsorted(top_key, _shorter(own[-1].key, top))
            p = np.clip(_mixed(own, top_a[k], top_b[k])[0], 1e-12, 1 - 1e-12)[own[0].up].reshape(bit.shape)
            score = np.log10(np.where(bit, p, 1 - p)).sum(0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), t.column("m").combine_chunks(), pa.array(score)], names=["key", "m", "score"])

    return dealt.mapInArrow(lean(down), "key long, m long, score float").where("m > 0")


class RunTable:
    """Scores of runs by direct address; what finds no free place in three tables isn't held."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray) -> None:
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            bits = max(1, int(2 * len(keys)).bit_length())
            at = self.place(keys, odd, bits)
            own, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
            own[at], values[at] = keys, scores  # the last one of a place stays
            self.tables.append((odd, own, values))
            out = own[at] != keys
            keys, scores = keys[out], scores[out]

    @staticmethod
    def place(keys: np.ndarray, odd: int, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - bits)).astype(np.int64)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, 0 of what isn't held, and the places in keys of these."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for odd, own, values in self.tables:
            at = self.place(keys[left], odd, len(own).bit_length() - 1)
            hit = own[at] == keys[left]
            out[left[hit]] = values[at[hit]]
            left = left[~hit]
        return out, left


def _lists(row: np.ndarray, key: np.ndarray, n: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Distinct keys of each of n rows, and how often each occurs in its row."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, int)
    times = np.diff(np.append(fresh, len(key))).astype(np.int32)
    at = pa.array(np.searchsorted(row[fresh], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(key[fresh])), pa.ListArray.from_arrays(at, pa.array(times))


def lm_scores(docs: DataFrame, training: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, code_bits_per_byte.

    training: the column `text` too; its tokens are counted in full.  A null or empty text is its end alone.  Without
    training rows nothing is known and each decision has probability 1/2.  Repeated rows are scored each on its own;
    an empty table gives no rows; other columns are ignored.
    """
    text = F.col(text) if isinstance(text, str) else text
    own = ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    counts = materialize(corpus_counts(training.select(text.alias("text")), own, depth), "counts")
    words = counts.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = words.where(F.col("c") >= max(1, -(-total // HEAD))).orderBy("word").toArrow()  # at most HEAD rows
    head_words, head_counts = (head.column(i).to_numpy() for i in range(2))
    scale = total + 0.5 * (distinct + 1)
    runs = materialize(run_scores(counts.where("kind = 1"), depth), "runs")
    steps = runs.groupBy(F.floor(F.log2("m") * 4).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()  # 252 rows at most
    fit = [r["step"] for r, held in zip(steps, np.cumsum([r["count"] for r in steps]), strict=True) if held <= HEAD_RUNS]
    frequent = runs.where(F.floor(F.log2("m") * 4) >= min(fit, default=1 << 30)).select("key", "score").toArrow()  # at most HEAD_RUNS rows
    table = RunTable(frequent.column("key").to_numpy(), frequent.column("score").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        logs = np.log10((head_counts + 0.5) / scale)
        for batch, data, off in slices(batches, "text"):
            n = batch.num_rows
            spans = word_spans(data, off)
            at = spans[2]
            h = np.concatenate([token_hashes(data, spans), np.full(n, END)])
            row = np.concatenate([rows_of(at), np.arange(n)])
            k = np.minimum(np.searchsorted(head_words, h), max(0, len(head_words) - 1))
            hit = head_words[k] == h if len(head_words) else np.zeros(len(h), bool)
            base = np.bincount(row[hit], logs[k[hit]], n).astype(np.float64)
            known = np.bincount(row[hit], minlength=n)
            codes, code_at = coded(data, off, spans)
            keys = byte_runs(codes, code_at, depth)
            found, left = table.look(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + n)), column(batch, "doc_id"), pa.array(np.diff(at) + 1), pa.array(known), pa.array(base), pa.array(np.add.reduceat(found, code_at[:-1])), pa.array(np.diff(code_at)),
                 *_lists(row[~hit], h[~hit], n), *_lists(rows_of(code_at)[left], keys[left], n)],
                names=["row", "doc_id", "n_tokens", "known", "base", "score", "bytes", "words", "times", "runs", "run_times"],
            )
            number += n

    rows = materialize(own.mapInArrow(lean(run), "row long, doc_id long, n_tokens long, known long, base double, score double, bytes long, words array<long>, times array<int>, runs array<long>, run_times array<int>"), "scored")

    def tail(keys: str, times: str) -> DataFrame:
        return rows.select("row", F.explode(F.arrays_zip(F.col(keys).alias("k"), F.col(times).alias("t"))).alias("x")).select("row", F.col("x.k").alias("key"), F.col("x.t").alias("times"))

    log = F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.5)) / F.lit(float(scale)))
    of_words = tail("words", "times").join(words.withColumnRenamed("word", "key").hint("shuffle_hash"), "key", "left").select("row", (F.col("times") * log).alias("more"), F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("more_known"), F.lit(0.0).alias("more_score"))
    of_runs = tail("runs", "run_times").join(runs.select("key", "score").hint("shuffle_hash"), "key").select("row", F.lit(0.0).alias("more"), F.lit(0).alias("more_known"), (F.col("times") * F.col("score").cast("double")).alias("more_score"))
    summed = of_words.unionByName(of_runs).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "more_known", "more_score")])
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return rows.drop("words", "times", "runs", "run_times").join(summed, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score / float(np.log10(2)) / F.col("bytes")).alias("code_bits_per_byte"),
    )
