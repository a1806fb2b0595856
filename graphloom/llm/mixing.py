"""Mixing sources to target weights by iterative proportional fitting.

Token counts of (source, language, topic) cells are raked to target shares of each of the three, and documents are
sampled with one probability per cell such that the expected tokens are the budget.  Only cells reach the driver, and
only up to `most_cells` of them; more are raked in DataFrame operations with the same results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, lean, materialize, ship
from .textkit import column, slices, word_spans

AXES = ("source", "lang", "topic")
MISSING = "(none)"
TOPICS = ("notice", "record", "note", "article", "long")
OWN = ("__source", "__lang", "__topic", "__tokens", "__crc", "__probability", "__sampled")


def described(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns of rows and __tokens, __topic, __crc of the text, from one look at its bytes.

    __tokens: words between white space, 0 for null or empty text.  __topic: what kind of text it is, of legal notice,
    record-like (over one character in 20 is a digit), note (under 100 words), article (under 1,000) and long read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.array(TOPICS, dtype=object)
        for batch, data, off in slices(batches, text):
            _, _, at = word_spans(data, off)
            tokens = np.diff(at)
            per_row = lambda flag: np.diff(np.searchsorted(np.flatnonzero(flag), off))
            digits, chars = per_row((data >= 48) & (data <= 57)), per_row((data & 0xC0) != 0x80)
            notice = pc.match_substring(column(batch, text).fill_null(""), "icensed under").to_numpy(zero_copy_only=False)
            kind = np.select([notice, digits * 20 > chars, tokens < 100, tokens < 1000], [0, 1, 2, 3], 4)
            crc = np.array([zlib.crc32(data[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.array(tokens.astype(np.int64)), pa.array(kinds[kind], pa.string()), pa.array(crc)], names=[*keep, "__tokens", "__topic", "__crc"])

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("__tokens", T.LongType()), T.StructField("__topic", T.StringType()), T.StructField("__crc", T.LongType())])
    return rows.mapInArrow(lean(run), schema)


def _targets(shares: dict[str, float], power: float, given: dict[str, float] | None) -> dict[str, float]:
    """Given weights of the keys there are, or shares to a power below 1 (which lifts the rare); they add up to 1."""
    raw = {k: max(0.0, given.get(k, 0.0)) if given else v**power if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else shares


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], sweeps: int = 200, close: float = 1e-9) -> np.ndarray:
    """Cell shares with the targets as marginals, of the form tokens times a factor of each axis."""
    x = tokens / max(tokens.sum(), 1e-300)
    for _ in range(sweeps):
        worst = 0.0
        for code, want in zip(codes, targets, strict=True):
            have = np.bincount(code, x, len(want))
            factor = np.where(have > 0, want / np.where(have > 0, have, 1), 0)
            worst = max(worst, float(np.abs(have - want).max(initial=0)))
            x = x * factor[code]
        if worst < close:
            break
    return x


def probabilities(tokens: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c * share / tokens) with expected tokens of `budget`, or 1 in each cell with a share if there are too few."""
    need = np.where(tokens > 0, share / np.where(tokens > 0, tokens, 1), 0)
    order = np.argsort(-need, kind="stable")
    whole, rest = 0.0, float(share.sum())
    c = np.inf
    for i in order:
        if need[i] <= 0:
            break
        c = (budget - whole) / rest if rest > 0 else np.inf
        if c * need[i] <= 1:
            return np.minimum(1, c * need)
        whole, rest = whole + tokens[i], rest - share[i]
        if budget <= whole:
            break
    return np.minimum(1, np.where(need > 0, 1.0, 0.0)) if c * need[need > 0].min(initial=np.inf) > 1 else np.minimum(1, c * need)


def _rake_frames(cells: DataFrame, powers: dict[str, float], given: dict[str, dict[str, float]], budget_share: float, sweeps: int = 200, close: float = 1e-9) -> DataFrame:
    """rake() and probabilities() for very many cells, in joins and sums."""
    all_tokens = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.withColumn("x", F.col("tokens") / F.lit(float(max(all_tokens, 1))))
    goals = {}
    for a in AXES:
        m = cells.groupBy(a).agg(F.sum("x").alias("have"))
        raw = F.greatest(F.lit(0.0), F.coalesce(F.element_at(F.create_map(*[v for k, w in given[a].items() for v in (F.lit(k), F.lit(float(w)))]), F.col(a)), F.lit(0.0))) if given.get(a) else F.when(F.col("have") > 0, F.pow("have", F.lit(powers[a]))).otherwise(0.0)
        m = m.withColumn("raw", raw)
        total = m.agg(F.sum("raw")).first()[0] or 0.0
        goals[a] = materialize(m.select(a, (F.col("raw") / total if total else F.col("have")).alias("want")), "goals")
    for _ in range(sweeps):
        worst = 0.0
        for a in AXES:
            m = materialize(cells.groupBy(a).agg(F.sum("x").alias("have")).join(goals[a], a), "marginal")
            worst = max(worst, m.agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
            cells = cells.join(m, a).withColumn("x", F.when(F.col("have") > 0, F.col("x") * F.col("want") / F.col("have")).otherwise(0.0)).drop("have", "want")
        cells = materialize(cells, "cells")
        if worst < close:
            break
    budget, low, high = budget_share * all_tokens, 0.0, 1e18
    need = F.when(F.col("tokens") > 0, F.col("x") / F.col("tokens")).otherwise(0.0)
    for _ in range(90):  # the expected tokens grow with c
        c = (low * high) ** 0.5 if low > 0 else high / 1e3
        got = cells.agg(F.sum(F.least(F.lit(1.0), need * c) * F.col("tokens"))).first()[0] or 0.0
        low, high = (c, high) if got < budget else (low, c)
        if low and high / low < 1 + 1e-9:
            break
    return cells.withColumn("probability", F.least(F.lit(1.0), need * high))


def mix_weights(docs: DataFrame, budget_share: float = 0.6, powers: dict[str, float] | None = None, given: dict[str, dict[str, float]] | None = None, seed: int = 17, most_cells: int = 200_000, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or `keep` of them, the id among them) and __source, __lang, __topic, __tokens, __probability, __sampled.

    A null or empty source or language is the value "(none)".  given: target weights of an axis (values left out get
    none); else a value's target is its token share to the axis' power, made to add up to 1.  Documents without tokens have the
    probability of their cell, 0 if the cell has no tokens.  The draw is a hash of id, text and seed: repeated rows are
    drawn alike, and a retry draws the same.  An empty table gives no rows.  Columns of docs with the names of these are replaced.
    """
    powers = {"source": 0.7, "lang": 0.7, "topic": 0.7} | (powers or {})
    given = given or {}
    name = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(MISSING))
    docs = ship(docs).drop(*OWN)
    keep = docs.columns if keep is None else keep
    named = docs.withColumn("__source", name("source")).withColumn("__lang", name("lang"))
    seen = described(named.select("__source", "__lang", "text"), ["__source", "__lang"])
    cells = materialize(seen.groupBy(*[F.col(f"__{a}").alias(a) for a in AXES]).agg(F.sum("__tokens").alias("tokens")), "cells")
    if cells.count() <= most_cells:
        got = cells.orderBy(*AXES).toArrow()
        tokens = got.column("tokens").to_numpy().astype(float)
        codes, targets = [], []
        for a in AXES:
            values, code = np.unique(np.array(got.column(a).to_pylist(), dtype=str), return_inverse=True)
            share = np.bincount(code, tokens, len(values)) / max(tokens.sum(), 1)
            want = _targets(dict(zip(values.tolist(), share.tolist(), strict=True)), powers[a], given.get(a))
            codes.append(code)
            targets.append(np.array([want[v] for v in values.tolist()]))
        p = probabilities(tokens, rake(tokens, codes, targets), budget_share * tokens.sum()) if len(tokens) else tokens
        table = pa.table([*(got.column(a).cast(pa.string()) for a in AXES), pa.array(p, pa.float64())], names=["__source", "__lang", "__topic", "__probability"])
        fitted = F.broadcast(docs.sparkSession.createDataFrame(table))  # at most `most_cells` rows
    else:
        fitted = _rake_frames(cells, powers, given, budget_share).select(*[F.col(a).alias(f"__{a}") for a in AXES], F.col("probability").alias("__probability"))
    own = list(dict.fromkeys([*keep, "__source", "__lang"]))
    rows = described(named.select(*dict.fromkeys([*own, "text"])), own).join(fitted, ["__source", "__lang", "__topic"])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col("__crc"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.withColumn("__sampled", draw < F.col("__probability")).drop("__crc")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The sampled rows, with docs' columns, whatever their names.  What mix_weights says of odd rows holds."""
    inner = {c: fresh(f"_{c}", docs) if c.lower() in OWN else c for c in docs.columns}
    mixed = mix_weights(docs.withColumnsRenamed(inner), **how).where("__sampled")
    return mixed.select(*[F.col(f"`{x}`").alias(c) for c, x in inner.items()])
