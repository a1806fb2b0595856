"""Vectorised text work on Arrow batches: whole texts as one byte array, no Python string per row.

A span's hash adds up one random 64-bit number for each (place in the span, byte), so that no pair of spans collides
by structure, and mixes the sum.  All constants come from fixed seeds, so each worker and each retry of a task gets the
same values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PLACES = 64  # places in a span with random numbers of their own; later ones mix theirs with the number of the round


def place_table(symbols: int, seed: int) -> np.ndarray:
    """A random number for each place and symbol."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, (PLACES, symbols), dtype=np.uint64)


_BYTE = place_table(256, 20240611)
BYTE_LOWER = _BYTE.copy()
BYTE_LOWER[:, 65:91] = _BYTE[:, 97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits separates; bytes of other characters belong to words.
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n+1 offsets; a null text is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    bufs, n = col.buffers(), len(col)
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and n else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterable[pa.RecordBatch], name: str, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes of text (one row at least): the rows, their bytes, their offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = utf8(batch, name)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def word_spans(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and n+1 offsets of the rows' words.  Words don't cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """A 64-bit hash of each span (A-Z as a-z with the default table).  Spans begin in rising order and don't overlap."""
    if not len(s):
        return np.zeros(0, U64)
    size = e - s
    if len(s) > 1 and size.sum() > 1 << 22:  # a part at a time, so that a very long text takes no more memory
        half = len(s) // 2
        return np.concatenate([span_hashes(data, s[:half], e[:half], table), span_hashes(data, s[half:], e[half:], table)])
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    own = data[place + np.repeat(s, size)]
    value = table.ravel()[(place & (PLACES - 1)) * table.shape[1] + own]
    late = np.flatnonzero(place >= PLACES)
    with np.errstate(over="ignore"):
        if len(late):
            value[late] = mix(value[late] + (place[late] // PLACES).astype(U64) * U64(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(value, dtype=U64)])
        return mix(sums[before + size] - sums[before] + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each item, from the items' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
