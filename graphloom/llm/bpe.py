"""Byte-level BPE ids of whole texts.

The JSON vocabulary's splitting rule cuts a text into pieces that are encoded one by one, so each distinct piece is
encoded once and looked up after that.  Pieces are found for a batch at once on an array of code points.  Texts the
array rule doesn't cover (an apostrophe before a letter, characters beyond Latin script) are encoded whole.
Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textkit import place_table, span_hashes

TOKENIZER = "byte_bpe_50k.json"
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4
_LATIN = 0x250


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def encoder(path: str):
    """An encoder over the vocabulary and the merges order of a byte-level BPE JSON file (ids in merge order)."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items() if all(c in byte for c in k) and not (k.startswith("<|") and k.endswith("|>"))}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(_LATIN, OTHER, np.uint8)
    for c in range(_LATIN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else BLANK if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F) else OTHER
    return out


def piece_starts(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces start, for code points below 0x250 without an apostrophe before a letter."""
    kind = _classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[off] = True
    prev = np.empty(n, np.uint8)
    prev[1:] = kind[:-1]
    prev[0] = 0
    nxt = np.empty(n, np.uint8)
    nxt[:-1] = kind[1:]
    nxt[-1] = 0
    blank = kind == BLANK
    glued = np.zeros(n, bool)  # a space before that starts the piece
    glued[1:] = (points[:-1] == 0x20) & ~first[1:n]
    last_blank = blank & (nxt != BLANK) & (nxt != 0) & ~first[1:]
    start = np.where(blank, (prev != BLANK) | last_blank, (kind != prev) & ~glued)
    return start | first[:n]


class BatchEncoder:
    """Ids of many texts at once; pieces seen before are looked up.

    Known pieces lie in a table of slots (hash, place and number of ids), half of them free at least, and are looked up
    and added all at once.  The memory of pieces is emptied when it holds `most` of them; that changes no result.
    """

    def __init__(self, path: str | None = None, most: int = 1 << 18):
        self.enc, self.most = encoder(path or vocabulary_path()), most
        self._reset()

    def _reset(self) -> None:
        self.ids, self.used, self.known = np.zeros(1 << 16, np.uint32), 0, 0
        self._table((2 * self.most - 1).bit_length())

    def _table(self, bits: int) -> None:
        self.bits = max(bits, 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)  # 0: free
        self.starts = np.zeros(1 << self.bits, np.int64)
        self.sizes = np.zeros(1 << self.bits, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot that has each hash, or the free one where the search for it ends."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.keys[slot]
        left = np.flatnonzero((seen != h) & (seen != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[left]]
            left = left[(seen != h[left]) & (seen != 0)]
        return slot

    def _put(self, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct hashes that have no slot yet, with their ids' places."""
        slot, left = self._find(h), np.arange(len(h))
        while len(left):
            self.keys[slot[left]] = h[left]  # of those that want one slot, one gets it
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = self._find(h[left])
        self.starts[slot], self.sizes[slot] = starts, sizes
        self.known += len(h)

    def _learn(self, h: np.ndarray, points: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        if 2 * (self.known + len(h)) > len(self.keys):
            own = np.flatnonzero(self.keys)
            old = self.keys[own], self.starts[own], self.sizes[own]
            self._table((2 * (self.known + len(h))).bit_length())
            self.known = 0
            self._put(*old)
        kind = _classes()[points[e - 1]]
        for mark, own in (("0", kind == LETTER), ("a", (kind == NUMBER) | (kind == OTHER)), ("", kind == BLANK)):
            own = np.flatnonzero(own)
            if not len(own):
                continue
            ids, sizes = self._marked(mark, points, s[own], e[own]) if mark else self._single(points, s[own], e[own])
            end = self.used + len(ids)
            if end > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.empty(end, np.uint32)])
            self.ids[self.used : end] = ids
            self._put(h[own], self.used + np.cumsum(sizes) - sizes, sizes)
            self.used = end

    def _marked(self, mark: str, points: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and the number of each one's, encoded as one text with a mark before each piece.

        The mark is of another kind than the pieces, which stay apart by it and have none of its bytes, so not its id.
        """
        size = e - s + 1
        first = np.cumsum(size) - size
        text = points[np.maximum(np.arange(int(size.sum())) + np.repeat(s - first - 1, size), 0)]
        text[first] = ord(mark)
        ids = np.frombuffer(self.enc._core_bpe.encode_to_tiktoken_buffer(text.astype("<u4").tobytes().decode("utf-32-le"), set()), np.uint32)
        own = ids != self.enc.encode_ordinary(mark)[0]
        return ids[own], np.diff(np.append(np.flatnonzero(~own), len(ids))) - 1

    def _single(self, points: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = [self.enc.encode_ordinary(points[a:b].astype("<u4").tobytes().decode("utf-32-le")) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        return np.array([i for x in new for i in x], np.uint32), np.array([len(x) for x in new], np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts in UTF-8 one after another, and n+1 offsets; `end` is put after each text."""
        n = len(off) - 1
        whole = data.tobytes().decode("utf-8", "replace") if len(data) else ""
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = off - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), off)
        odd = np.flatnonzero(points >= _LATIN)
        marks = np.flatnonzero(points[:-1] == 0x27)
        odd = np.concatenate([odd, marks[_classes()[np.minimum(points[marks + 1], _LATIN - 1)] == LETTER]])
        slow = np.zeros(n, bool)
        if len(odd):
            slow[np.searchsorted(at, odd, "right") - 1] = True
            points = points.copy()
            points[odd] = 0x20
        if self.known > self.most:
            self._reset()
        s = np.flatnonzero(piece_starts(points, at)) if len(points) else np.zeros(0, np.int64)
        e = np.append(s[1:], len(points)).astype(np.int64)
        row_at = np.searchsorted(s, at)
        if slow.any():
            per_row = np.diff(row_at)
            fast = np.repeat(~slow, per_row)
            s, e = s[fast], e[fast]
            row_at = np.concatenate([[0], np.cumsum(np.where(slow, 0, per_row))])
        h = np.maximum(_point_hashes(points, s, e), 1)
        slot = self._find(h)
        new = np.flatnonzero(self.keys[slot] != h)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            self._learn(keys, points, s[new[first]], e[new[first]])
            slot = self._find(h)
        size = self.sizes[slot]
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        per_row = np.diff(before[row_at])
        others = {i: np.array(self.enc.encode_ordinary(whole[at[i] : at[i + 1]]), np.uint32) for i in np.flatnonzero(slow).tolist()}
        for i, ids in others.items():
            per_row[i] = len(ids)
        out_at = np.zeros(n + 1, np.int64)
        np.cumsum(per_row + (end is not None), out=out_at[1:])
        found = self.ids[np.arange(before[-1]) + np.repeat(self.starts[slot] - before[:-1], size)]
        if not others and end is None:
            return found, out_at
        out, looked_up = np.empty(out_at[-1], np.uint32), np.ones(out_at[-1], bool)
        for i, ids in others.items():
            out[out_at[i] : out_at[i] + len(ids)] = ids
            looked_up[out_at[i] : out_at[i] + len(ids)] = False
        if end is not None:
            out[out_at[1:] - 1] = end
            looked_up[out_at[1:] - 1] = False
        out[looked_up] = found
        return out, out_at


def _point_hashes(points: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return span_hashes(points, s, e, _point_table())


@lru_cache(1)
def _point_table() -> np.ndarray:
    return place_table(_LATIN, 977)


def text_ids(batch: pa.RecordBatch, name: str, enc: BatchEncoder, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    from .textkit import utf8

    return enc.encode(*utf8(batch, name), end)
