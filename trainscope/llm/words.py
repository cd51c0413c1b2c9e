"""Words of whole texts as arrays, for code that runs inside Spark tasks.

A batch of texts is cut into pieces of about one megabyte, never inside a text, and each piece is
handled with a few passes over its bytes, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

#: Space, and tab to carriage return: the separators of the query contracts.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: The same and ASCII punctuation, for matching that ignores punctuation.
MARKS = BLANKS + bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Powers:
    """Powers of the hash base and of its inverse, as far as needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * PIECE)
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                                for b in (_BASE, _BACK))
        return cls.up, cls.down


class Words:
    """The words of some texts: hash, first byte, end byte; those of text i are ``first[i]:first[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, blanks: bytes):
        separator = np.zeros(256, bool)
        separator[list(blanks)] = True
        self.data = _LOWER[data]
        n = len(data)
        blank = separator[data]
        before = np.ones(n + 1, bool)
        before[1:] = blank
        before[offsets] = True
        self.start = np.flatnonzero(~blank & before[:n])
        after = np.ones(n, bool)
        after[:-1] = blank[1:]
        inner = offsets[(offsets > 0) & (offsets <= n)] - 1
        after[inner] = True
        self.end = np.flatnonzero(~blank & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = Powers.to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def rows(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offset of each; a null text has no bytes."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``PIECE`` bytes."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1
        stop = min(max(stop, row + 1), row + 65536, batch.num_rows)
        yield batch.slice(row, stop - row)
        row = stop


def words_of(texts: pa.Array, blanks: bytes = BLANKS) -> Words:
    data, offsets = text_bytes(texts)
    return Words(data, offsets, blanks)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; a run is named by its first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _BASE + h[j:j + n]
    return mix(total)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of neighbouring rows with equal keys (not null), from sorted batches."""
    kept: list[pa.RecordBatch] = []
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        if kept and first != held:
            yield pa.Table.from_batches(kept)
            kept = []
        for a, b in zip(cuts, cuts[1:]):
            if a and kept:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
        held = tuple(c[-1] for c in cols)
    if kept:
        yield pa.Table.from_batches(kept)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)
