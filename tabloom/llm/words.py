"""Words of many texts at once: byte-level splitting and rolling hashes over Arrow batches.

A task reads the UTF-8 bytes of a batch where they lie and handles a few megabytes at a time, so memory follows the
chunk (or one very long text), never the partition. Hashes are pure functions of the words: equal words and equal runs
of words get equal names on every executor without any exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
LANE = 8
_BASES = {1: 0x9E3779B97F4A7C15, 2: 0xBF58476D1CE4E5B9}
_ROLL = 0xD1342543DE82EF95


@cache
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def rolling(values: np.ndarray, width: int, base: int = _ROLL) -> np.ndarray:
    """Hash of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return spans(values, np.arange(n), np.arange(width, n + width), base)


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _ROLL) -> np.ndarray:
    """Hash of values[start:end] for many spans; equal content gives equal hashes wherever it stands."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(pow(base, -1, 2**64), n + 1)[start])


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: True for bytes that separate words.
BLANKS = _table(b" \t\n\x0b\x0c\r")
NOT_ALNUM = _table(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Chunk:
    """Texts of rows ``row`` .. of a batch; words i of text t are first[t] <= i < first[t + 1]."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A name for every word; those of two seeds are independent.

        A polynomial modulo 2**64 alone cannot tell some long words apart, whatever its base. So it only names lanes of
        LANE bytes; lanes are mixed with their place in the word, added up, and mixed with the word's length.
        """
        n, base = len(self.data), _BASES[seed]
        if not len(self.start):
            return np.empty(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values(seed)[self.data] * powers(base, n), out=total[1:])
        length = self.end - self.start
        lanes = (length + LANE - 1) // LANE
        first = np.cumsum(lanes) - lanes
        place = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        start = np.repeat(self.start, lanes) + LANE * place
        end = np.minimum(start + LANE, np.repeat(self.end, lanes))
        lane = (total[end] - total[start]) * powers(pow(base, -1, 2**64), n + 1)[start]
        lane = mix(lane + (place + 1).astype(np.uint64) * np.uint64(_BASES[3 - seed]))
        return mix(np.add.reduceat(lane, first) + length.astype(np.uint64) * np.uint64(_ROLL))

    def owner(self, counts: np.ndarray | None = None) -> np.ndarray:
        """The text of every word (or of ``counts`` things of each text)."""
        return np.repeat(np.arange(self.texts), np.diff(self.first) if counts is None else counts)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index at which each window of ``width`` words of one text starts, and the windows of each text."""
        counts = np.maximum(np.diff(self.first) - width + 1, 0)
        return ragged(self.first[:-1], counts), counts

    def raw(self, t: int) -> bytes:
        return self.data[self.offsets[t]:self.offsets[t + 1]].tobytes()


def ragged(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (counts[0] of them), start[1], ..."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(start) - (ends - counts), counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def chunks(column: pa.Array, separators: np.ndarray = BLANKS, fold: np.ndarray | None = None) -> Iterator[Chunk]:
    at, data = text_bytes(column)
    for a, b in slices(at):
        part = data[at[a]:at[b]]
        offsets = at[a:b + 1] - at[a]
        inside = ~separators[part]
        edge = offsets[:-1][offsets[:-1] < len(part)]
        before = np.zeros(len(part), bool)
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.zeros(len(part), bool)
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        yield Chunk(a, part if fold is None else fold[part], offsets, start, end, np.searchsorted(start, offsets))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
