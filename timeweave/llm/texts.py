"""Words of Arrow text columns as numpy arrays: byte offsets and 64-bit hashes, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; only a single longer text exceeds it.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_ALL = np.arange(256, dtype=np.uint8)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
SAME = _ALL.copy()
#: Bytes of the words ``[^\x20\x09-\x0D]+``.
SPACED = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_ALL >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, SLICE_BYTES + 1)
        base = np.full(size, _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        base[0] = 1
        _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


@dataclass
class Words:
    """Words of consecutive texts ``data[bounds[d]:bounds[d+1]]``: byte offsets, hashes, and ``first[d]`` the first word of text d."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray, case: np.ndarray) -> Words:
    """Words of the texts ``data[bounds[d]:bounds[d+1]]``; ``letters`` tells which bytes make words, ``case`` maps bytes first."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, bounds, none, none, none.astype(np.uint64), np.zeros(len(bounds), np.int64))
    inside = letters[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begin[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((case[data].astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", len(data))[starts]
    hashes = mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
    return Words(data, bounds, starts, ends, hashes, np.searchsorted(starts, bounds))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes, or of one longer text."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def sliced_words(column: pa.Array, letters: np.ndarray, case: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of consecutive texts of a column, a slice at a time."""
    if not len(column):
        return
    data, bounds = raw_bytes(column)
    for at, to in slices(bounds):
        yield at, to, words(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], letters, case)


def window_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values (texts' ends are the caller's matter)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def per_text_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each range ``first[d]:first[d+1]``."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]
