"""Vectorised word scanning over Arrow text columns.

The functions take the UTF-8 bytes of many texts at once, so a word costs a few
array operations and no Python object. Memory is bounded by ``SHARD_BYTES`` for
a run of rows and by ``BLOCK_BYTES`` for the arrays made per byte; only a single
text longer than a shard is held whole (its bytes and eight bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 1 << 18

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RADIX = 1 << 16
_BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, _RADIX)
_LETTER = mix(np.arange(256, dtype=np.uint64))
_FOLDED = _LETTER.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]


def spaced() -> np.ndarray:
    """Which bytes belong to words split at ASCII white space."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Which bytes belong to words of ASCII letters, digits and non-ASCII characters."""
    table = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = True
    return table


def shards(column: pa.Array, limit: int = SHARD_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, past last) with their bytes and row offsets; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (and past the last)."""
    inside = table[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    opens[offsets[full]] = inside[offsets[full]]
    closes[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` reads A-Z as a-z."""
    letters, out, lengths = (_FOLDED if fold else _LETTER), np.empty(len(starts), np.uint64), ends - starts
    total, i = np.concatenate([[0], np.cumsum(lengths)]), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + BLOCK_BYTES, "right")) - 1)
        begin = total[i:j] - total[i]
        within = np.arange(total[j] - total[i]) - np.repeat(begin, lengths[i:j])
        value = letters[data[within + np.repeat(starts[i:j], lengths[i:j])]]
        if lengths[i:j].max() > _RADIX:
            lap = mix((within // _RADIX).astype(np.uint64))
            lap[within < _RADIX] = 1  # shorter words beside a long one keep their hashes
            value *= lap
            del lap
        out[i:j] = np.add.reduceat(value * _POWER[within % _RADIX], begin)
        i = j
    return mix(out ^ (lengths.astype(np.uint64) * _GOLDEN))


def texts_to_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a shard and the first word of each row."""
    starts, ends, first = spans(data, offsets, table)
    return word_hashes(data, starts, ends, fold), first


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
