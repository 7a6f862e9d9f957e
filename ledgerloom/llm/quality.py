"""Quality: histogram gradient-boosted trees over document statistics.

The statistics are computed for many texts at once from their bytes: character
classes, word lengths and case, repeated words and word pairs, lines and their
repeats, sentence ends. The trees are flat arrays that numpy traverses for a
whole batch. Training takes at most ``SAMPLE_PER_CLASS`` labelled documents of
each class, weighted so that the classes keep their shares of all labelled
documents; scoring reads every text whole, with about 45 bytes of memory a byte
of the longest one.

Defined cases: null and empty texts count as a text without words; repeated rows
and rows with null ids are each scored; without labels of both classes every
text gets the learned base; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.gbdt import Boosting, Forest, fit
from ledgerloom.llm.samples import weighted
from ledgerloom.llm.scratch import materialize
from ledgerloom.llm.words import mix, shards, spaced, spans, word_hashes

SAMPLE_PER_CLASS = 6000
SHARD_BYTES = 1 << 20

FEATURES = (
    "log_words", "mean_word", "long_words", "short_words", "capital_letters", "digits", "full_stops", "commas", "shouts", "bars", "symbols", "other_signs",
    "non_ascii", "shouted_words", "titled_words", "words_with_signs", "same_as_before", "distinct_words", "distinct_pairs", "top_word", "lines", "words_a_line",
    "repeated_lines", "ended_lines", "brackets", "spread_of_length",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SPACED = spaced()
_LINE = ~_class("\n")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class("0123456789")
_WIDE = np.arange(256) >= 0x80
_SIGNS = ~(_UPPER | _LOWER | _DIGIT | _WIDE) & _SPACED
_COUNTED = (_UPPER, _DIGIT, _class("."), _class(",;:"), _class("!?"), _class("|"), _class("#$%&*@^~+=<>_\\/"), _SIGNS, _WIDE, _class("{}[]()"))


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums from 0; of flags in 32 bits where they fit."""
    out = np.zeros(len(values) + 1, (np.uint32 if len(values) < 1 << 32 else np.int64) if values.dtype == bool else values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = _sums(values)[first]
    return total[1:] - total[:-1]


def _by_word(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = _sums(flags)
    return total[ends] - total[starts]


def _distinct(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row and how often its commonest occurs."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(k)))
    most = np.zeros(rows)
    np.maximum.at(most, r[start], size)
    return np.bincount(r[start], minlength=rows), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text of a shard, in the order of ``FEATURES``."""
    rows = len(offsets) - 1
    starts, ends, first = spans(data, offsets, _SPACED)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    counts = [_by_row(c[data], offsets).astype(float) for c in _COUNTED]
    upper, digit, stops, commas, shouts, bars, symbols, signs, wide, brackets = counts
    chars = np.maximum(_by_row(length, first), 1)
    letters = np.maximum(chars - digit - signs, 1)

    capital, lower, strange = (_by_word(c[data], starts, ends) for c in (_UPPER, _LOWER, _SIGNS))
    shouted = (capital > 1) & (lower == 0)
    titled = _UPPER[data[starts]] & (lower > 0) if len(starts) else np.zeros(0, bool)

    hashed = word_hashes(data, starts, ends)
    same = np.zeros(len(hashed), bool)
    same[1:] = hashed[1:] == hashed[:-1]
    last = np.zeros(len(hashed), bool)
    last[first[:-1][first[:-1] < len(hashed)]] = True
    same &= ~last
    pairs = hashed.copy()
    pairs[1:] = mix(hashed[:-1] * np.uint64(3) + hashed[1:])
    pairs[last] = hashed[last]  # no pair reaches into the text before
    distinct, top = _distinct(hashed, first)
    distinct_pairs, _ = _distinct(pairs, first)

    at, to, line = spans(data, offsets, _LINE)
    lines = np.diff(line).astype(float)
    whole = word_hashes(data, at, to)
    distinct_lines, _ = _distinct(whole, line)
    closed = _class(".!?")[data[to - 1]] if len(to) else np.zeros(0, bool)
    mean = _by_row(length, first) / some
    spread = np.sqrt(np.maximum(_by_row(length**2, first) / some - mean**2, 0))
    columns = [
        np.log1p(words), mean, _by_row(length > 12, first) / some, _by_row(length <= 2, first) / some, upper / letters, digit / chars, stops / some, commas / some, shouts / some,
        bars / some, symbols / some, signs / chars, wide / chars, _by_row(shouted, first) / some, _by_row(titled, first) / some, _by_row(strange > 1, first) / some,
        _by_row(same, first) / some, distinct / some, distinct_pairs / some, top / some, np.log1p(lines), words / np.maximum(lines, 1),
        1 - distinct_lines / np.maximum(lines, 1), _by_row(closed, line) / np.maximum(lines, 1), brackets / some, spread,
    ]
    return np.stack(columns, axis=1).reshape(rows, len(FEATURES))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in shards(batch.column(0), SHARD_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(features(data, offsets).tolist(), pa.list_(pa.float64())), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)], ["x", "label", "weight"])


def train(sample: DataFrame, boosting: Boosting = Boosting(depth=5)) -> Forest:
    """``sample``: text, label (0 or 1), weight if rows stand for others too, bounded."""
    rows = materialize(weighted(sample).mapInArrow(_featurise, "x array<double>, label int, weight double"), "quality-sample").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows.column("label").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order], boosting, rows.column("weight").to_numpy()[order])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in shards(batch.column(1), SHARD_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(features(data, offsets)))], ["id", "score"])

    return run


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row; null and empty texts count as a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(shared), f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
