"""Benchmark decontamination with suffix arrays over the training text.

The training text is read in shards of a megabyte. Each shard gets a suffix
array over its words, and every suffix of every benchmark item is looked up in
it by binary search. A window (``window`` words of an item, or the whole item if
it is shorter) that occurs in a document marks the document's words as hit.

The suffix array is sparse: a training suffix whose first words (up to three)
occur nowhere in the benchmark cannot begin with a window, so it is left out.
Words are compared by 64-bit hashes, whole windows at a time.

The benchmark is sent to the tasks in blocks of a bounded number of words, one
after the other. With one block, the usual case, the documents are read once and
nothing is shuffled; with more, rows are numbered in a written table and the hit
words of a row are united afterwards, which gives the same answer.

Defined cases: a null text has no words and is clean; an item without words
matches nothing; a null item id is dropped; repeated documents and documents
with a null id are each judged by themselves; ties for the longest match go to
the smaller item, then to the earlier word; a very long text is one row of a
shard; an empty benchmark leaves every document clean; an empty table gives no
rows; other columns are ignored, or kept by ``drop_contaminated``, whatever
their names. A single item must fit a task, as any row must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import free_name, handing_back, materialize, numbered
from ledgerloom.llm.words import alphanumeric, mix, shards, texts_to_hashes

#: Words of the benchmark that a task holds at a time.
BLOCK_WORDS = 4_000_000
#: Bytes of training text that get a suffix array at a time; where every word can match, the arrays take some 60 times as much.
SHARD_BYTES = 1 << 20
PREFIX = 3
#: Buckets in which the filter looks first.
MARKS = 1 << 20
#: Occurrences expanded, and suffixes searched or given their heads, at a time.
EXPAND = 1 << 17
SEARCHED = 1 << 15
_TABLE = alphanumeric()

REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<long>, longest_words long, longest_item long, longest_at long"


@dataclass(frozen=True)
class Suffixes:
    """The item suffixes that begin with a window, as places in the items joined end to end."""

    words: np.ndarray  # word hashes of all items, a zero after each
    start: np.ndarray  # first word of the window
    lengths: np.ndarray  # words of the window
    item: np.ndarray  # item id
    window: int
    prefix: int  # first words that the filter compares
    known: np.ndarray  # sorted hashes of those
    slot: np.ndarray  # which of them a suffix has
    marks: np.ndarray  # the buckets that they fall into

    @staticmethod
    def of(ids: np.ndarray, words: list[np.ndarray], window: int) -> Suffixes:
        count = np.array([len(w) for w in words], np.int64)
        size = np.minimum(count, window)
        own = np.where(count, count - size + 1, 0)
        base = np.cumsum(count + 1) - count - 1
        rank = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        start, lengths = np.repeat(base, own) + rank, np.repeat(size, own)
        joined_up = np.concatenate([x for w in words for x in (w, np.zeros(1, np.uint64))]) if words else np.zeros(0, np.uint64)
        prefix = min(PREFIX, int(lengths.min(initial=PREFIX)))
        known, slot = np.unique(prefix_hashes(joined_up, start, prefix), return_inverse=True)
        marks = np.zeros(MARKS, bool)
        marks[(known & np.uint64(MARKS - 1)).astype(np.int64)] = True
        return Suffixes(joined_up, start.astype(np.int32), lengths.astype(np.int16), np.repeat(np.asarray(ids, np.int64), own), window, prefix, known, slot.astype(np.int32), marks)

    def heads(self, rows: np.ndarray) -> np.ndarray:
        """The windows of these suffixes, zero past the end of a short item."""
        at = np.arange(self.window)
        index = np.minimum(self.start[rows].astype(np.int64)[:, None] + at, len(self.words) - 1)
        return np.where(at < self.lengths[rows][:, None], self.words[index], np.uint64(0))


def prefix_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """One hash for the ``n`` words from each place on."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = mix(out + words[at + i])
    return out


def suffix_array(words: np.ndarray, ends: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted starts of the training suffixes that can match, their first words, and the item suffixes that can.

    ``ends``: where the document of each word ends.
    """
    n, window = suffixes.prefix, suffixes.window
    if len(words) < n or not len(suffixes.known):
        return np.zeros(0, np.int64), np.zeros((0, window), np.uint64), np.zeros(0, np.int64)
    key = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        key = mix(key + words[i : len(words) - n + 1 + i])
    at = np.flatnonzero(suffixes.marks[(key & np.uint64(MARKS - 1)).astype(np.int64)])
    found = np.minimum(np.searchsorted(suffixes.known, key[at]), len(suffixes.known) - 1)
    kept = (suffixes.known[found] == key[at]) & (at + n <= ends[at])
    at, present = at[kept], np.zeros(len(suffixes.known), bool)
    present[found[kept]] = True
    heads = np.empty((len(at), window), np.uint64)
    for lo in range(0, len(at), SEARCHED):
        some = at[lo : lo + SEARCHED]
        index = some[:, None] + np.arange(window)
        heads[lo : lo + SEARCHED] = np.where(index < ends[some][:, None], words[np.minimum(index, len(words) - 1)], np.uint64(0))
    order = np.lexsort(heads.T[::-1])
    return at[order], heads[order], np.flatnonzero(present[suffixes.slot])


def _before(heads: np.ndarray, rows: np.ndarray, wanted: np.ndarray, lengths: np.ndarray, equal_too: bool) -> np.ndarray:
    """Whether each suffix head sorts before the wanted window (or starts with it)."""
    own = heads[rows]
    differs = own != wanted
    differs &= np.arange(own.shape[1]) < lengths[:, None]
    first = differs.argmax(axis=1)
    line = np.arange(len(own))
    return np.where(differs[line, first], own[line, first] < wanted[line, first], equal_too)


def search(heads: np.ndarray, suffixes: Suffixes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the ``wanted`` item suffixes: the range of training suffixes that begin with the window."""
    bounds = []
    own, lengths = suffixes.heads(wanted), suffixes.lengths[wanted].astype(np.int64)
    for equal_too in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(heads), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            right = _before(heads, middle, own[open_], lengths[open_], equal_too)
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
        bounds.append(low)
    return bounds[0], bounds[1]


def _expand(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffix, entry of the suffix array) for all entries in the ranges, some at a time."""
    hit = np.flatnonzero(high > low)
    total = np.concatenate([[0], np.cumsum((high - low)[hit])])
    i = 0
    while i < len(hit):
        j = max(i + 1, int(np.searchsorted(total, total[i] + EXPAND, "right")) - 1)
        count = (high - low)[hit[i:j]]
        which = np.repeat(hit[i:j], count)
        yield which, np.repeat(low[hit[i:j]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        i = j


def matches(words: np.ndarray, first: np.ndarray, suffixes: Suffixes):
    """Of a shard: hit words, (document, item) pairs, and each document's longest match.

    The longest match is (words, item, first word in the document); matches on
    one diagonal that overlap or touch end to end are one verbatim match.
    """
    docs = len(first) - 1
    owner = np.repeat(np.arange(docs), np.diff(first))
    hits = np.zeros(len(words) + 1, np.int64)
    pairs, longest = set(), {}
    starts, heads, able = suffix_array(words, first[1:][owner], suffixes)
    if len(starts):
        seen = []
        for lo in range(0, len(able), SEARCHED):
            wanted = able[lo : lo + SEARCHED]
            for row, entry in _expand(*search(heads, suffixes, wanted)):
                which, at = wanted[row], starts[entry]
                length, item = suffixes.lengths[which].astype(np.int64), suffixes.item[which]
                hits += np.bincount(at, minlength=len(hits)) - np.bincount(at + length, minlength=len(hits))
                code = np.unique(np.stack([owner[at], item], axis=1), axis=0)
                pairs.update(map(tuple, code.tolist()))
                seen.append(np.stack([at - suffixes.start[which], at, length, item, owner[at]]))
        if seen:
            line = np.concatenate(seen, axis=1)
            line = line[:, np.lexsort((line[1], line[0], line[4]))]
            new = np.ones(line.shape[1], bool)
            new[1:] = (line[0, 1:] != line[0, :-1]) | (line[4, 1:] != line[4, :-1]) | (line[1, 1:] != line[1, :-1] + 1)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], line.shape[1]) - 1
            size = line[1, end] + line[2, end] - line[1, begin]
            for doc, length, item, at in zip(line[4, begin].tolist(), size.tolist(), line[3, begin].tolist(), line[1, begin].tolist(), strict=True):
                best = (length, -item, -(at - int(first[doc])))
                longest[doc] = max(longest.get(doc, best), best)
    return np.cumsum(hits[:-1]) > 0, pairs, longest


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _verdict(n_hit: int, n_words: int, share: int) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def _shard_facts(column: pa.Array, suffixes: Suffixes):
    """For each run of rows: its bounds and, by row, words, hit words, items, longest match, hit spans."""
    for lo, hi, data, offsets in shards(column, SHARD_BYTES):
        words, first = texts_to_hashes(data, offsets, _TABLE)
        hit, pairs, longest = matches(words, first, suffixes)
        total = np.concatenate([[0], np.cumsum(hit)])[first]
        items: dict[int, list[int]] = {}
        for doc, item in pairs:
            items.setdefault(doc, []).append(item)
        yield lo, hi, np.diff(first), np.diff(total), items, longest, hit, first


def _report(blocks, share: int, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = blocks.value
        for batch in batches:
            for lo, hi, words, hits, items, longest, hit, first in _shard_facts(batch.column(1), suffixes):
                found = [sorted(items.get(i, [])) for i in range(hi - lo)]
                best = [longest.get(i) for i in range(hi - lo)]
                cols = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(words, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([digest(x) for x in found]),
                    pa.array([_verdict(h, w, share) for h, w in zip(hits.tolist(), words.tolist(), strict=True)]),
                    pa.array(found, pa.list_(pa.int64())),
                    pa.array([b and b[0] for b in best], pa.int64()),
                    pa.array([b and -b[1] for b in best], pa.int64()),
                    pa.array([b and -b[2] for b in best], pa.int64()),
                ]
                names = ["id", *(x.split()[0] for x in REPORT.split(", "))]
                if spans:
                    cols.append(pa.array([np.flatnonzero(hit[a:b]).tolist() for a, b in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.int64())))
                    names.append("hit_words")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> tuple[int, Callable[[int], Suffixes]]:
    """How many blocks the benchmark has, and what makes each: about BLOCK_WORDS words, whole items."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-size // (4 * BLOCK_WORDS)))

    def block(k: int) -> Suffixes:
        own = items if count == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(count)) == k)
        rows, words = own.orderBy("id", "text").toArrow(), []
        for chunk in rows.combine_chunks().to_batches():
            for _, _, data, offsets in shards(chunk.column(1)):
                hashed, first = texts_to_hashes(data, offsets, _TABLE)
                words += [hashed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        return Suffixes.of(rows.column(0).to_numpy(), words, window)

    return count, block


def _in_blocks(rows: DataFrame, count: int, block: Callable[[int], Suffixes], share: int) -> DataFrame:
    """The report of ``row, text`` over several blocks; ``row`` differs for every row."""
    context, united = rows.sparkSession.sparkContext, None
    for k in range(count):
        sent = context.broadcast(block(k))
        part = materialize(rows.mapInArrow(_report(sent, share, True), f"id long, {REPORT}, hit_words array<long>"), "hits")
        sent.unpersist()
        united = part if united is None else united.unionByName(part)
    best = F.max(F.when(F.col("longest_words").isNotNull(), F.struct("longest_words", (-F.col("longest_item")).alias("i"), (-F.col("longest_at")).alias("a"))))
    merged = united.groupBy("id").agg(F.first("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("hit_words")))).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), best.alias("best"))
    return merged.select(
        "id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "item_ids",
        F.col("best.longest_words").alias("longest_words"), (-F.col("best.i")).alias("longest_item"), (-F.col("best.a")).alias("longest_at"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A report row per document: how much of it the benchmark's windows cover.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z read as
    a-z. ``contaminated``: some word is hit and at least one in ``share`` is.
    ``longest_words``, ``longest_item`` and ``longest_at`` give the longest
    verbatim match, its item and its first word in the document.
    """
    count, block = _blocks(benchmark, item_col, item_text_col, window)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if count == 1:
        sent = docs.sparkSession.sparkContext.broadcast(block(0))
        return rows.mapInArrow(_report(sent, share, False), f"id {rows.schema['id'].dataType.simpleString()}, {REPORT}").withColumnRenamed("id", id_col)
    rows = numbered(rows, "row", "decontam-rows")
    report = _in_blocks(rows.select(F.col("row").alias("id"), "text"), count, block, share).withColumnRenamed("id", "row")
    return rows.select("row", F.col("id").alias(id_col)).join(report, "row").drop("row")


def _filter(blocks, share: int, at: int):
    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = blocks.value
        for batch in batches:
            for lo, hi, words, hits, *_ in _shard_facts(batch.column(at), suffixes):
                clean = [not _verdict(h, w, share) for h, w in zip(hits.tolist(), words.tolist(), strict=True)]
                yield batch.slice(lo, hi - lo).filter(pa.array(clean))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; nothing is shuffled if the benchmark is one block."""
    count, block = _blocks(benchmark, item_col, item_text_col, window)
    if count == 1:
        sent = docs.sparkSession.sparkContext.broadcast(block(0))
        return docs.mapInArrow(_filter(sent, share, docs.columns.index(text_col)), docs.schema)
    row = free_name(docs.columns, "_row")
    rows = numbered(docs, row, "decontam-rows")
    bad = _in_blocks(rows.select(F.col(row).alias("id"), F.col(text_col).alias("text")), count, block, share).where("contaminated")
    return rows.join(bad.select(F.col("id").alias(row)), row, "left_anti").select(*docs.columns)
