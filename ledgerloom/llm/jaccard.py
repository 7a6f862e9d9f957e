"""N-gram Jaccard join: a size-aware heavy-light join that is exact.

A set with ``n`` shingles can reach the similarity only with a partner that
shares at least ``o(n) = ceil(t * n)`` of them. With all shingles put in one
global order, rare ones first, two such sets share ``k`` of the first
``n - o(n) + k`` shingles. Sets smaller than a boundary are *light*: they
enumerate the ``SUBSET``-element subsets of that prefix and meet on a whole
subset. Larger sets are *heavy*: the inverted lists of their prefix shingles are
scanned. The boundary is the size at which the estimated cost of both is least.

Documents with equal sets are one *node*, known by a 64-bit hash of its set; where
a second hash shows that unlike sets share one, the second one is used for them.
Inverted lists are sorted and read as streams, never collected. A list of at most ``SHORT`` nodes gives its pairs; a
pair needs as many lists in common as its prefixes must share, so the chance
meetings of unlike documents are dropped by counting. In a longer list nodes of
different components are compared by the parity of hashed shingles (which bounds
the overlap from above, so it loses nothing): first only as many pairs as span
the components, then, when that finds nothing new, every pair left. A group of a
thousand copies never becomes a million pairs. All pairs that pass are verified
on the full sets; no link between different components is lost.

A list is dealt to tasks by its key. The count sketch bounds how long it can be:
lists that may be longer than ``HOT_LIST`` are not dealt by key at all, and long
lists are compared in pairs of blocks of ``LIST_BLOCK`` to ``MOST_BLOCK`` nodes, a
task for each pair, so that more machines shorten even the longest.

The rarity order comes from one row of a count sketch over *all* shingles. A
sketch can only misjudge rarity; any order that all sets share gives the same
links. Shingles are compared by 64-bit hashes.

Defined cases: a null text or one without words has the empty set, ``n = 0``,
and links with nothing; fewer words than the shingle width are one shingle, the
whole sequence; repeated rows, rows with one id and rows with null ids are rows of
their own, which link like any others; very long texts are read whole; an empty
table gives no rows; other columns are ignored, or kept by ``keep_one``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.scratch import free_name, handing_back, materialize, numbered
from ledgerloom.llm.words import mix, shards, signed, spaced, texts_to_hashes

SKETCH_BITS = 20
SKETCH_PARTS = 64
SUBSET = 2
#: Light sets are never larger than this, so that the size histogram stays small.
MAX_LIGHT = 128
#: Ids sent to every task to fetch texts; beyond it the texts are shuffled instead.
BROADCAST_IDS = 1_000_000
BITMAP_BITS = (64, 1 << 16)
BLOCK = 512
#: Nodes of a list whose pairs are enumerated; longer lists are joined by components.
SHORT = 16
#: Lists that may be longer are not gathered by key; long ones are compared in blocks from the first size to the second.
HOT_LIST, LIST_BLOCK, MOST_BLOCK = 4096, 512, 1 << 14
#: Blocks of a list that the block size aims at.
BLOCKS = 64
#: Sets with a node in common that differ: two in 10**10 documents are to be expected.
MOST_CLASHES = 100_000
#: One vote is asked for this many shingles of a set, besides the first.
VOTE_SHARE = 32
#: Rounds at most that join the components left in a list by a spanning forest of pairs,
#: before all pairs of different components that are left are compared.
SPANNING_ROUNDS = 3

_TABLE = spaced()


@dataclass(frozen=True)
class JaccardJoin:
    """What the join found.

    ``members``: row, id, n_shingles, node (``row`` differs for every row). ``links``: node pairs ``a < b`` that were
    verified; their components are those of all links. ``components``:
    node, component (smallest node) for linked nodes.
    """

    members: DataFrame
    links: DataFrame
    components: DataFrame


def shingle_rows(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a shard."""
    words, first = texts_to_hashes(data, offsets, _TABLE)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        grams += words[i : i + len(grams)] * factors[i]
    grams = mix(grams)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield mix((words[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield words[a:a]


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 4n or more buckets, as bytes."""
    low, high = BITMAP_BITS
    bits = min(high, max(low, 1 << int(4 * len(grams) - 1).bit_length()))
    return np.packbits(np.bincount((grams >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1)


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap with fewer buckets, of ``size`` bytes: halves are added modulo two."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def marks_of(grams: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, independent of each other."""
    mixed = mix(grams)
    sums = np.array([mixed.sum(), (mixed * (mixed >> np.uint64(32) | np.uint64(1))).sum()]) + np.uint64(len(grams))
    return tuple(signed(mix(sums)).tolist())


def node_of(grams: np.ndarray, clashing: frozenset[int] = frozenset()) -> int:
    node, check = marks_of(grams)
    return check if node in clashing else node


def _describe(width: int):
    """Row, id, size, both hashes and bitmap of each document, and the task's part of the sketch."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["row", "id", "n", "node", "check", "bits"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for first, last, data, offsets in shards(batch.column(2)):
                n, node, check, bits = [], [], [], []
                for grams in shingle_rows(data, offsets, width):
                    np.add.at(sketch, (grams & np.uint64(len(sketch) - 1)).astype(np.int64), np.uint32(1))
                    n.append(len(grams))
                    marks = marks_of(grams) if len(grams) else (None, None)
                    node.append(marks[0])
                    check.append(marks[1])
                    bits.append(bitmap(grams).tobytes() if len(grams) else None)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in (0, 1)), *(pa.array(v, t) for v, t in zip((n, node, check, bits), types[2:], strict=True))], names)
        parts = np.split(sketch, SKETCH_PARTS)
        if sketch.any():
            none = [None] * SKETCH_PARTS
            columns = [none, none, [-1 - i for i in range(SKETCH_PARTS)], none, none, [p.astype("<u4").tobytes() for p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names)

    return run


def _add_parts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
    for batch in batches:
        for part in batch.column(batch.num_columns - 1).to_pylist():
            total += np.frombuffer(part, np.uint32 if len(part) == 4 * len(total) else np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["n", "part"])


def count_sketch(described: DataFrame) -> np.ndarray:
    """The sketch over all documents: 2**SKETCH_BITS counts, whatever the input's size, added in two steps."""
    parts = described.where("n < 0").select("n", F.pmod(F.xxhash64("bits"), F.lit(SKETCH_PARTS)).alias("share"), "bits")
    parts = parts.groupBy("n", "share").applyInArrow(_add_parts, "n int, part binary").groupBy("n").applyInArrow(_add_parts, "n int, part binary").collect()
    sketch = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint64)
    for row in parts:
        sketch[-1 - row.n] = np.frombuffer(row.part, np.uint64)
    return sketch.reshape(-1)


def votes_needed(n, threshold: Fraction):
    """Shingles that a set must share with a partner within its prefix; the prefix is that much longer."""
    return np.minimum(1 + n // VOTE_SHARE, np.maximum(1, overlap_needed(n, threshold)))


def overlap_needed(n, threshold: Fraction):
    """Shingles a set of ``n`` must share with any partner, at least."""
    return -(-n * threshold.numerator // threshold.denominator)


def choose_boundary(sizes: dict[int, int], sketch: np.ndarray, threshold: Fraction) -> int:
    """The size from which scanning inverted lists is cheaper than subsets.

    A subset costs one posting. A prefix shingle costs one and the entries met
    in its list, whose expected length is the second moment of the sketch over
    the first, less what chance puts in a bucket; frequent shingles stay out of
    prefixes, so buckets over eight times the mean do not count.
    """
    cold = sketch[sketch <= 8 * max(1.0, sketch.mean())].astype(float)
    mass = max(1.0, cold.sum())
    met = 1 + max(0.0, (cold**2).sum() / mass - mass / len(sketch) - 1)
    best, least = 1, None
    for x in range(1, MAX_LIGHT + 1):
        cost = 0.0
        for n, count in sizes.items():
            prefix = n - overlap_needed(n, threshold)
            if n < x:
                cost += count * (prefix + SUBSET) * (prefix + SUBSET - 1) / 2
            if n >= overlap_needed(x, threshold):
                cost += count * (prefix + int(votes_needed(n, threshold))) * (met if n >= x else 1)
        if least is None or cost < least:
            best, least = x, cost
    return best


def keys_of(grams: np.ndarray, sketch: np.ndarray, boundary: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The list keys of a set and how long their lists can be: subsets if it is light, shingles if it can meet a heavy set.

    A set that may share a single shingle with its partner has all its shingles as keys too.
    """
    n = len(grams)
    least = overlap_needed(n, threshold)
    counts = sketch[(grams & np.uint64(len(sketch) - 1)).astype(np.int64)]
    order = np.argsort(counts, kind="stable")
    keys, most = [], []
    if n < boundary and n >= SUBSET:
        rare = order[: n - max(least, SUBSET) + SUBSET]
        i, j = np.triu_indices(len(rare), 1)
        a, b = grams[rare[i]], grams[rare[j]]
        keys.append(mix(mix(np.minimum(a, b)) * np.uint64(3) + np.maximum(a, b)))
        most.append(counts[rare[i]])  # the rarer of the two
    single = n if least < SUBSET else n - least + int(votes_needed(n, threshold)) if n >= overlap_needed(boundary, threshold) else 0
    if single:
        keys.append(grams[order[:single]])
        most.append(counts[order[:single]])
    return (np.concatenate(keys), np.concatenate(most)) if keys else (grams[:0], counts[:0])


def _postings(width: int, sketch, boundary: int, threshold: Fraction, clashing: frozenset[int]):
    """(key, n, node, hot) of each distinct set that a task meets; ``hot``: the list may be longer than HOT_LIST."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for batch in batches:
            for _, _, data, offsets in shards(batch.column(0)):
                keys, most, sizes, nodes = [], [], [], []
                for grams in shingle_rows(data, offsets, width):
                    if len(grams) and (len(grams) > 1 or 2 * threshold <= 1) and (node := node_of(grams, clashing)) not in seen:
                        seen.add(node)
                        own, longest = keys_of(grams, counts, boundary, threshold)
                        keys.append(own)
                        most.append(longest)
                        sizes.append(len(grams))
                        nodes.append(node)
                if len(seen) > 1_000_000:  # only saves repeats; lists drop them too
                    seen.clear()
                if keys:
                    repeats = [len(k) for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(np.concatenate(keys))), pa.array(np.repeat(np.array(sizes, np.int32), repeats)), pa.array(np.repeat(np.array(nodes, np.int64), repeats)), pa.array(np.concatenate(most) > HOT_LIST)],
                        ["key", "n", "node", "hot"],
                    )

    return run


def _lists(boundary: int, threshold: Fraction):
    """Reads postings sorted by key, size and node, and drops lists of one node.

    A list of at most SHORT nodes gives its pairs whose sizes fit, ``(a, b)`` with
    the votes they need in all; a longer one gives its rows, ``b`` null. Memory is
    constant: at most SHORT rows are held over to the next batch.
    """

    def pairs(key, n, node):
        for step in range(1, SHORT):
            if step >= len(key):
                break
            at = np.flatnonzero(key[step:] == key[:-step])
            a, b = n[at].astype(np.int64), n[at + step].astype(np.int64)
            fits = a >= overlap_needed(b, threshold)
            at, a, b = at[fits], a[fits], b[fits]
            yield node[at], node[at + step], np.where((b < boundary) | (overlap_needed(a, threshold) < SUBSET), 1, np.minimum(votes_needed(a, threshold), votes_needed(b, threshold)))

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        long_key, last = None, None

        def emit(key, n, node, final):
            nonlocal long_key
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(key)))
            long = size > SHORT
            if len(start) and long_key is not None and key[0] == long_key:
                long[0] = True
            stop = len(key) if final or not len(start) or long[-1] else start[-1]
            long_key = key[-1] if len(start) and long[-1] else None
            rows = np.repeat(long, size)
            cols = [[key[:stop][rows[:stop]]], [node[:stop][rows[:stop]]], [n[:stop][rows[:stop]].astype(np.int64)]]
            short = ~rows[:stop]
            found = list(pairs(key[:stop][short], n[:stop][short], node[:stop][short]))
            a, b, need = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            total, wide = len(cols[0][0]), len(a)
            none = np.zeros(total + wide, bool)
            none[total:] = True
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([cols[0][0], a]), mask=none), pa.array(np.concatenate([cols[2][0], need]).astype(np.int32)),
                    pa.array(np.concatenate([cols[1][0], a])), pa.array(np.concatenate([cols[1][0], b]), mask=~none),
                ],
                ["key", "n", "a", "b"],
            )
            return out, (key[stop:], n[stop:], node[stop:])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            fresh = np.ones(len(cols[0]), bool)  # not a node that another task sent too
            fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1])
            fresh[0] = last is None or (cols[0][0], cols[2][0]) != last
            last = (cols[0][-1], cols[2][-1])
            out, held = emit(*(np.concatenate([h, c[fresh]]) for h, c in zip(held, cols, strict=True)), False)
            if out.num_rows:
                yield out
        out, _ = emit(*held, True)
        if out.num_rows:
            yield out

    return run


def bits_differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def spare(n: np.ndarray, m: np.ndarray, differ: np.ndarray, threshold: Fraction) -> np.ndarray:
    """How far the symmetric difference, ``differ`` at least, stays within the similarity; negative if it cannot."""
    p, q = threshold.numerator, threshold.denominator
    return np.where(np.minimum(n, m) * q >= np.maximum(n, m) * p, (n + m) * (q - p) - differ * (p + q), -1)


def _screen(threshold: Fraction):
    """Drops pairs whose bitmaps already show too many different shingles."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            differ = np.empty(len(a), np.int64)
            for i, (u, v) in enumerate(zip(x, y, strict=True)):
                u, v = np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)
                differ[i] = bits_differ(fold(u, len(v)), fold(v, len(u)))
            keep = spare(n.astype(np.int64), m.astype(np.int64), differ, threshold) >= 0
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


class _Merged:
    """Labels of one list that candidate pairs have joined."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y

    def relabel(self, labels: np.ndarray) -> np.ndarray:
        return np.array([self.find(x) for x in labels.tolist()], np.int64)


def _across(threshold: Fraction, spanning: bool):
    """Pairs of one list, or of two blocks of it, that lie in different components and pass the bitmaps.

    Rows come sorted by group (``key``) and size, so a node meets only the nodes
    of its group that are not too small: a window, held in blocks of bitmaps.
    ``side`` is -1 in a group of one block, else 0 or 1, and sides meet. With ``spanning``
    a pair is given only if no earlier pairs of its list join its components: at
    most one pair a node, however many pass.
    """

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[list] = []
        current, merged = None, _Merged()
        for batch in batches:
            key = batch.column(0).to_numpy()
            n = batch.column(1).to_numpy().astype(np.int64)
            node, label = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            bits, side = batch.column(4).to_pylist(), batch.column(5).to_numpy()
            size = np.array([len(x) for x in bits], np.int64)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (size[1:] != size[:-1])) + 1
            edges = np.unique(np.concatenate([[0], cuts, np.arange(0, len(key), BLOCK), [len(key)]]))
            left, right = [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if current != key[lo]:
                    window, current, merged = [], key[lo], _Merged()
                own = label[lo:hi]
                block = [n[lo:hi], node[lo:hi], merged.relabel(own) if merged.parent else own, np.frombuffer(b"".join(bits[lo:hi]), np.uint8).reshape(hi - lo, -1), side[lo:hi]]
                window = [w for w in window if w[0][-1] >= overlap_needed(int(block[0][0]), threshold)]
                window.append(block)
                for k, other in enumerate(window):
                    apart = (other[2][:, None] != block[2][None, :]) & ((other[4][:, None] != block[4][None, :]) | (block[4][None, :] < 0))
                    if k == len(window) - 1:
                        apart = np.triu(apart, 1)
                    i, j = np.nonzero(apart)
                    width = min(other[3].shape[1], block[3].shape[1])
                    x, y = fold(other[3], width), fold(block[3], width)
                    step = max(256, (1 << 22) // width)
                    good, room = [], []
                    for at in range(0, len(i), step):
                        p, q = i[at : at + step], j[at : at + step]
                        slack = spare(other[0][p], block[0][q], bits_differ(x[p], y[q]), threshold)
                        good.append(at + np.flatnonzero(slack >= 0))
                        room.append(slack[slack >= 0])
                    if not sum(map(len, good)):
                        continue
                    good = np.concatenate(good)
                    if spanning:  # the surest pairs first, so that a near miss stands in the way of few
                        good = good[np.argsort(-np.concatenate(room), kind="stable")]
                        keep = np.array([merged.join(u, v) for u, v in zip(other[2][i[good]].tolist(), block[2][j[good]].tolist(), strict=True)])
                        good = good[keep]
                        for w in window:
                            w[2] = merged.relabel(w[2])
                    left.append(other[1][i[good]])
                    right.append(block[1][j[good]])
            if left and sum(map(len, left)):
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _sets(width: int):
    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0)
            for first, last, data, offsets in shards(batch.column(1)):
                grams = [signed(g) for g in shingle_rows(data, offsets, width)]
                lengths = np.cumsum([0, *map(len, grams)])
                yield pa.RecordBatch.from_arrays([nodes.slice(first, last - first), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(grams)))], ["node", "grams"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """The pairs whose full sets reach the threshold; sets are made anew from the texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps.select("node", "row"), "node")
    wanted = materialize(wanted.select("node", "row"), "wanted")
    rows = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = materialize(docs.join(rows, "row").select("node", "text").mapInArrow(_sets(width), "node long, grams array<long>"), "sets")
    p, q = threshold.numerator, threshold.denominator
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
        .where(shared * (p + q) >= (F.size("x") + F.size("y")) * p)
        .select("a", "b")
    )


def _representatives(described: DataFrame) -> DataFrame:
    """One document for each node, and the least and greatest second hash of the node's sets."""
    firsts = (F.first(c).alias(c) for c in ("n", "bits"))
    return materialize(described.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), *firsts, F.min("check").alias("lo"), F.max("check").alias("hi")), "reps")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Rows of long lists (with the list's ``total``) dealt to pairs of blocks: ``key`` (of the pair), n, node, label, bits, side."""
    size = F.greatest(F.lit(LIST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("total") / BLOCKS)))
    dealt = nodes.withColumn("blocks", F.ceil(F.col("total") / size).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(pair.alias("key"), "n", "node", "label", "bits", side.alias("side"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: str = "0.8") -> JaccardJoin:
    """Link documents whose ``width``-word shingle sets reach the Jaccard ``similarity``.

    Words are runs of characters other than ASCII white space, A-Z read as a-z.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return join_rows(numbered(rows, "row", "jaccard-rows"), width, similarity)


def join_rows(docs: DataFrame, width: int, similarity: str) -> JaccardJoin:
    """The join over a written table ``row, id, text``."""
    threshold = Fraction(similarity)
    if not 0 < threshold <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    described = materialize(docs.select("row", "id", "text").mapInArrow(_describe(width), "row long, id long, n int, node long, check long, bits binary"), "described")
    reps = _representatives(described)
    clashing = frozenset(r.node for r in reps.where("lo <> hi").select("node").limit(MOST_CLASHES + 1).collect())
    if len(clashing) > MOST_CLASHES:
        raise RuntimeError("too many sets share their 64-bit hash")
    if clashing:
        described = described.withColumn("node", F.when(F.col("node").isin(*clashing), F.col("check")).otherwise(F.col("node")))
        reps = _representatives(described)
    members = described.where("n >= 0").select("row", "id", F.col("n").cast("long").alias("n_shingles"), "node")

    sketch = count_sketch(described)
    sizes = {r.n: r["count"] for r in reps.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, sketch, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = docs.select("text").mapInArrow(_postings(width, shared, boundary, threshold, clashing), "key long, n int, node long, hot boolean")
    postings = materialize(postings, "postings")
    lists = postings.where("not hot").select("key", "n", "node").repartition(partitions, "key").sortWithinPartitions("key", "n", "node")
    lists = materialize(lists.mapInArrow(_lists(boundary, threshold), "key long, n int, a long, b long"), "lists")
    hot_lists = postings.where("hot").select("key", "n", "node").distinct()

    traits = reps.select("node", "n", "bits")
    voted = lists.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("votes"), F.min("n").alias("need")).where("votes >= need")
    voted = voted.join(traits.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x")), "a").join(traits.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    voted = materialize(voted.select("a", "b", "n", "m", "x", "y").mapInArrow(_screen(threshold), "a long, b long"), "voted")
    links = materialize(_verified(voted, docs, reps, width, threshold), "links").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    long_lists = lists.where("b is null").select("key", "n", F.col("a").alias("node")).unionByName(hot_lists)
    spanning, rounds = True, 0
    while True:
        labels = materialize(connected_components(links), "labels")
        nodes = long_lists.join(labels, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("label"))
        split = nodes.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("total")).where("lo <> hi").select("key", "total")
        dealt = _in_blocks(nodes.join(split, "key").join(traits.select("node", "bits"), "node"))
        dealt = dealt.repartition(partitions, "key").sortWithinPartitions("key", "n", "node")
        pairs = materialize(dealt.mapInArrow(_across(threshold, spanning), "a long, b long").distinct(), "across")
        found = pairs if pairs.isEmpty() else materialize(_verified(pairs, docs, reps, width, threshold), "links")
        empty = found.isEmpty()
        links, rounds = links.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), rounds + 1
        if not spanning or pairs.isEmpty():
            break
        spanning = not empty and rounds < SPANNING_ROUNDS
    components = labels if empty else materialize(connected_components(links), "components")
    return JaccardJoin(members, links, components)


def classes(joined: JaccardJoin) -> DataFrame:
    """One row per document: ``row, id, n_shingles, node, component_id, n_copies``.

    ``component_id`` is the smallest id reachable by links, the document itself
    included (null if no id is known); ``n_copies`` counts the documents with the same set.
    """
    copies = joined.members.where("node is not null").groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"))
    copies = copies.join(joined.components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = copies.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = copies.join(least, "component").select("node", "component_id", "n_copies")
    columns = ["row", "id", "n_shingles", "node", "component_id", "n_copies"]
    alone = joined.members.where("node is null").select("row", "id", "n_shingles", "node", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    return joined.members.where("node is not null").join(named, "node").select(*columns).unionByName(alone.select(*columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: str = "0.8") -> DataFrame:
    """``docs`` with one row of each linked group: the one with the smallest id, and of equal ids the first read.

    Rows without words are linked with nothing and stay. The numbers of the rows
    that go are sent to all tasks if they are few, and joined by a shuffle otherwise.
    """
    row = free_name(docs.columns, "_row")
    rows = numbered(docs, row, "jaccard-rows")
    joined = join_rows(rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), width, similarity)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = joined.members.where("node is not null").groupBy("node").agg(F.min(order).alias("first"))
    first = first.join(joined.components, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    stay = materialize(first.select(F.col("first.row").alias("row")), "stay")
    gone = joined.members.where("node is not null").select("row").join(stay, "row", "left_anti")
    gone = materialize(gone.select(F.col("row").alias(row)), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, row, "left_anti").select(*docs.columns)
