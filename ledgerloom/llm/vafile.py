"""Exact top-k search by inner product with a vector-approximation file.

The file holds a byte for each component of each vector: the number of its cell.
It is cut into blocks of some thousand vectors; a block has its own cells, at
quantiles of its own components, and knows the least and greatest component that
fell into each. From these a query gets a lower and an upper bound of its score
with every vector of a block in four matrix products, without the vectors.

1. Queries in blocks scan the file. A vector stays only while fewer than k others
   are certain to come before it.
2. What stays is ordered by its upper bound, and exact vectors are read in that
   order, in rounds of growing size, until the k-th best score read so far
   beats the bounds of all that are left.

Equal vectors are one class, searched once; a class remembers as many of its
smallest ids as a result can hold. A task holds one block of queries and a bounded number of
blocks of the file. Nothing is fitted on the driver, which sees only counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import discard, materialize
from ledgerloom.llm.vectors import distinct_vectors, ids, inner, integer_rows, matrix, merged_members

#: Bits of a cell number: up to 2**BITS cells for each component and block.
BITS = 6
#: Vectors in a block of the file, and queries in a block of queries.
FILE_ROWS = 8192
QUERY_ROWS = 512
#: Blocks of the file that one task scans with one block of queries, at most.
SCAN_BLOCKS = 64
#: The first round reads so many times k vectors; each further round four times as many.
FIRST_ROUND = 2

_FILE = "block long, width long, n long, ids binary, first binary, cells binary, low binary, high binary"
_QUERY = "qblock long, width long, ids binary, v binary"


def _blocks(rows: int, make):
    """Packs the rows of a partition, by width, into blocks that ``make`` turns into one output row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, waiting = TaskContext.get().partitionId() << 33, {}

        def flush(width):
            nonlocal at
            table = pa.Table.from_batches(waiting.pop(width)[1])
            at += 1
            return make(at, width, table)

        for batch in batches:
            widths = batch.column("v").value_lengths().to_numpy()
            for width in np.unique(widths):
                part, lo = batch.filter(pa.array(widths == width)), 0
                while lo < part.num_rows:
                    held = waiting.setdefault(int(width), [0, []])
                    piece = part.slice(lo, rows - held[0])
                    held[0] += piece.num_rows
                    held[1].append(piece)
                    lo += piece.num_rows
                    if held[0] == rows:
                        yield flush(int(width))
            if len(waiting) > 64:  # many widths: no more than 64 blocks are open
                yield flush(max(waiting, key=lambda w: waiting[w][0]))
        for width in list(waiting):
            yield flush(width)

    return run


def _one(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values])


def approximate(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers, and the least and greatest component in each cell (components by cells)."""
    n, width = x.shape
    most = 1 << bits
    cells = np.zeros((n, width), np.uint8)
    low, high = np.zeros((width, most)), np.zeros((width, most))
    for d in range(width):
        edges = np.unique(np.quantile(x[:, d], np.arange(1, most) / most, method="lower"))
        own = np.searchsorted(edges, x[:, d], "left")
        low[d], high[d] = np.inf, -np.inf
        np.minimum.at(low[d], own, x[:, d])
        np.maximum.at(high[d], own, x[:, d])
        cells[:, d] = own
    empty = low > high
    low[empty] = high[empty] = 0
    return cells, low, high


def _file_block(bits: int):
    def make(block: int, width: int, table: pa.Table) -> pa.RecordBatch:
        cells, low, high = approximate(matrix(table.column("v"), width), bits)
        return _one(block=block, width=width, n=len(cells), ids=ids(table.column("class_id")).tobytes(), first=ids(table.column("first_id")).tobytes(), cells=cells.tobytes(), low=low.tobytes(), high=high.tobytes())

    return make


def _query_block(block: int, width: int, table: pa.Table) -> pa.RecordBatch:
    return _one(qblock=block, width=width, ids=ids(table.column("class_id")).tobytes(), v=matrix(table.column("v"), width).tobytes())


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products (queries by vectors)."""
    every = np.arange(cells.shape[1])
    least, greatest = low[every, cells].T, high[every, cells].T
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return plus @ least + minus @ greatest, plus @ greatest + minus @ least


def still_open(lower: np.ndarray, upper: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Which vectors fewer than ``k`` others are certain to precede (higher score, then smaller id)."""
    if len(lower) <= k:
        return np.ones(len(lower), bool)
    likely = np.flatnonzero(lower >= np.partition(lower, len(lower) - k)[len(lower) - k])
    last = likely[np.lexsort((first[likely], -lower[likely]))[k - 1]]
    return (upper > lower[last]) | (upper == lower[last]) & (first <= first[last])


def _scan(k: int, bits: int):
    """For a block of queries and blocks of the file: the vectors that stay, with their bounds."""

    def run(queries: pa.Table, file: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for q in queries.to_pylist():
            width, own = q["width"], np.frombuffer(q["ids"], np.int64)
            x = np.frombuffer(q["v"], np.float64).reshape(len(own), width)
            for lo in range(0, len(own), 128):
                part = x[lo : lo + 128]
                kept = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)] for _ in part]
                floor = np.full(len(part), -np.inf)
                for i in range(file.num_rows):
                    block = {c: file.column(c)[i].as_py() for c in ("n", "ids", "first", "cells", "low", "high")}
                    cells = np.frombuffer(block["cells"], np.uint8).reshape(block["n"], width)
                    low, high = (np.frombuffer(block[c], np.float64).reshape(width, 1 << bits) for c in ("low", "high"))
                    names, first = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["first"], np.int64)
                    lower, upper = bounds(part, cells, low, high)
                    for j in range(len(part)):
                        near = np.flatnonzero(upper[j] >= floor[j])
                        if not len(near):
                            continue
                        grown = [np.concatenate(p) for p in zip(kept[j], (names[near], first[near], lower[j, near], upper[j, near]), strict=True)]
                        stay = still_open(grown[2], grown[3], grown[1], k)
                        kept[j] = [g[stay] for g in grown]
                        if len(kept[j][2]) >= k:
                            floor[j] = np.partition(kept[j][2], len(kept[j][2]) - k)[len(kept[j][2]) - k]
                for name, held in zip(own[lo : lo + 128], kept, strict=True):
                    out[0].append(np.full(len(held[0]), name))
                    for column, values in zip(out[1:], held, strict=True):
                        column.append(values.astype(np.int64))
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["query", "class_id", "first_id", "lower", "upper"])

    return run


def _order(*columns: str):
    return Window.partitionBy("query").orderBy(*(F.desc(c) if c in ("lower", "upper", "score") else F.col(c) for c in columns))


def _beaten(rows: DataFrame, k: int, by: str, marks: DataFrame) -> DataFrame:
    """Rows of ``rows`` that can still be among the first ``k``: ``marks`` has scores (or lower bounds) ``by`` that are reached."""
    kth = marks.withColumn("place", F.row_number().over(_order(by, "first_id", "class_id"))).where(F.col("place") <= k).where(F.col("place") == k)
    kth = kth.select("query", F.col(by).alias("_score"), F.col("first_id").alias("_first"))
    able = F.col("_score").isNull() | (F.col("upper") > F.col("_score")) | ((F.col("upper") == F.col("_score")) & (F.col("first_id") <= F.col("_first")))
    return rows.join(kth, "query", "left").where(able).drop("_score", "_first")


def candidates(classes: DataFrame, wanted: DataFrame, k: int, bits: int = BITS, file_rows: int = FILE_ROWS, query_rows: int = QUERY_ROWS, scan_blocks: int = SCAN_BLOCKS) -> DataFrame:
    """``query, class_id, first_id, lower, upper``: what the bounds leave for each class of ``wanted``."""
    file = materialize(classes.select("class_id", "first_id", "v").mapInArrow(_blocks(file_rows, _file_block(bits)), _FILE), "approximations")
    asked = materialize(wanted.select("class_id", "v").mapInArrow(_blocks(query_rows, _query_block), _QUERY), "query_blocks")
    n_file, n_asked = file.count(), asked.count()
    cores = classes.sparkSession.sparkContext.defaultParallelism
    each = max(1, min(scan_blocks, n_file * n_asked // (2 * cores)))
    file = file.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-n_file // each)))))
    keys = materialize(asked.select("qblock", "width").join(file.select("run", "width").distinct(), "width"), "scan_keys")
    queries = asked.join(keys, ["qblock", "width"])
    blocks = file.join(keys, ["run", "width"]).select(*file.columns, F.col("qblock").alias("to"), F.col("run").alias("of"))
    scanned = queries.groupBy("qblock", "run").cogroup(blocks.groupBy("to", "of")).applyInArrow(_scan(k, bits), "query long, class_id long, first_id long, lower long, upper long")
    scanned = materialize(scanned, "scanned")
    return _beaten(scanned, k, "lower", scanned)


def read_in_order(open_: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``query, class_id, first_id, score``: exact scores, read by falling upper bound until the first ``k`` are certain."""
    exact = classes.select("class_id", "v")
    asked = exact.select(F.col("class_id").alias("query"), F.col("v").alias("q"))
    left, take, read = materialize(open_, "open"), FIRST_ROUND * k, None
    while not left.isEmpty():
        placed = left.withColumn("place", F.row_number().over(_order("upper", "first_id", "class_id")))
        now = placed.where(F.col("place") <= take).select("query", "class_id", "first_id")
        scored = now.join(exact, "class_id").join(asked, "query").select("query", "class_id", "first_id", inner("v", "q").alias("score"))
        scored = materialize(scored if read is None else scored.unionByName(read), "read")
        rest = placed.where(F.col("place") > take).drop("place")
        later = materialize(_beaten(rest, k, "score", scored), "open")
        discard(left)
        left, read, take = later, scored, 4 * take
    if read is None:
        return open_.select("query", "class_id", "first_id", F.lit(0).cast("long").alias("score")).limit(0)
    return read.withColumn("place", F.row_number().over(_order("score", "first_id", "class_id"))).where(F.col("place") <= k).drop("place")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, file_rows: int = FILE_ROWS, query_rows: int = QUERY_ROWS, scan_blocks: int = SCAN_BLOCKS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest scores of each query row, ties to the smaller id.

    The score is the inner product of the vectors after ``floor(factor * x)`` of
    each component, an exact integer; every row but the query's own is a
    candidate. ``is_query``, of the input's columns, says which rows ask (null:
    not). Rows without an id, and vectors that are null or hold null or
    non-finite components, take no part; vectors of different widths do not
    meet; empty ones meet with score 0. Equal rows and repeated ids are rows of
    their own. Fewer candidates than ``k`` are all returned; an empty table gives
    no rows; other columns are ignored. Extreme components: see ``scaled``.
    """
    rows = materialize(integer_rows(vectors, factor, id_col, vector_col, asks=F.coalesce(is_query, F.lit(False))), "integers")
    classes = materialize(distinct_vectors(rows.drop("asks"), [], k + 1), "classes")
    asking = rows.where("asks").withColumn("h", F.xxhash64("v", F.lit(1))).select("row", F.col("id").alias("query_id"), "h", "v")
    asking = materialize(asking.join(classes.select("h", "v", "class_id"), ["h", "v"]).select("row", "query_id", "class_id"), "asking")
    wanted = classes.join(asking.select("class_id").distinct(), "class_id", "left_semi")
    # One class more than k: a query's own class may hold nothing but its own row.
    open_ = candidates(classes, wanted, k + 1, bits, file_rows, query_rows, scan_blocks)
    found = read_in_order(open_, classes, k + 1).join(classes.select("class_id", "members"), "class_id")
    first = merged_members(found, ["query"], k + 1).withColumnRenamed("query", "class_id")
    others = asking.join(first, "class_id").select("query_id", F.slice(F.filter("first", lambda m: m["row"] != F.col("row")), 1, k).alias("first"))
    each = others.select("query_id", F.posexplode("first").alias("place", "m"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("m.id").alias("vec_id"), (-F.col("m.minus")).alias("score"))
