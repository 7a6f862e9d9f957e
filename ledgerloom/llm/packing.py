"""Packing pieces into sequences, planned on the histogram of their lengths.

Only a piece's length matters to a packer, and there are at most as many lengths
as the sequence has tokens. So the pieces are counted by length in Spark, the
plan is made from that histogram (its size does not depend on the number of
documents), and Spark then hands the pieces of each length to the plan's places
in a fixed order. The bins that hold the same lengths are one *run* with a count.

``vector_best_fit``: a bin has residual capacities for tokens, documents and
attention cost (the sum of squared lengths). Pieces go in by decreasing length;
of the bins where all three fit, the one with the largest weighted dot product
with the piece, or the smallest weighted norm of what would be left, takes it.

``best_fit_decreasing``: tokens only; the fullest bin that fits is found in a
segment tree over residual capacities.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import materialize


def position_type(tokens: int) -> str:
    """Positions in packed rows are little-endian, of 16 bits if they fit."""
    return "<u2" if tokens <= 1 << 16 else "<u4"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; None does not bind."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


@dataclass
class Run:
    """``count`` bins that hold the same ``(length, how many)`` in the same order."""

    count: int
    filled: list[tuple[int, int]]


def vector_best_fit(lengths: dict[int, int], limits: Limits, rule: str = "residual", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> list[Run]:
    """Runs of bins for ``{length: how many}``.

    Ties go to the oldest bin. A bin that takes one piece of a length takes as
    many of them as fit, since no other bin became a better place meanwhile.
    """
    if rule not in ("residual", "dot"):
        raise ValueError("rule must be 'residual' or 'dot'")
    capacity = limits.vector()
    scale = np.array(weights) / capacity.astype(float) ** 2
    runs: list[Run] = []
    open_runs = np.zeros(0, np.int64)
    left = np.zeros((0, 3), np.int64)
    shortest = min(lengths, default=0)
    for length in sorted(lengths, reverse=True):
        piece, waiting = np.array([length, 1, length * length]), lengths[length]
        if (piece > capacity).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while waiting:
            fits = np.flatnonzero((left >= piece).all(axis=1))
            if len(fits):
                score = ((left[fits] - piece) ** 2 * scale).sum(axis=1) if rule == "residual" else -(left[fits] * piece * scale).sum(axis=1)
                at = int(fits[np.argmin(score)])
                source, room = runs[open_runs[at]], left[at]
            else:
                at, source, room = -1, Run(waiting, []), capacity
            each = min(int((room // piece).min()), waiting)
            bins = min(source.count, waiting // each)
            waiting -= bins * each
            runs.append(Run(bins, [*source.filled, (length, each)]))
            if at >= 0:
                source.count -= bins
            rest = room - each * piece
            if at >= 0 and not source.count:
                open_runs, left = np.delete(open_runs, at), np.delete(left, at, axis=0)
            if rest[0] >= shortest and rest[1] >= 1:
                open_runs, left = np.append(open_runs, len(runs) - 1), np.vstack([left, rest])
    return [run for run in runs if run.count]


class CapacityTree:
    """Which residual capacities some bin has; finds the least one that is large enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.node = np.zeros(2 * self.size, np.int64)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.size
        while at:
            self.node[at] += bins
            at //= 2

    def least(self, need: int) -> int | None:
        at = need + self.size
        if self.node[at]:
            return need
        while at > 1:  # up to the first ancestor with bins to its right, then down the left edge
            if at % 2 == 0 and self.node[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.node[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> list[Run]:
    """Runs of bins for ``{length: how many}`` under a token capacity alone."""
    tree, by_room, runs = CapacityTree(capacity), {}, []
    for length in sorted(lengths, reverse=True):
        waiting = lengths[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while waiting:
            room = tree.least(length)
            source = by_room[room][-1] if room is not None else Run(waiting, [])
            room = capacity if room is None else room
            each = min(room // length, waiting)
            bins = min(source.count, waiting // each)
            waiting -= bins * each
            made = Run(bins, [*source.filled, (length, each)])
            if source.filled:
                source.count -= bins
                tree.add(room, -bins)
                if not source.count:
                    by_room[room].pop()
            tree.add(room - each * length, bins)
            by_room.setdefault(room - each * length, []).append(made)
            runs.append(made)
    return [run for run in runs if run.count]


def places(runs: list[Run]) -> np.ndarray:
    """Rows (length, first rank, how many a bin, first sequence, offset), sorted.

    The pieces of a length are ranked from 0; the row with the largest first
    rank not over a piece's own says where it goes.
    """
    rows, taken, sequence = [], {}, 0
    for run in runs:
        offset = 0
        for length, each in run.filled:
            rank = taken.get(length, 0)
            rows.append((length, rank, each, sequence, offset))
            taken[length] = rank + run.count * each
            offset += length * each
        sequence += run.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, each, sequence, offset = plan.value.T
        key = (length << 44) + rank
        for batch in batches:
            own, r = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(key, (own << 44) + r, "right") - 1
            step = r - rank[at]
            kept = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence[at] + step // each[at]), pa.array(offset[at] + step % each[at] * own)], [*kept.schema.names, "sequence_id", "offset"]
            )

    return run


def rank_by_length(pieces: DataFrame, order: list[str]) -> DataFrame:
    """``_rank`` from 0 among the pieces of a length, without gathering a length in one task."""
    buckets = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(*order)
    return dealt.withColumn("_row", F.row_number().over(within)).join(counts, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_bucket", "_before", "_row")


def pack(pieces: DataFrame, planner, order: list[str]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``planner`` makes runs from ``{length: how many}``. ``pieces`` is read three
    times, so it should be a written table; its rows must differ in ``order``.
    An empty table stays empty.
    """
    lengths = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(places(planner(lengths)))
    ranked = rank_by_length(pieces, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, "_rank").mapInArrow(_place(plan), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), rule: str = "residual", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Vector best-fit packing of whole documents, one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only
    documents longer than a sequence are cut. Null texts are empty; an empty
    table gives no rows; repeated rows are packed each.
    """
    from ledgerloom.llm.tokens import cut_documents

    limit = limits.tokens if limits.attention is None else min(limits.tokens, int(limits.attention**0.5))
    pieces = materialize(cut_documents(docs, tokenizer_path, limit, end_id, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, lambda lengths: vector_best_fit(lengths, limits, rule), ["doc_id", "piece", "length", "ids_crc32"])


def _rows(limit: int, pad_id: int, kind: str):
    """Packed rows from the pieces of each sequence: (offset, ids) pairs in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = position_type(limit)
        count = np.arange(limit, dtype=place)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids, positions, bounds = np.full((part.num_rows, limit), pad_id, kind), np.zeros((part.num_rows, limit), place), []
                for i, pieces in enumerate(part.column(1).to_pylist()):
                    bounds.append([0])
                    for piece in sorted(pieces, key=lambda p: p["offset"]):
                        own, at = np.frombuffer(piece["ids"], kind), piece["offset"]
                        ids[i, at : at + len(own)] = own
                        positions[i, at : at + len(own)] = count[: len(own)]
                        bounds[-1].append(at + len(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([x.tobytes() for x in matrix], pa.binary()) for matrix in (ids, positions)), pa.array(bounds, pa.list_(pa.int32()))],
                    ["sequence_id", "input_ids", "position_ids", "cu_seqlens"],
                )

    return run


def packed_rows(docs: DataFrame, tokenizer_path: str, tokens: int = 2048, end_id: int = 0, pad_id: int = 0, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents packed by best-fit-decreasing, as rows of a trainer's id matrix.

    Columns: sequence_id, which differs for every row; input_ids, ``tokens``
    little-endian ids of ``id_bytes`` bytes each, padded with ``pad_id``;
    position_ids, as many positions (16 bits if ``tokens`` fits), which restart at 0 with every piece;
    cu_seqlens, the cumulative lengths of the pieces from 0 (its last entry is
    where padding begins). A document longer than a row is cut without loss; its
    pieces restart too. Null texts are only the end id; repeated rows and rows
    with null ids are packed each; an empty table gives no rows; other columns
    are ignored.

    Only pieces shorter than a row are shuffled; a full piece is a row as it is.
    """
    from ledgerloom.llm.tokens import cut_documents

    kind = f"<u{id_bytes}"
    pieces = materialize(cut_documents(docs, tokenizer_path, tokens, end_id, id_bytes, id_col, text_col), "pieces")
    keys = pieces.where(F.col("length") < tokens).select("doc_id", "piece", "length", "ids_crc32", "ids")
    slots = pack(keys, lambda lengths: best_fit_decreasing(lengths, tokens), ["doc_id", "piece", "length", "ids_crc32"])
    mixed = slots.groupBy("sequence_id").agg(F.collect_list(F.struct(F.col("offset").cast("int").alias("offset"), "ids")).alias("pieces"))
    whole = pieces.where(F.col("length") == tokens).select((-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.array(F.struct(F.lit(0).alias("offset"), "ids")).alias("pieces"))
    out = "sequence_id long, input_ids binary, position_ids binary, cu_seqlens array<int>"
    return mixed.unionByName(whole).mapInArrow(_rows(tokens, pad_id, kind), out)


PARTS = ("ids", "positions", "cu_seqlens", "row_starts")


def _write_shard(folder: str):
    """The files of each task's rows; the index row that names them comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = re.sub("^file:/+", "/", folder)
        system, path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        shard, rows, bounds = uuid.uuid4().hex, 0, 0
        system.create_dir(path, recursive=True)
        with contextlib.ExitStack() as stack:
            ids, positions, lengths, starts = (stack.enter_context(system.open_output_stream(f"{path}/{shard}.{part}")) for part in PARTS)
            for batch in batches:
                for row in batch.to_pylist():
                    ids.write(row["input_ids"])
                    positions.write(row["position_ids"])
                    lengths.write(np.array(row["cu_seqlens"], "<i4").tobytes())
                    starts.write(np.array([bounds], "<i8").tobytes())
                    rows, bounds = rows + 1, bounds + len(row["cu_seqlens"])
            starts.write(np.array([bounds], "<i8").tobytes())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, rows, bounds - rows)], ["shard", "rows", "segments"])

    return run


def write_packed(rows: DataFrame, path: str) -> DataFrame:
    """The packed rows as flat binary files, one set for each task, and their index: ``shard, rows, segments``.

    ``{shard}.ids`` and ``{shard}.positions`` are matrices without a header, a
    row for each sequence; ``{shard}.cu_seqlens`` has the cumulative lengths of
    all rows end to end (32 bits each), and ``{shard}.row_starts`` where those of
    each row begin, and the end (64 bits each). Files of tasks that failed are in
    no index row and mean nothing. ``path`` must be shared by all executors.
    """
    index = rows.mapInArrow(_write_shard(f"{path}/data"), "shard string, rows long, segments long")
    index.write.mode("error").parquet(f"{path}/index")
    return rows.sparkSession.read.parquet(f"{path}/index")


def open_packed(path: str, shard: str, tokens: int, id_bytes: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard mapped into memory: id matrix, position matrix, cumulative lengths, and where each row's begin."""
    ids, positions, lengths, starts = (np.memmap(f"{path}/data/{shard}.{part}", kind, "r") for part, kind in zip(PARTS, (f"<u{id_bytes}", position_type(tokens), "<i4", "<i8"), strict=True))
    return ids.reshape(-1, tokens), positions.reshape(-1, tokens), lengths, starts
