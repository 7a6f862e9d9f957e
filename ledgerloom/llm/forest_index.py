"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits the space again and again at the median of a random projection;
vectors close to a split go down both sides (spill). The spill is as wide as a
share of the vectors and as half the distance of a pair at the threshold, at
least; a node that this would hardly divide is one tight group and stays a leaf,
however large. Near vectors then share a leaf in some tree. The trees are fitted on a bounded sample, every vector is
routed through all of them, and vectors are compared within (label, leaf) only.

The depth follows the input: a leaf should hold ``leaf_rows`` vectors of a label.
One with more than twice that is cut into blocks and every pair of
blocks becomes its own task, so no group is held whole; a pair of blocks is one
matrix product. A pair that shares several leaves counts in the first of them
only, which each side knows from the leaf numbers it carries, so linked pairs
are never listed: a leaf yields counts and, per block pair, a spanning forest.

Equal vectors are one class; its members share their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.scratch import materialize

TREES = 6
#: Fewest rows of the sample in a leaf.
LEAST_LEAF = 16
#: Rows of the sample that the splits are fitted on.
SAMPLE_ROWS = 20_000
#: Share of a node's vectors on each side of a split that go down both sides.
SPILL = 0.06
#: A node stays a leaf if a side of its split would have this share of it.
TIGHT = 0.7
#: Vectors of one label that a leaf should hold, and twice that at most in a block.
LEAF_ROWS = 1024


class Tree:
    """Splits in an array: node ``i`` has ``axis[i]``, two cuts and two children; leaves are negative."""

    def __init__(self, sample: np.ndarray, leaf: int, spill: float, reach: float, seed: int):
        rng = np.random.default_rng(seed)
        self.reach = reach
        self.axis, self.low, self.high, self.child = [], [], [], []
        self.leaves = 0
        self.root = self._split(sample, leaf, spill, rng)
        width = sample.shape[1]
        self.axis = np.array(self.axis, np.float64).reshape(-1, width)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def _split(self, rows: np.ndarray, leaf: int, spill: float, rng) -> int:
        if len(rows) <= leaf:
            self.leaves += 1
            return -self.leaves
        axis = rng.standard_normal(rows.shape[1])
        place = rows @ axis
        low, middle, high = np.quantile(place, [0.5 - spill, 0.5, 0.5 + spill])
        low, high = min(low, middle - self.reach), max(high, middle + self.reach)
        left, right = rows[place <= high], rows[place > low]
        if max(len(left), len(right)) >= TIGHT * len(rows):
            self.leaves += 1
            return -self.leaves
        node = len(self.axis)
        self.axis.append(axis)
        self.low.append(low)
        self.high.append(high)
        self.child.append([0, 0])
        self.child[node] = [self._split(left, leaf, spill, rng), self._split(right, leaf, spill, rng)]
        return node

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf a row reaches."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -node - 1))
                continue
            place = x[own] @ self.axis[node]
            todo += [(self.child[node][0], own[place <= self.high[node]]), (self.child[node][1], own[place > self.low[node]])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit(vectors: DataFrame, trees: int, leaf: int, spill: float, reach: float, rows: int) -> list[Tree]:
    """Trees from at most ``rows`` unit vectors, chosen by hash; ``reach``: least half width of the spill."""
    sample = vectors.select("unit").orderBy(F.xxhash64("unit")).limit(rows).toArrow().column(0)
    by_width: dict[int, list] = {}
    for row in sample.to_pylist():
        by_width.setdefault(len(row), []).append(row)
    x = np.array(max(by_width.values(), key=len, default=[]), np.float64)
    return [Tree(x, leaf, spill, reach, 1 + t) for t in range(trees)] if len(x) else []


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _route(shared):
    """(class, label, unit, leaf, all leaves of the vector) for each leaf that a vector reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        width = trees[0].axis.shape[1] if trees else 0
        base = np.cumsum([0, *(t.leaves for t in trees)])
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for lo in range(0, batch.num_rows, 2048):
                part, fits = batch.slice(lo, 2048), sizes[lo : lo + 2048] == width
                own = np.flatnonzero(fits)
                routes: list[list[int]] = [[] for _ in range(part.num_rows)]
                for t, tree in enumerate(trees):
                    for r, leaf in zip(*tree.route(_matrix(part.column(2).filter(pa.array(fits)), width)), strict=True):
                        routes[own[r]].append(int(base[t] + leaf))
                for r in np.flatnonzero(~fits):  # vectors of another width meet only each other
                    routes[r].append(-int(sizes[lo + r]))
                counts = [len(x) for x in routes]
                take = pa.array(np.repeat(np.arange(part.num_rows), counts))
                leaves = pa.array([np.sort(np.array(x, np.int64)) for x in routes], pa.list_(pa.int64())).take(take)
                yield pa.RecordBatch.from_arrays([c.take(take) for c in part.columns] + [pa.array([l for x in routes for l in sorted(x)], pa.int64()), leaves], [*part.schema.names, "leaf", "leaves"])

    return run


def _first_shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Whether ``leaf`` is the first leaf that the pairs share."""
    most = max(max(map(len, a)), max(map(len, b)))
    x = np.array([np.pad(v, (0, most - len(v)), constant_values=-1 << 40) for v in a])
    y = np.array([np.pad(v, (0, most - len(v)), constant_values=-1 << 41) for v in b])
    out = np.empty(len(i), bool)
    for lo in range(0, len(i), 1 << 13):
        u, v = x[i[lo : lo + (1 << 13)]], y[j[lo : lo + (1 << 13)]]
        same = (u[:, :, None] == v[:, None, :]).any(axis=2)
        out[lo : lo + (1 << 13)] = np.where(same, u, np.int64(1) << 60).min(axis=1) == leaf
    return out


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each row reaches through the pairs."""
    label = np.arange(n)
    while True:  # minimum over neighbours, with shortcuts
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(threshold: float):
    """Within one (label, leaf, block pair): links per class, and edges that span the components."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids = table.column("class_id").to_numpy()
        copies = table.column("copies").to_numpy()
        width = len(table.column("unit")[0])
        x = _matrix(table.column("unit").combine_chunks(), width)
        leaves = [np.array(v, np.int64) for v in table.column("leaves").to_pylist()]
        leaf = table.column("leaf")[0].as_py()
        parts = [np.flatnonzero(side == s) for s in (0, 1)]
        left, right = parts[0], parts[1] if len(parts[1]) else parts[0]
        linked_i, linked_j = [], []
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            close = x[rows] @ x[right].T >= threshold
            if not len(parts[1]):
                close = np.triu(close, lo + 1)
            i, j = np.nonzero(close)
            if len(i):
                i, j = rows[i], right[j]
                first = _first_shared(leaves, leaves, i, j, leaf)
                linked_i.append(i[first])
                linked_j.append(j[first])
        names = ["class_id", "links", "to"]
        if not linked_i or not sum(map(len, linked_i)):
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names)
        i, j = np.concatenate(linked_i), np.concatenate(linked_j)
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        label = _spanning(i, j, len(ids))
        some = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[label[some]])], names)

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    trees: int = TREES,
    spill: float = SPILL,
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is ``threshold`` or more. Null, empty and zero vectors,
    and those with null or non-finite components, link with nothing. Links whose
    vectors share no leaf in any tree are missed; none is wrong. Rows with
    one id, or none, are rows of their own; a component is named by its smallest id (null if it has
    none). An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    most = F.array_max(F.transform("v", F.abs))  # components are scaled by it where their squares leave the range of doubles
    beyond = (most > 0) & (most < float("inf")) & ((length("v") > 1e150) | (length("v") < 1e-150))
    rows = rows.withColumn("w", F.when(beyond, F.transform("v", lambda e: e / most)).otherwise(F.col("v")))
    norm = length("w")
    sound = F.coalesce(F.col("label").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = rows.withColumn("sound", sound)
    unit = F.transform("w", lambda e: e / norm)
    members = materialize(rows.select("row", "vec_id", "label", F.when(F.col("sound"), unit).alias("unit"), F.when(F.col("sound"), F.xxhash64("label", "v", F.lit(7))).alias("h"), F.when(F.col("sound"), F.col("v")).alias("v")), "vectors")
    classes = members.where("unit is not null").groupBy("label", "h", "v").agg(F.min("row").alias("class_id"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = materialize(classes.select("class_id", "first_id", "label", "unit", "copies", "h", "v"), "classes")

    total, labels = classes.agg(F.count("*"), F.count_distinct("label")).first()
    leaf = max(LEAST_LEAF, leaf_rows * labels * min(total, sample_rows) // max(1, total))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) / 2  # projections scale a distance by a standard normal
    shared = spark.sparkContext.broadcast(fit(classes, trees, leaf, spill, reach, sample_rows))
    label_type = classes.schema["label"].dataType.simpleString()
    base = f"class_id long, label {label_type}, unit array<double>, copies long"
    routed = materialize(classes.select("class_id", "label", "unit", "copies").mapInArrow(_route(shared), f"{base}, leaf long, leaves array<long>"), "routed")
    blocks = routed.groupBy("label", "leaf").count().where("count > 1").select("label", "leaf", F.ceil(F.col("count") / (2 * leaf_rows)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class_id", "leaf"), F.col("blocks")).cast("int")
    dealt = routed.join(blocks, ["label", "leaf"]).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        "class_id", "unit", "copies", "leaf", "leaves", "label",
        F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    found = materialize(dealt.groupBy("label", "leaf", "p", "q").applyInArrow(_compare(threshold), "class_id long, links long, to long"), "found")

    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("class_id <> to"), "class_id", "to")
    named = classes.join(links, "class_id", "left").join(components.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = named.select("label", "h", "v", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("label", "h", "v", "n_links", "component_id")
    out = members.where("unit is not null").join(named, ["label", "h", "v"]).select("vec_id", "n_links", "component_id")
    alone = members.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
