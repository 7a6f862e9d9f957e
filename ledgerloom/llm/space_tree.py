"""Trees over vectors that grow on the executors until every leaf is small.

Each round splits all nodes that are too large at once: a bounded sample of each
is gathered in a task of its own, which fits up to five levels of median cuts (as many as
its size asks for) along the line between two far points; then every vector of the node is sent down them. A
large node is dealt into portions for that, each with a copy of the cuts, so no
task holds a node. A node's number is its path: a 1, then five bits a round, so
its ancestors are found by shifting. Rounds grow with the logarithm of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import discard, materialize
from ledgerloom.llm.vectors import ids, matrix

#: Levels that a round adds at most, and bits of a path.
STRIDE = 5
#: Vectors that the cuts of a node are fitted on, about, and vectors of a portion.
SAMPLE, PORTION = 4096, 8192
#: Rounds at most; a path has 62 bits.
ROUNDS = 12

_HASHES = 1 << 30


def fit_cuts(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and cuts of a complete tree of some levels, in heap order."""
    n = (1 << levels) - 1
    axes, cuts = np.zeros((n, x.shape[1])), np.zeros(n)
    members = [np.arange(len(x))]
    for node in range(n):
        rows = x[members[node]]
        if len(rows) > 1:
            far = lambda p: rows[np.argmax(((rows - p) ** 2).sum(axis=1))]
            a = far(rows.mean(axis=0))
            axis = far(a) - a
            norm = np.sqrt((axis * axis).sum())
            axes[node] = axis / norm if norm else axis
        place = rows @ axes[node]
        cuts[node] = np.median(place) if len(rows) else 0.0
        members += [members[node][place <= cuts[node]], members[node][place > cuts[node]]]
    return axes, cuts


def descend(x: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf (0 to the number of cuts) of each vector."""
    at = np.zeros(len(x), np.int64)
    for _ in range(len(cuts).bit_length()):
        step = np.empty(len(x), np.int64)
        for node in np.unique(at):
            own = at == node
            step[own] = x[own] @ axes[node] > cuts[node]
        at = 2 * at + 1 + step
    return at - len(cuts)


def _fit(table: pa.Table) -> pa.Table:
    axes, cuts = fit_cuts(matrix(table.column("v"), len(table.column("v")[0])), table.column("levels")[0].as_py())
    return pa.Table.from_pylist([{"root": table.column("root")[0].as_py(), "node": table.column("node")[0].as_py(), "axes": axes.tobytes(), "cuts": cuts.tobytes()}])


def _send_down(rows: pa.Table, cuts: pa.Table) -> pa.Table:
    cut = np.frombuffer(cuts.column("cuts")[0].as_py(), np.float64)
    axes = np.frombuffer(cuts.column("axes")[0].as_py(), np.float64).reshape(len(cut), -1)
    node = (ids(rows.column("node")) << STRIDE) + descend(matrix(rows.column("v"), axes.shape[1]), axes, cut)
    out = rows.set_column(rows.schema.get_field_index("node"), "node", pa.array(node))
    return out.set_column(out.schema.get_field_index("depth"), "depth", pa.array(ids(rows.column("depth")) + 1)).drop_columns(["portion"])


def grow(rows: DataFrame, leaf_rows: int, sample: int = SAMPLE, portion: int = PORTION) -> tuple[DataFrame, int]:
    """``rows`` with ``node`` and ``depth``, and the number of rounds.

    ``rows`` has ``root`` (a string; each has a tree of its own, and vectors of
    one width), ``class_id`` (unique longs) and ``v``. Leaves hold ``leaf_rows``
    vectors at most, unless medians no longer divide them.
    """
    tree = materialize(rows.withColumn("node", F.lit(1).cast("long")).withColumn("depth", F.lit(0).cast("long")), "tree")
    columns, schema = tree.columns, tree.schema
    for depth in range(ROUNDS):
        sizes = tree.where(F.col("depth") == depth).groupBy("root", "node").count().where(F.col("count") > leaf_rows)
        # Medians of a sample are not exact: leaves are meant to stay a quarter below the bound.
        levels = F.least(F.lit(STRIDE), F.ceil(F.log2(F.col("count") / (0.75 * leaf_rows))).cast("int"))
        sizes = materialize(sizes.withColumn("levels", levels), "large_nodes")
        if sizes.isEmpty():
            return tree, depth
        large = tree.join(sizes, ["root", "node"])
        chance = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))
        drawn = large.where(F.pmod(F.xxhash64("class_id", F.lit(depth)), F.lit(_HASHES)) < chance * _HASHES)
        cuts = materialize(drawn.select("root", "node", "levels", "v").groupBy("root", "node").applyInArrow(_fit, "root string, node long, axes binary, cuts binary"), "cuts")
        portions = F.ceil(F.col("count") / portion)
        dealt = large.withColumn("portion", F.pmod(F.xxhash64("class_id"), portions)).select(*columns, "portion")
        # A node without a sample (a matter of chance, for none that is large) stays as it is.
        copies = cuts.join(sizes, ["root", "node"]).select("axes", "cuts", F.col("root").alias("of_root"), F.col("node").alias("of_node"), F.explode(F.sequence(F.lit(0).cast("long"), portions - 1)).alias("of_portion"))
        sent = dealt.groupBy("root", "node", "portion").cogroup(copies.groupBy("of_root", "of_node", "of_portion")).applyInArrow(_send_down, schema)
        rest = tree.join(sizes, ["root", "node"], "left_anti").select(*columns)
        grown = materialize(sent.select(*columns).unionByName(rest), "tree")
        discard(tree)
        tree = grown
    return tree, ROUNDS
