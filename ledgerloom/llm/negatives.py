"""Hard negatives by dual-tree search.

For an anchor, its positives are the rows of its own label with the highest
inner products; the hard negatives of a positive are the rows of other labels
with the highest products within a band below the positive's.

Both searches go down two trees at once. Candidates stand in a tree whose leaves
are bounded (``space_tree``); anchors stand in it too, and an anchor node
knows the anchors below it alone. A pair of nodes has an interval of the
inner products between them, from their centres, radii and norms. It goes on only
if the interval reaches what some anchor of the group still needs: the score of
the last row found so far, or the band. Pairs of leaves that are left are scored exactly.
A task scores a group of anchor leaves with a part of the candidate leaves. Groups and parts are
bounded in number, so what is copied for them grows with the vectors and not with the pairs.

What an anchor needs at first comes from its own leaf, which is scored before.
Positives are searched in a tree for each label, negatives in one for all.

Equal vectors of a label are one class, which keeps as many of its smallest ids as a
result can hold; equal anchors search once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import discard, materialize
from ledgerloom.llm.space_tree import STRIDE, grow
from ledgerloom.llm.vectors import distinct_vectors, ids, integer_rows, matrix, merged_members

#: Vectors in a leaf at most, and candidate leaves of a part at least.
LEAF_ROWS, TASK_LEAVES = 2048, 16
#: Parts of a tree's candidate leaves at most; anchors of a group at least, and groups of a tree at most.
PARTS, GROUP_ROWS, GROUPS = 64, 16384, 4
#: What rounding can move a bound by, as a share of the norms' product.
ROUNDING = 1e-9

_NODE = "root string, node long, depth long, n long, centre array<double>, radius double, norm double, least double, most double"
_LEAF = f"{_NODE}, ids binary, first binary, labels array<string>, v binary, wants binary"


def _leaf(table: pa.Table) -> pa.Table:
    """One row for a leaf: its statistics and its vectors. ``wants``: (row, key, least, most) for each search."""
    names = ids(table.column("class_id"))
    order = np.argsort(names, kind="stable")
    _, firsts = np.unique(names[order], return_index=True)
    own = order[firsts]
    x = matrix(table.column("v").combine_chunks().take(pa.array(own)), len(table.column("v")[0]))
    centre = x.mean(axis=0)
    row = {c: table.column(c)[0].as_py() for c in ("root", "node", "depth")}
    row |= {"n": len(own), "centre": centre.tolist(), "radius": float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()), "norm": float(np.sqrt((x * x).sum(axis=1)).max()), "least": None, "most": None, "wants": None}
    row |= {"ids": names[own].tobytes(), "first": ids(table.column("first_id"))[own].tobytes(), "labels": table.column("label").combine_chunks().take(pa.array(own)).to_pylist(), "v": x.astype(np.int32).tobytes()}
    if "least" in table.column_names:
        least, most = ids(table.column("least")), ids(table.column("most"))
        wants = np.stack([np.searchsorted(names[own], names), ids(table.column("key")), least, most], axis=1).astype(np.int64)
        wants = wants[np.argsort(wants[:, 0], kind="stable")]
        row |= {"least": float(least.min()), "most": float(most.max()), "wants": wants.tobytes()}
    types = {"n": pa.int64(), "node": pa.int64(), "depth": pa.int64(), "centre": pa.list_(pa.float64()), "labels": pa.list_(pa.string()), **dict.fromkeys(("root",), pa.string()), **dict.fromkeys(("radius", "norm", "least", "most"), pa.float64()), **dict.fromkeys(("ids", "first", "v", "wants"), pa.binary())}
    order_of = [c.split()[0] for c in _LEAF.split(", ")]
    return pa.Table.from_pydict({c: pa.array([row[c]], types[c]) for c in order_of})


def _parent(table: pa.Table) -> pa.Table:
    """The statistics of a node from those of its children."""
    x = np.array(table.column("centre").to_pylist())
    n, radius = ids(table.column("n")), ids(table.column("radius"))
    centre = (x * n[:, None]).sum(axis=0) / n.sum()
    least, most = (table.column(c).to_pylist() for c in ("least", "most"))
    row = {
        "root": [table.column("root")[0].as_py()], "node": [table.column("up")[0].as_py()], "depth": [table.column("up_depth")[0].as_py()], "n": [int(n.sum())], "centre": [centre.tolist()],
        "radius": [float((np.sqrt(((x - centre) ** 2).sum(axis=1)) + radius).max())], "norm": [float(ids(table.column("norm")).max())],
        "least": [None if least[0] is None else min(least)], "most": [None if most[0] is None else max(most)],
    }
    return pa.Table.from_pydict(row, pa.schema([("root", pa.string()), ("node", pa.int64()), ("depth", pa.int64()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64()), ("least", pa.float64()), ("most", pa.float64())]))


def leaves(rows: DataFrame, name: str) -> DataFrame:
    """A row per leaf of ``rows`` (``root, node, depth, class_id, first_id, label, v``, and for anchors ``key, least, most``)."""
    return materialize(rows.groupBy("root", "node").applyInArrow(_leaf, _LEAF), name)


def levels(leaf: DataFrame, rounds: int, name: str) -> list[DataFrame]:
    """Node tables from the roots to the leaves; ``up`` is a node's parent in the table before. A leaf above the last level stands in each below it."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    out = [leaf.select(*names)]
    for level in range(rounds - 1, -1, -1):
        below = out[0]
        deeper = F.col("depth") > level
        up = F.when(deeper, F.shiftright("node", STRIDE)).otherwise(F.col("node"))
        below = below.withColumn("up", up).withColumn("up_depth", F.least("depth", F.lit(level).cast("long")))
        out[0] = below.drop("up_depth")
        out.insert(0, materialize(below.groupBy("root", "up").applyInArrow(_parent, _NODE), name))
    out[0] = out[0].withColumn("up", F.lit(0).cast("long"))
    return out


def interval(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """Bounds of the inner products between two balls of bounded norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    length = lambda x: F.sqrt(dot(x, x))
    slack = length(a["centre"]) * b["radius"] + length(b["centre"]) * a["radius"] + a["radius"] * b["radius"]
    most = a["norm"] * b["norm"]
    edge = most * ROUNDING + 1
    middle = dot(a["centre"], b["centre"])
    return F.greatest(middle - slack, -most) - edge, F.least(middle + slack, most) + edge


def node_pairs(anchors: list[DataFrame], candidates: list[DataFrame]) -> DataFrame:
    """``root, a, b``: pairs of leaves whose interval meets what the anchors of the group need."""
    pairs = None
    for level, (left, right) in enumerate(zip(anchors, candidates, strict=True)):
        fields = ("centre", "radius", "norm")
        left = left.select("root", F.col("node").alias("a"), F.col("up").alias("a_up"), "least", "most", *(F.col(f).alias(f"a_{f}") for f in fields))
        right = right.select("root", F.col("node").alias("b"), F.col("up").alias("b_up"), *(F.col(f).alias(f"b_{f}") for f in fields))
        if pairs is None:
            met = left.join(right, "root")
        else:
            before = pairs.select("root", F.col("a").alias("a_up"), F.col("b").alias("b_up"))
            met = before.join(left, ["root", "a_up"]).join(right, ["root", "b_up"])
        low, high = interval(*({f: F.col(f"{side}_{f}") for f in fields} for side in "ab"))
        pairs = materialize(met.withColumn("low", low).withColumn("high", high).where("high >= least and low <= most").select("root", "a", "b"), f"node_pairs_{level}")
    return pairs


def _coded(labels: list[str], codes: dict[str, int]) -> np.ndarray:
    """Labels as numbers of the task; ``codes`` grows."""
    return np.array([codes.setdefault(label, len(codes)) for label in labels], np.int64)


def _score(k: int, same_label: bool, seed: bool):
    """Scores anchor leaves with the candidate leaves that they meet (``met``; with ``seed`` all): for each search the ``k`` best classes within its band, or with ``seed`` the last of them."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        codes: dict[str, int] = {}
        asking = {}
        for i in range(anchors.num_rows):
            leaf = {c: anchors.column(c)[i].as_py() for c in ("a", "ids", "labels", "v", "wants")}
            wants, names = np.frombuffer(leaf["wants"], np.int64).reshape(-1, 4), np.frombuffer(leaf["ids"], np.int64)
            x = np.frombuffer(leaf["v"], np.int32).reshape(len(names), -1).astype(np.float64)
            held: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 for _ in wants]
            asking[leaf["a"]] = (wants, names, _coded(leaf["labels"], codes), x, held, wants[:, 2].copy())
        for i in range(candidates.num_rows if asking else 0):
            block = {c: candidates.column(c)[i].as_py() for c in ("ids", "first", "labels", "v")}
            other, first, theirs = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["first"], np.int64), _coded(block["labels"], codes)
            y = np.frombuffer(block["v"], np.int32).reshape(len(other), -1).astype(np.float64)
            for a in asking if seed else candidates.column("met")[i].as_py():
                wants, _, mine, x, held, floor = asking[a]
                products = (x @ y.T).astype(np.int64)
                for w, (row, _, _, most) in enumerate(wants):
                    if not w or row != wants[w - 1, 0]:  # searches of one anchor follow each other
                        scores, fits = products[row], (theirs == mine[row]) == same_label
                    near = np.flatnonzero(fits & (scores >= floor[w]) & (scores <= most))
                    if len(near):
                        grown = tuple(np.concatenate(p) for p in zip(held[w], (scores[near], first[near], other[near]), strict=True))
                        best = np.lexsort((grown[2], grown[1], -grown[0]))[:k]
                        held[w] = tuple(g[best] for g in grown)
                        if len(best) == k:
                            floor[w] = held[w][0][-1]
        every = [(names[wants[:, 0]], wants[:, 1], held, floor) for wants, names, _, _, held, floor in asking.values()]
        joined = lambda arrays: np.concatenate([np.zeros(0, np.int64), *arrays])
        if seed:
            return pa.table({"class_id": joined(e[0] for e in every), "key": joined(e[1] for e in every), "least": joined(e[3] for e in every)})
        sizes = joined(np.array([len(h[0]) for h in e[2]], np.int64) for e in every)
        columns = [joined(h[c] for e in every for h in e[2]) for c in range(3)]
        return pa.table({"anchor": np.repeat(joined(e[0] for e in every), sizes), "key": np.repeat(joined(e[1] for e in every), sizes), "class_id": columns[2], "first_id": columns[1], "score": columns[0]})

    return run


def deal(own: DataFrame, packed: DataFrame, pairs: DataFrame, task_leaves: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaf pairs with their task (``group, part``), and the anchor and the candidate leaves of each task.

    A leaf goes to a task once, however many leaves it meets there; a candidate leaf names those (``met``).
    """
    groups = own.groupBy("root").agg(F.least(F.ceil(F.sum("n") / GROUP_ROWS), F.lit(GROUPS)).alias("groups"))
    parts = packed.groupBy("root").agg(F.least(F.ceil(F.count("*") / task_leaves), F.lit(PARTS)).alias("parts"))
    dealt = pairs.join(groups, "root").join(parts, "root").select("root", "a", "b", F.pmod(F.xxhash64("a"), "groups").alias("group"), F.pmod(F.xxhash64("b"), "parts").alias("part"))
    dealt = materialize(dealt, "dealt_pairs")
    left = own.select("root", F.col("node").alias("a"), "ids", "labels", "v", "wants").join(dealt.select("root", "a", "group", "part").distinct(), ["root", "a"])
    met = dealt.groupBy("root", "b", "group", "part").agg(F.collect_list("a").alias("met"))
    right = packed.select("root", F.col("node").alias("b"), "ids", "first", "labels", "v").join(met, ["root", "b"])
    return dealt, left, right.select(*(F.col(c).alias(f"of_{c}") for c in ("root", "group", "part")), "met", "ids", "first", "labels", "v")


def search(tree: DataFrame, rounds: int, wanted: DataFrame, k: int, same_label: bool, task_leaves: int = TASK_LEAVES) -> tuple[DataFrame, DataFrame]:
    """``anchor, key, class_id, score``: for each row of ``wanted`` (``class_id, key, least, most``) the ``k`` best classes within its band; and the leaf pairs scored."""
    columns = ["root", "node", "depth", "class_id", "first_id", "label", "v"]
    packed = leaves(tree.select(*columns), "candidate_leaves")
    asking = materialize(tree.select(*columns).join(wanted, "class_id"), "asking")
    home = packed.select(F.col("root").alias("of_root"), F.col("node").alias("of_node"), "ids", "first", "labels", "v")
    first = leaves(asking, "asking_leaves")
    seeds = first.withColumn("a", F.col("node")).groupBy("root", "node").cogroup(home.groupBy("of_root", "of_node")).applyInArrow(_score(k, same_label, True), "class_id long, key long, least long")
    seeds = materialize(seeds, "seeds")
    own = leaves(asking.drop("least").join(seeds, ["class_id", "key"]), "seeded_leaves")

    pairs = node_pairs(levels(own, rounds, "anchor_nodes"), levels(packed, rounds, "candidate_nodes"))
    dealt, left, right = deal(own, packed, pairs, task_leaves)
    scored = left.groupBy("root", "group", "part").cogroup(right.groupBy("of_root", "of_group", "of_part")).applyInArrow(_score(k, same_label, False), "anchor long, key long, class_id long, first_id long, score long")
    scored = materialize(scored, "scored")
    for done in (packed, asking, first, seeds, own):
        discard(done)
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "first_id", "class_id")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.select("anchor", "key", "class_id", "score"), dealt


def mine(vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 3, band: tuple[int, int] = (50, 95), factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", leaf_rows: int = LEAF_ROWS, task_leaves: int = TASK_LEAVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are exact integer inner products of the vectors after ``floor(factor *
    x)`` of each component. An anchor's positives are its ``n_positives`` first
    other rows of its label, by falling score, then by id; the negatives of each
    are the first ``n_negatives`` rows of other labels whose score is between the
    ``band``'s per cents of the positive's. ``is_anchor`` (null: not) and
    ``label`` are columns of the input.

    Rows without id, label or a sound vector take no part; vectors of different
    widths do not meet; equal rows and repeated ids are rows of their own. Fewer
    rows than asked for are all returned; a positive whose score is negative has an
    empty band. An empty table gives no rows; other columns are ignored.
    """
    least, most = band
    rows = integer_rows(vectors, factor, id_col, vector_col, label=label.cast("string"), asks=F.coalesce(is_anchor, F.lit(False)))
    rows = materialize(rows.where("label is not null and size(v) > 0"), "integers")
    classes = materialize(distinct_vectors(rows.drop("asks"), ["label"], n_positives + 1), "classes")
    asking = rows.where("asks").withColumn("h", F.xxhash64("label", "v", F.lit(1))).select("row", F.col("id").alias("anchor_id"), "h", "label", "v")
    asking = materialize(asking.join(classes.select("h", "label", "v", "class_id"), ["h", "label", "v"]).select("row", "anchor_id", "class_id"), "anchors")
    points = classes.select("class_id", "first_id", "label", "v")
    members = classes.select("class_id", "members")

    far = 1 << 62
    each = asking.select("class_id").distinct().select("class_id", *(F.lit(x).cast("long").alias(c) for c, x in (("key", 0), ("least", -far), ("most", far))))
    tree, rounds = grow(points.withColumn("root", F.concat_ws("|", F.size("v").cast("string"), "label")), leaf_rows)
    near, _ = search(tree, rounds, each, n_positives + 1, True, task_leaves)
    discard(tree)
    first = merged_members(near.join(members, "class_id"), ["anchor"], n_positives + 1)
    own = asking.join(first, asking["class_id"] == first["anchor"]).select("anchor_id", "class_id", F.explode(F.slice(F.filter("first", lambda m: m["row"] != F.col("row")), 1, n_positives)).alias("m"))
    positives = materialize(own.select("anchor_id", F.col("class_id").alias("anchor"), F.col("m.id").alias("positive_id"), (-F.col("m.minus")).alias("key")), "positives")

    per_cent = lambda x: F.call_function("div", x, F.lit(100).cast("long"))
    bands = positives.where("key >= 0").select(F.col("anchor").alias("class_id"), "key").distinct()
    bands = bands.withColumn("least", per_cent(least * F.col("key") + 99)).withColumn("most", per_cent(most * F.col("key"))).where("least <= most")
    tree, rounds = grow(points.withColumn("root", F.size("v").cast("string")), leaf_rows)
    hard, _ = search(tree, rounds, bands, n_negatives, False, task_leaves)
    discard(tree)
    first = merged_members(hard.join(members, "class_id"), ["anchor", "key"], n_negatives)
    out = positives.join(first, ["anchor", "key"]).select("anchor_id", "positive_id", "key", F.posexplode("first").alias("place", "m"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("m.id").alias("negative_id"), F.col("key").alias("positive_score"), (-F.col("m.minus")).alias("negative_score"))
