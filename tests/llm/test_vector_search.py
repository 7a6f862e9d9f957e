"""Exact top-k search and hard-negative mining against all pairs of vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import negatives, space_tree, vafile

SCHEMA = "vec_id long, embedding array<double>, label int"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def scaled(v, factor):
    return [math.floor(factor * x) for x in v]


def top_k(rows, asks, k, factor):
    """By the definition, with a place for each row."""
    able = [(at, i, scaled(v, factor)) for at, (i, v, _) in enumerate(rows) if i is not None and sound(v)]
    out = []
    for at, i, v in able:
        if asks(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for other, j, w in able if other != at and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def hard_negatives(rows, asks, n_positives, n_negatives, factor):
    able = [(at, i, scaled(v, factor), label) for at, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and sound(v)]
    out = []
    for at, i, v, label in able:
        if not asks(i):
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, own == label) for other, j, w, own in able if other != at and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scores if s[2])[:n_positives]:
            hard = sorted((s, j) for s, j, same in scores if not same and 50 * -p <= 100 * -s <= 95 * -p)
            out += [(i, positive, rank, j, -p, -s) for rank, (s, j) in enumerate(hard[:n_negatives], 1)]
    return sorted(out)


def mixed(seed=4, n=400, width=6):
    """Clusters, copies, zero vectors, other widths, and rows that take no part."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 5]], i % 3) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 2) for i in range(60)]
    rows += [(n + 100 + i, [0.0] * width, 1) for i in range(40)]
    rows += [(n + 200 + i, [rng.gauss(0, 1)] * 3, 0) for i in range(30)]
    rows += [(n + 300, None, 1), (n + 301, [None] * width, 1), (n + 302, [math.nan] * width, 1), (n + 303, [math.inf] * width, 2), (n + 304, [], 1), (n + 306, [], 1), (None, [1.0] * width, 1), (n + 305, [1.0] * width, None)]
    rows += [rows[10], rows[10], rows[20], (20, rows[3][1], 1)]
    rng.shuffle(rows)
    return rows


def answers(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize(("bits", "file_rows", "query_rows", "scan_blocks", "k"), [(6, 8192, 512, 64, 20), (2, 50, 16, 2, 5), (1, 64, 40, 1, 1), (8, 100, 30, 3, 600)])
def test_top_k(spark, bits, file_rows, query_rows, scan_blocks, k):
    rows = mixed()
    out = vafile.exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, k=k, bits=bits, file_rows=file_rows, query_rows=query_rows, scan_blocks=scan_blocks)
    assert answers(out.select("query_id", "rank", "vec_id", "score")) == top_k(rows, lambda i: i % 10 == 0, k, 64)


def test_bounds_hold_and_leave_little():
    rng = np.random.default_rng(1)
    x, q = np.floor(rng.standard_normal((3000, 64)) * 8), np.floor(rng.standard_normal((20, 64)) * 8)
    for bits, share in ((1, 1.0), (5, 0.1), (6, 0.05)):
        lower, upper = vafile.bounds(q, *vafile.approximate(x, bits))
        exact = q @ x.T
        assert (lower <= exact).all() and (exact <= upper).all()
        stay = [vafile.still_open(lower[i], upper[i], np.arange(3000), 20) for i in range(20)]
        assert all(set(np.lexsort((np.arange(3000), -exact[i]))[:20]) <= set(np.flatnonzero(s)) for i, s in enumerate(stay))
        assert np.mean(stay) <= share


def test_queries_without_direction_keep_few(spark):
    """All scores tie: only the smallest ids stay, not every row."""
    zeros = spark.createDataFrame([(i, [0.0, 0.0] if i == 7 else [float(i), 1.0], 1) for i in range(3000)], SCHEMA)
    out = vafile.exact_top_k(zeros, F.col("vec_id") == 7, k=4, file_rows=500)
    assert answers(out.select("vec_id", "score")) == [(i, 0) for i in range(4)]
    classes = spark.createDataFrame([(i, i, [i, 1]) for i in range(3000)], "class_id long, first_id long, v array<int>")
    asked = spark.createDataFrame([(9999, 9999, [0, 0])], classes.schema)
    assert vafile.candidates(classes, asked, 5, file_rows=500).count() == 5


@pytest.mark.parametrize(("leaf_rows", "task_leaves"), [(2048, 32), (20, 2), (6, 1)])
def test_hard_negatives(spark, leaf_rows, task_leaves):
    rows = mixed()
    out = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, F.col("label"), leaf_rows=leaf_rows, task_leaves=task_leaves)
    wanted = hard_negatives(rows, lambda i: i % 10 == 0, 5, 3, 256)
    assert wanted and answers(out) == wanted


def clustered(spark, groups=16, each=150, width=8, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.standard_normal(width) * 10
        rows += [(g * each + i, [int(v) for v in (centre + rng.standard_normal(width) * 0.3) * 100], str(g % 2)) for i in range(each)]
    return spark.createDataFrame(rows, "class_id long, v array<int>, label string").withColumn("first_id", F.col("class_id"))


def test_node_pairs_are_pruned_and_exact(spark):
    points = clustered(spark).withColumn("root", F.lit("r"))
    tree, rounds = space_tree.grow(points, 40)
    wanted = points.where("class_id % 30 = 0").select("class_id", F.lit(0).cast("long").alias("key"), F.lit(-(1 << 62)).cast("long").alias("least"), F.lit(1 << 62).cast("long").alias("most"))
    found, pairs = negatives.search(tree, rounds, wanted, 4, True)
    rows = points.collect()
    x = {r.class_id: np.array(r.v) for r in rows}
    got = {}
    for r in found.collect():
        got.setdefault(r.anchor, []).append((-r.score, r.class_id))
    for r in rows:
        if r.class_id % 30 == 0:
            best = sorted((-int(x[r.class_id] @ x[o.class_id]), o.class_id) for o in rows if o.label == r.label)[:4]
            assert sorted(got[r.class_id]) == best
    n_leaves = tree.select("node").distinct().count()
    n_anchor_leaves = tree.where("class_id % 30 = 0").select("node").distinct().count()
    assert pairs.count() < 0.35 * n_leaves * n_anchor_leaves


def test_leaves_are_copied_for_groups_and_not_for_pairs(spark):
    points = clustered(spark, groups=1, each=1200).withColumn("root", F.lit("r"))
    tree, rounds = space_tree.grow(points, 40)
    far = 1 << 62
    packed = negatives.leaves(tree, "packed")
    own = negatives.leaves(tree.where("class_id % 30 = 0").withColumn("key", F.lit(0).cast("long")).withColumn("least", F.lit(-far)).withColumn("most", F.lit(far)), "own")
    pairs = negatives.node_pairs(negatives.levels(own, rounds, "own_nodes"), negatives.levels(packed, rounds, "packed_nodes"))
    dealt, left, right = negatives.deal(own, packed, pairs, 10)
    parts = dealt.select("part").distinct().count()
    assert dealt.count() == own.count() * packed.count() > 10 * packed.count()
    assert parts > 1 and right.count() == packed.count() and left.count() == own.count() * parts


def test_tree_leaves_are_bounded(spark):
    points = clustered(spark).withColumn("root", F.when(F.col("class_id") < 1800, "a").otherwise("b"))
    tree, rounds = space_tree.grow(points, 5, sample=200, portion=100)
    assert rounds >= 2 and tree.count() == 2400 and tree.select("class_id").distinct().count() == 2400
    assert tree.groupBy("root", "node").count().agg(F.max("count")).first()[0] <= 5
    assert tree.where("floor(log2(node)) <> 5 * depth").isEmpty()


@pytest.mark.parametrize("empty", [True, False])
def test_defined_cases(spark, empty):
    names = ["row", "h", "members", "asks", "class_id", "first", "root", "node"]
    docs = spark.createDataFrame([(0, [1.0, 0.0], 1, *range(8)), (50, [1.0, 0.0], 1, *range(8))], f"{SCHEMA}, {', '.join(f'{n} int' for n in names)}")
    docs = docs.where("false") if empty else docs
    top = vafile.exact_top_k(docs, F.col("vec_id") % 20 == 0, k=3)
    assert top.columns == ["query_id", "rank", "vec_id", "score"] and answers(top) == ([] if empty else [(0, 1, 50, 4096)])
    hard = negatives.mine(docs, F.col("vec_id") % 50 == 0, F.col("label"))
    assert hard.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and answers(hard) == []
