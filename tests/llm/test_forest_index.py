"""The projection forest against all pairs of vectors."""

import math

import numpy as np

from ledgerloom.llm import forest_index, queries


def brute(rows, threshold=0.93):
    """{id: (links, component)} and the number of links."""
    good, units = [], []
    for i, label, v in rows:
        x = np.array([math.nan if e is None else e for e in v] if v else [0.0], float)
        norm = np.sqrt((x * x).sum())
        if label is not None and np.isfinite(x).all() and norm > 0:
            good.append((i, label, len(x)))
            units.append(x / norm)
    parent = {i: i for i, *_ in rows}
    links = dict.fromkeys(parent, 0)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, label, n) in enumerate(good):
        for b in range(a):
            j = good[b][0]
            if good[b][1:] == (label, n) and units[a] @ units[b] >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (links[i], find(i)) for i in parent}


def rows_of(frame):
    return [(r.vec_id, r.label, r.embedding) for r in frame.select("vec_id", "label", "embedding").collect()]


def check(out, wanted, recall):
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert got.keys() == wanted.keys()
    assert all(got[i][0] <= wanted[i][0] for i in wanted), "a link below the threshold"
    assert sum(n for n, _ in got.values()) >= recall * sum(n for n, _ in wanted.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())
    return got


def test_op3(spark, sf_dir):
    wanted = brute(rows_of(queries.table(spark, sf_dir, "embeddings")))
    check(queries.op3_embedding_near_dedup(spark, sf_dir), wanted, 0.9)


def clusters(seed=3, groups=40, each=30, width=32):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.standard_normal(width)
        for _ in range(each):
            rows.append((len(rows), g % 3, (centre + 0.3 * rng.standard_normal(width)).tolist()))
    return rows


def test_recall_with_small_leaves(spark):
    rows = clusters()
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    out = forest_index.near_duplicates(frame, leaf_rows=32, sample_rows=600)
    check(out, brute(rows), 0.9)


def test_defined_cases(spark):
    e = [1.0, 0.0, 0.0]
    rows = [
        (1, 0, e), (2, 0, [2.0, 0.0, 0.0]), (3, 1, e), (4, None, e), (5, 0, None), (6, 0, []), (7, 0, [0.0, 0.0, 0.0]), (8, 0, [1.0, None, 0.0]), (9, 0, [math.nan, 1.0, 0.0]),
        (10, 0, [math.inf, 1.0, 0.0]), (11, 0, e), (12, 0, [1.0, 0.0]), (13, 0, [1.0, 0.01]), (14, 0, [0.0, 1.0, 0.0]), (15, 1, [0.93, math.sqrt(1 - 0.93**2), 0.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, label int, embedding array<double>, unit string, leaf int")
    got = check(forest_index.near_duplicates(frame), brute(rows), 1.0)
    assert got[1] == (2, 1) and got[4] == (0, 4) and got[12][0] == 1
    assert forest_index.near_duplicates(frame.where("false")).count() == 0


def test_hot_copies_are_one_class(spark):
    rows = [(i, 0, [1.0, 2.0, 3.0]) for i in range(500)] + [(500 + i, 0, [1.0, 2.0, 3.0 + 0.01 * i]) for i in range(1, 50)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    check(forest_index.near_duplicates(frame, leaf_rows=16), brute(rows), 0.999)


def test_components_of_any_size(spark):
    rows = [(1, [1e200, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1e-200, 1e-201], "a"), (4, [0.0, 3e300], "a"), (5, [0.0, 0.0], "a"), (6, [0.0, 1e-310], "a"), (7, [float("inf"), 1.0], "a")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: (r.n_links, r.component_id) for r in forest_index.near_duplicates(vectors).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (0, 5), 6: (1, 4), 7: (0, 7)}


def test_repeated_and_missing_ids_are_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.01, 1.0], 0), (None, [0.02, 1.0], 0), (None, [1.0, 1.0], 0), (5, [1.0, 0.0], 0), (4, None, 0)]
    out = forest_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id or 0) for r in out.collect())) == [(0, 0, 0), (0, 2, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (4, 0, 4), (5, 1, 1)]
