"""The similarity join against all pairs of sets."""

import random
import re

import pytest

from ledgerloom.llm import jaccard, queries
from ledgerloom.llm.components import connected_components


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=80):
    """{id: (n_shingles, component)} by comparing all pairs of distinct sets."""
    sets = {i: frozenset(set_of(t)) for i, t in rows}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    parent = {i: first.get(s, i) for i, s in sets.items()}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    kinds = list(first.items())
    for k, (s, i) in enumerate(kinds):
        for t, j in kinds[:k]:
            if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def answer(docs, **options):
    return {r.id: (r.n_shingles, r.component_id) for r in jaccard.classes(jaccard.jaccard_join(docs, **options)).collect()}


def test_op2(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_ngram_jaccard_join(spark, sf_dir).collect()} == brute(rows)


def corpus(seed):
    """Short and long texts with near copies on both sides of the threshold, and a large group."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(60):
        rows.append([rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 3, 5, 6, 9, 14, 30, 80, 200)))])
    for _ in range(90):
        own = list(rng.choice(rows))
        for _ in range(rng.randint(0, 1 + len(own) // 25) if own else 0):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append(own)
    for _ in range(60):  # each near the base, not always near each other
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append(own)
    return [(i, rng.choice((" ", "\n", "  ")).join(w.upper() if rng.random() < 0.1 else w for w in r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(docs) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "a b c d e"), (7, "a b c d E"), (8, "a b c d e f"), (9, None), (10, "  x"), (11, "x " * 20_000), (12, "X " * 20_001)]
    docs = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in rows], "doc_id long, text string, node string, n int, id int")
    assert answer(docs) == brute(rows)
    assert jaccard.classes(jaccard.jaccard_join(docs.where("false"))).count() == 0
    nulls = docs.unionByName(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one' AS text", "node", "n", "id"))
    kept = jaccard.keep_one(nulls)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in brute(rows).items() if i == c)
    with pytest.raises(ValueError):
        jaccard.jaccard_join(docs, similarity="0")


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 2000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [30, 50, 100])
def test_other_similarities(spark, percent):
    rows = [*corpus(4), (500, "a b c d e"), (501, "a b c d e f"), (502, "p q r s t u v w"), (503, "p q r s t"), (504, "q r s t u v w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(docs, similarity=str(percent / 100)) == brute(rows, percent)


def test_hot_lists_in_blocks_and_clashing_nodes(spark, monkeypatch):
    """A passage in every text, lists that are never dealt by key, tiny blocks, and two unlike sets with one hash."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    texts = [passage + [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 6, 9)))] for _ in range(150)]
    texts += [[*t[:-1], "new"] for t in texts[:20]]
    rows = [*corpus(5), *((1000 + i, " ".join(t)) for i, t in enumerate(texts))]
    monkeypatch.setattr(jaccard, "HOT_LIST", 20)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 16)
    marks = jaccard.marks_of
    fake = lambda g: (7 if len(g) in (1, 76) else marks(g)[0], marks(g)[1])
    monkeypatch.setattr(jaccard, "marks_of", fake)
    monkeypatch.setattr(jaccard, "node_of", lambda g, clashing: fake(g)[1] if fake(g)[0] in clashing else fake(g)[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    described = docs.selectExpr("doc_id AS row", "doc_id AS id", "text").mapInArrow(jaccard._describe(5), "row long, id long, n int, node long, check long, bits binary")
    assert described.where("node = 7").select("check").distinct().count() > 1
    assert answer(docs) == brute(rows)


def test_rows_with_one_id_or_none(spark):
    rows = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 2), (1, "q r s t u v w", 3), (None, "a b c d e f g", 4), (None, "h i j k l m n", 5), (None, "h i j k l m n", 6), (0, None, 7), (None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r["_gone"] for r in kept.collect())
    assert got[-2:] == [7, 8] and got[1] == 3 and got[0] in (1, 2) and got[2] in (5, 6) and len(got) == 5
    out = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.classes(jaccard.jaccard_join(docs)).collect()), key=str)
    assert out == sorted([(1, 3, 1), (1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 3, None), (None, 3, None), (0, 0, 0), (None, 0, None)], key=str)
