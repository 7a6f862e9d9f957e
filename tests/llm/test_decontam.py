"""Decontamination against a search of every window in every document."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import decontam, queries
from ledgerloom.llm.words import texts_to_hashes


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13, share=20):
    windows = {}
    for i, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = {}
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w))
    return out


def digest(frame):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()}


def pairs(frame, key):
    return [(r[0], r[1]) for r in frame.select(key, "text").collect()]


def test_op7(spark, sf_dir):
    wanted = brute(pairs(queries.table(spark, sf_dir, "documents"), "doc_id"), pairs(queries.table(spark, sf_dir, "benchmark"), "item_id"))
    assert digest(queries.op7_benchmark_decontamination(spark, sf_dir)) == wanted
    assert any(x[4] for x in wanted.values())


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "Ä", "7x"]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice((0, 1, 2, 5, 6, 12))))) for i in range(12)] + [(99, None), (98, "...")]
    docs = [(i, rng.choice((" ", ", ", "--")).join(pick(rng.choice((0, 1, 4, 20, 150))))) for i in range(40)] + [(98, None), (99, "?!")]
    return docs, items


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("seed", range(3))
def test_random(spark, monkeypatch, seed, blocks):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id long, text string, n_words int, item_id string")
    b = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, doc_id int")
    if blocks > 1:
        monkeypatch.setattr(decontam, "BLOCK_WORDS", sum(len(t or "") for _, t in items) // (4 * blocks))
    wanted = brute(docs, items, window=6)
    assert digest(decontam.decontaminate(d, b, window=6)) == wanted
    clean = decontam.drop_contaminated(d, b, window=6)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, x in wanted.items() if not x[4])


def test_longest_match(spark):
    item = [f"t{i}" for i in range(40)]
    d = spark.createDataFrame([(1, " ".join(["x", *item[5:30], "y"])), (2, " ".join(item[:5]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    rows = {r.doc_id: (r.longest_words, r.longest_item, r.longest_at) for r in decontam.decontaminate(d, b).collect()}
    assert rows == {1: (25, 7, 1), 2: (None, None, None)}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.decontaminate(d, b).collect()] == [False, False]
    assert decontam.drop_contaminated(d, b).count() == 2
    assert decontam.decontaminate(d.where("false"), b).count() == 0


@pytest.mark.parametrize("blocks", [1, 3])
def test_rows_are_judged_by_themselves(spark, monkeypatch, blocks):
    items = [(1, "a b c d e f g"), (2, "h i j k l m"), (2, "n o p q r s"), (None, "u v w x y z")]
    texts = [(5, "a b c d e f", 1), (5, "q " * 200, 2), (5, "a b c d e f", 3), (None, "h i j k l m", 4), (None, "u v w x y z", 5), (None, None, 6), (7, "x " * 300_000 + "n o p q r s", 7)]
    d = spark.createDataFrame(texts, "doc_id long, text string, row int")
    b = spark.createDataFrame(items, "item_id long, text string")
    if blocks > 1:
        monkeypatch.setattr(decontam, "BLOCK_WORDS", 3)
    report = decontam.decontaminate(d, b, window=6)
    seen = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in report.collect()), key=str)
    wanted = [(5, 6, 6, 1, True), (5, 200, 0, 0, False), (5, 6, 6, 1, True), (None, 6, 6, 1, True), (None, 6, 0, 0, False), (None, 0, 0, 0, False), (7, 300_006, 6, 1, False)]
    assert seen == sorted(wanted, key=str)
    assert sorted(r.row for r in decontam.drop_contaminated(d, b, window=6).collect()) == [2, 5, 6, 7]
    clashing = d.withColumnRenamed("row", "_ROW").withColumn("id", d.text)
    kept = decontam.drop_contaminated(clashing, b, window=6)
    assert kept.columns == clashing.columns and sorted(r["_ROW"] for r in kept.collect()) == [2, 5, 6, 7]


@pytest.mark.parametrize("hits", [False, True])
def test_memory_of_a_long_run_of_texts(hits):
    """Arrays over the texts of a batch stay small, whether no word or every word can match."""
    item = [f"t{i}" for i in range(400)]
    text = " ".join(item if hits else [f"u{i}" for i in range(400)])
    hashed = texts_to_hashes(np.frombuffer(" ".join(item).encode(), np.uint8), np.array([0, len(" ".join(item))]), decontam._TABLE)[0]
    suffixes = decontam.Suffixes.of(np.array([1]), [hashed], 13)
    column = pa.array([text] * ((8 << 20) // len(text)))
    tracemalloc.start()
    try:
        seen = sum(h.sum() == (400 * len(h) if hits else 0) for _, _, _, h, *_ in decontam._shard_facts(column, suffixes))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen and peak < 100 << 20


@pytest.mark.parametrize("blocks", [1, 3])
def test_words_beside_a_very_long_one(spark, monkeypatch, blocks):
    items = [(1, "a b c d e f g"), (2, "h i j k l m")]
    texts = [(1, "a b c d e f " + "x" * 70_000), (2, "n " * 50_000 + "h i j k l m " + "y" * 200_000), (3, "z" * 70_000)]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    if blocks > 1:
        monkeypatch.setattr(decontam, "BLOCK_WORDS", 2)
    assert digest(decontam.decontaminate(d, b, window=6)) == brute(texts, items, window=6)
    assert sorted(r.doc_id for r in decontam.drop_contaminated(d, b, window=6).collect()) == [2, 3]
