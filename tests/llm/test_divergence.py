"""The audit of sources against its definition."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def plain(rows, least_docs, top_terms=10):
    docs, n, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall(low(text or ""))
        n[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for k, s in groups if k == lang)
        kept = [t for (k, t), d in docs.items() if k == lang and d >= least_docs]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        share = lambda c, whole: 1 + 10**9 * (c + 2) // (whole + 2 * len(kept))  # noqa: E731, B023
        p = {s: {t: share(n[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(n[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", sorted(terms)[:top_terms])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(items), 1)]
    return sorted(out)


def corpus(seed, n=300, sources=9):
    rng = random.Random(seed)
    words = [rng.choice("aäbcéxyZΩ王") + "".join(rng.choice("abcdefghü") for _ in range(rng.randrange(4))) for _ in range(120)]
    rows = []
    for i in range(n):
        own = rng.sample(words, 40)
        text = "".join(rng.choice(own) + rng.choice([" ", ", ", "\n", "1", "-", "\x7f", "`", "[", "{"]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice([i, 5, None]), rng.choice([text, text, text, text, "", None]), rng.choice(["de", "en", None, ""]), rng.choice([*(f"s{k}" for k in range(sources)), "s0", "s0", "s0", "ü", None, ""])))
    return rows + [(n, "word", "fr", "only"), (n + 1, None, "it", "a"), (n + 2, "x", "it", "b")]


@pytest.mark.parametrize(("seed", "least", "tile", "part", "held"), [(1, 10, 64, 16_384, 400_000), (2, 4, 2, 10, 50), (3, 1, 3, 7, 1)])
def test_against_definition(spark, monkeypatch, seed, least, tile, part, held):
    for name, value in (("TILE_SOURCES", tile), ("PART_VECTORS", part), ("MATRIX_ROWS", max(2, part // 2))):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(seed)
    out = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), least_docs=least)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == plain(rows, least)


def test_counting_hands_on_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_TERMS", 2)
    monkeypatch.setattr(divergence, "_CHUNK", 16)
    texts = ["a b c a", "word " * 40 + "end", None, "é É e"]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 4), pa.array(["s"] * 4), pa.array(texts)], ["lang", "source", "text"])
    sums = Counter()
    for out in divergence._count(iter([batch])):
        for row in out.to_pylist():
            sums[row["term"], "n"] += row["n"]
            sums[row["term"], "docs"] += row["docs"]
    assert {t: (sums[t, "n"], sums[t, "docs"]) for t, _ in sums} == {"a": (2, 1), "b": (1, 1), "c": (1, 1), "word": (40, 1), "end": (1, 1), "é": (1, 1), "É": (1, 1), "e": (1, 1), None: (0, 0)}


def test_long_text_is_counted_once(spark):
    text = "Word word " * 1_500_000
    rows = divergence.term_counts(spark.createDataFrame([(1, text, "en", "a"), (2, text, "en", "a")], SCHEMA)).where("term is not null").collect()
    assert [tuple(r) for r in rows] == [("en", "a", "word", 6_000_000, 2)]


def test_large_counts_stay_exact(spark):
    values = [(10**15 - 7, 9 * 10**15), (0, 2), (9 * 10**15 - 2, 9 * 10**15), (12345678901, 98765432109876)]
    rows = spark.createDataFrame(values, "n long, under long")
    got = [r[0] for r in rows.select(divergence.share(F.col("n"), F.col("under"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // u for n, u in values]
    import numpy as np

    assert [int(divergence._shares(np.array([n]), np.array([u]))[0]) for n, u in values] == got


def test_empty_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 1, 2, 3)], f"{SCHEMA}, term int, n int, docs int")
    assert divergence.audit(docs, least_docs=1).count() == 0  # p = q and no other source
    assert divergence.audit(docs.where("false")).count() == 0
