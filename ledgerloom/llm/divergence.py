"""Which sources of a language differ, and by which terms.

Within a language every term has a sparse vector of its counts in the sources.
Terms with an identical vector add the same to every pair of sources, so they
are grouped by it: each pair is evaluated once per distinct vector, and the
result counts as often as there are terms.

Sources are numbered and paired in tiles of two blocks of sources. A tile sees a
term's counts in its own sources only, so more terms are alike there, and terms
that occur in none of them are not sent at all: they all share one value, which
every pair takes once, times their number. A tile's distinct vectors are dealt
into parts, each a task; counts of a part are matrices of bounded size.

The contribution of single terms is ranked over the original terms.

All arithmetic is exact. Texts are counted inside tasks first, so a frequent word or a
hot source is a few rows per task, and both shuffles carry sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import materialize

#: Documents of its language that a kept term occurs in, at least.
LEAST_DOCS = 10
#: Scale of the smoothed shares, and what each count is raised by.
SCALE, RAISE = 1_000_000_000, 2
#: Sources in a block of a tile.
TILE_SOURCES = 64
#: Distinct vectors in a part of a tile, about, and rows of a matrix.
PART_VECTORS, MATRIX_ROWS = 16_384, 256
#: (source, term) entries that a task counts before it hands them on.
HELD_TERMS = 400_000

#: Bytes between terms become spaces, A-Z become a-z; all others, and so all characters beyond ASCII, stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text that are split at a time; the cut is at a byte between terms.
_CHUNK = 8 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in runs of bounded size."""
    at = 0
    while len(text) - at > _CHUNK:
        cut = at + _CHUNK
        while cut < len(text) and _FOLD[text[cut]] != 0x20:
            cut += 1
        yield text[at:cut].translate(_FOLD).split()
        at = cut
    yield text[at:].translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) sums of a run of rows; a row with a null term for every group."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            seen = docs[lang, source]
            names = ["lang", "source", "term", "n", "docs"]
            words = [None, *(w.decode() for w in own)]
            each = [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.string()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *(seen[w] for w in own)], pa.int64())]
            yield pa.RecordBatch.from_arrays(each, names)
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.large_binary()), strict=True):
            key = lang or "", source or ""
            own, seen = counts.setdefault(key, Counter()), docs.setdefault(key, Counter())
            before, here = len(own), set()
            for run in terms(text.as_py() or b""):
                own.update(run)
                here.update(run)
            seen.update(here)
            held += len(own) - before
            if held > HELD_TERMS:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term and rows that hold it; ``term`` is null once for each group."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, under: Column) -> Column:
    """``1 + floor(SCALE * (n + RAISE) / under)`` in 64 bits: nine decimal places of a quotient, three at a time."""
    whole, rest = _div(n + RAISE, under), (n + RAISE) % under
    for _ in range(3):
        whole, rest = whole * 1000 + _div(rest * 1000, under), (rest * 1000) % under
    return whole + 1


def _shares(n: np.ndarray, under: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    whole, rest = np.divmod(n + RAISE, under)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, under)
        whole = whole * 1000 + digits
    return whole + 1


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)**2 / (p + q))``."""
    return _div((p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, total, vector``: terms in enough rows of their language, with their sparse counts by source."""
    each = counts.where("term is not null").groupBy("lang", "term")
    kept = each.agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return kept.where(F.col("docs") >= least_docs).drop("docs")


def group_totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, under, lang_under, n_kept, blocks, block``: for every group what its shares divide by, and its block of sources."""
    langs = counts.where("term is null").groupBy("lang").agg(F.count("*").alias("n_sources"))
    totals = kept.groupBy("lang").agg(F.count("*").alias("n_kept"), F.sum("total").alias("lang_total"))
    langs = langs.join(totals, "lang", "left").select("lang", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.ceil(F.col("n_sources") / TILE_SOURCES).cast("int").alias("blocks"))
    each = kept.select("lang", F.explode("vector").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("group_total"))
    groups = counts.where("term is null").select("lang", "source").join(each, ["lang", "source"], "left").join(langs, "lang")
    under = lambda total: F.coalesce(total, F.lit(0)) + RAISE * F.col("n_kept")
    return groups.select("lang", "source", under(F.col("group_total")).alias("under"), under(F.col("lang_total")).alias("lang_under"), "n_kept", "blocks", _block(F.col("source"), F.col("blocks")).alias("block"))


def _block(source: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(source), blocks).cast("int")


def _compare(vectors: pa.Table, sources: pa.Table) -> pa.Table:
    """For a part of a tile: the sum over its distinct vectors for each pair of sources, and the terms it covers."""
    names = ["lang", "source", "other", "value", "covered"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    if not vectors.num_rows or not sources.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in types], names)
    own, under = sources.column("source").to_pylist(), sources.column("under").to_numpy()
    block, (a, b) = sources.column("block").to_numpy(), (vectors.column(c)[0].as_py() for c in "ab")
    at = {s: i for i, s in enumerate(own)}
    times = vectors.column("times").to_numpy()
    entries = vectors.column("vector").combine_chunks()
    sizes, flat = entries.value_lengths().to_numpy(), entries.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.array([at[s] for s in flat.field("source").to_pylist()], np.int64)
    n = flat.field("n").to_numpy()
    edges = np.concatenate([[0], np.cumsum(sizes)])
    value = np.zeros((len(own), len(own)), np.int64)
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    for lo in range(0, len(sizes), MATRIX_ROWS):
        hi = min(lo + MATRIX_ROWS, len(sizes))
        part = slice(edges[lo], edges[hi])
        counts = np.zeros((hi - lo, len(own)), np.int64)
        counts[row[part] - lo, place[part]] = n[part]
        p = _shares(counts, under)
        for i in left:
            others = right[right > i] if a == b else right
            apart = p[:, [i]] - p[:, others]
            value[i, others] += times[lo:hi] @ (apart * apart // (p[:, [i]] + p[:, others]))
    i, j = np.nonzero(np.triu(np.ones_like(value), 1)) if a == b else (np.repeat(left, len(right)), np.tile(right, len(left)))
    out = [[vectors.column("lang")[0].as_py()] * len(i), [own[k] for k in i], [own[k] for k in j], value[i, j], np.full(len(i), times.sum())]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language."""
    langs = totals.groupBy("lang").agg(F.first("blocks").alias("blocks"), F.ceil(F.first("n_kept") / PART_VECTORS).cast("int").alias("parts"))
    zero = F.lit(0)
    own = F.array_distinct(F.transform("vector", lambda e: _block(e["source"], F.col("blocks"))))
    tiles = F.flatten(F.transform(own, lambda x: F.transform(F.sequence(zero, F.col("blocks") - 1), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    placed = kept.join(langs, "lang").select("lang", "blocks", "parts", "vector", F.explode(F.array_distinct(tiles)).alias("tile")).select("lang", "blocks", "parts", "tile.a", "tile.b", "vector")
    seen = F.filter("vector", lambda e: _block(e["source"], F.col("blocks")).isin(F.col("a"), F.col("b")))
    distinct = placed.select("lang", "parts", "a", "b", seen.alias("vector")).groupBy("lang", "parts", "a", "b", "vector").agg(F.count("*").alias("times"))
    distinct = distinct.withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")).drop("parts")

    sides = totals.join(langs.select("lang", "parts"), "lang").where("parts > 0").withColumn("o", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    sides = sides.select("lang", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), "block", "source", "under", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"))
    key = ["lang", "a", "b", "part"]
    partial = distinct.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(_compare, "lang string, source string, other string, value long, covered long")
    sums = partial.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))
    sums = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value", "covered"))

    one = totals.select("lang", "source", F.col("under").alias("p_under"), "n_kept")
    two = totals.select("lang", F.col("source").alias("other"), F.col("under").alias("q_under"))
    pairs = one.join(two, "lang").where("source <> other").join(sums, ["lang", "source", "other"], "left")
    unseen = F.when(F.col("n_kept") > 0, divergence(share(zero.cast("long"), F.col("p_under")), share(zero.cast("long"), F.col("q_under")))).otherwise(0)
    value = F.coalesce("value", zero) + (F.col("n_kept") - F.coalesce("covered", zero)) * unseen
    return pairs.select("lang", "source", F.col("other").alias("item"), value.alias("value"))


def term_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms that a source has more often than its language."""
    each = kept.select("lang", F.col("term").alias("item"), "total", F.explode("vector").alias("e")).select("lang", "item", "total", "e.source", "e.n")
    shares = each.join(totals.select("lang", "source", "under", "lang_under"), ["lang", "source"]).select("lang", "source", "item", share(F.col("n"), F.col("under")).alias("p"), share(F.col("total"), F.col("lang_under")).alias("q"))
    return shares.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources by divergence (part ``pair``) and a source's own terms (part ``term``).

    Null text, language and source are ''. Terms are runs of ASCII letters and
    of characters beyond ASCII, with A-Z in lower case; a language keeps those in
    ``least_docs`` of its rows. Repeated rows and ids count as rows of their own;
    a group without kept terms has only pairs, of value 0 if its language keeps no
    term; the only source of a language has none. Ties go to the item that comes
    first in UTF-8. An empty table gives no rows; other columns are ignored.
    Sums stay exact for up to 9 * 10**15 occurrences in a language.
    """
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term_counts")
    kept = materialize(kept_terms(counts, least_docs), "kept_terms")
    totals = materialize(group_totals(counts, kept), "group_totals")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pair_values(kept, totals), "pair").unionByName(ranked(term_values(kept, totals), "term").where(F.col("rank") <= top_terms))
