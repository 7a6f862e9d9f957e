"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features come from words: densities of lexicon words, how near a second
person they stand, capitals, punctuation and obfuscation (swapped digits and
signs, stretched and spaced-out words). The lexicon is a short fixed list and
terms learned from the labelled sample: words, and stems of four to six letters,
found in toxic documents far more often than in others.

Training takes at most ``SAMPLE_PER_CLASS`` labelled documents of each class,
weighted so that the classes keep their shares of all labelled documents. A
fourth of the texts, chosen by hash, only calibrates: neither terms nor trees are
learned from it. Scoring reads every text whole; a task looks at a token once and
keeps what it found in a bounded cache.

Defined cases: null and empty texts count as a text without words; repeated rows
and rows with null ids are each scored; without labels of both classes every
text gets the learned base; ties of terms go by their letters; an empty table
gives no rows; other columns are ignored, or kept by ``drop_toxic``, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.gbdt import Boosting, Forest, Isotonic, fit
from ledgerloom.llm.samples import weighted
from ledgerloom.llm.scratch import handing_back, materialize

SAMPLE_PER_CLASS = 6000
MAX_TERMS = 512
STEMS = (4, 5, 6)
#: A term must be in this share of the toxic sample and in this many documents.
LEAST_SHARE, LEAST_DOCS = 0.01, 4
#: How much likelier it must be in toxic documents.
LEAST_RATIO = 8.0
CHUNK_CHARS = 1 << 20
NEAR = 6

#: Common insults, and second-person words of four languages.
INSULTS = frozenset("idiot moron loser stupid dumb trash scum pathetic worthless disgusting clown imbecile pig creep idiota estúpido imbécil basura idiot dumm arschloch abschaum imbécile crétin ordure".split())
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split())
#: Signs that stand for letters.
SWAPS = str.maketrans("013457@$!|", "oieastasil")

_LETTERS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][0-9@$!|*]+[^\W\d_]")
_STRETCH = re.compile(r"(\w)\1{2,}")
_LOOSE = re.compile(r"[^\W\d_](?:[.\-*_][^\W\d_])*")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-*_]){2,}[^\W\d_](?!\S)")

FEATURES = (
    "hits", "density", "distinct", "weight", "weight_density", "fixed_hits", "near_you", "you_density", "obfuscated_hits", "obfuscated_rate", "stretched_rate",
    "capitals", "shouted_words", "punctuation", "exclamations", "words", "mean_word", "digits",
)


@dataclass
class Lexicon:
    """Terms with weights (log ratio); stems match the first letters of longer words."""

    words: dict[str, float]
    stems: dict[str, float]

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems}

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found


def _terms(text: str) -> set[tuple[str, int]]:
    words = set(_LETTERS.findall(text.lower()))
    return {(w, 0) for w in words if len(w) > 2} | {(w[:n], n) for w in words for n in STEMS if len(w) >= n}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            seen = (Counter(), Counter())
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen[label].update(_terms(text))
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in terms]), pa.array([n for _, n in terms], pa.int32()), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)],
                ["term", "stem", "clean", "toxic"],
            )


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """The terms of the sample that mark toxic documents, counted in Spark."""
    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    lexicon = Lexicon({w: 4.0 for w in INSULTS}, {})
    if not clean or not toxic:
        return lexicon
    counted = sample.mapInArrow(_count_terms, "term string, stem int, clean long, toxic long").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    marked = counted.where((F.col("toxic") >= max(LEAST_DOCS, math.ceil(LEAST_SHARE * toxic))) & (ratio >= LEAST_RATIO))
    for r in marked.select("term", "stem", ratio.alias("ratio")).orderBy(F.desc(F.col("toxic") * F.log("ratio")), "term", "stem").limit(MAX_TERMS).collect():
        (lexicon.stems if r.stem else lexicon.words)[r.term] = math.log(r.ratio)
    return lexicon


def _token_traits(token: str, lexicon: Lexicon) -> tuple[float, ...]:
    """weight, fixed, second person, obfuscated weight, obfuscated, stretched, shouted, exclamations, letters, digits, signs, capitals."""
    low = token.lower()
    words = _LETTERS.findall(low)
    weight = max(map(lexicon.weight, words), default=0.0)
    letters = sum(map(len, words))
    digits = sum(c.isdigit() for c in token) if letters < len(token) else 0
    hidden = obfuscated = 0.0
    if letters < len(token) and _MIXED.search(low):
        obfuscated = 1.0
        plain = low.translate(SWAPS)
        hidden = max([lexicon.weight(w) for w in _LETTERS.findall(plain)] + [lexicon.weight("".join(words))])
    stretched = bool(_STRETCH.search(low))
    if stretched and not weight:
        hidden = max(hidden, max((lexicon.weight(_STRETCH.sub(r"\1", w)) for w in words), default=0.0))
    capitals = sum(map(str.isupper, token)) if token != low else 0
    return (
        weight, float(any(w in INSULTS for w in words)), float(any(w in SECOND_PERSON for w in words)), hidden, obfuscated, float(stretched),
        float(letters > 2 and capitals == letters), float(token.count("!")), float(letters), float(digits), float(len(token) - letters - digits), float(capitals),
    )


#: Tokens that a worker remembers; a full cache is emptied.
CACHE_TOKENS = 300_000


class Traits:
    """Numbers of tokens with their traits, kept from chunk to chunk."""

    def __init__(self):
        self.number, self.table, self.loose, self.plain = {}, np.zeros((0, 12)), np.zeros(0, np.int8), np.zeros(0, np.int64)
        self.words: dict[str, int] = {}

    def learn(self, tokens: set[str], lexicon: Lexicon) -> None:
        fresh = [t for t in tokens if t not in self.number]
        if fresh and len(self.number) + len(fresh) > CACHE_TOKENS:
            self.__init__()
            fresh = list(tokens)
        if fresh:
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, np.array([_token_traits(t, lexicon) for t in fresh], float).reshape(-1, 12)])
            self.loose = np.append(self.loose, np.array([min(3, (len(t) + 1) // 2) if _LOOSE.fullmatch(t) else 0 for t in fresh], np.int8))
            first = [w[0] if (w := _LETTERS.findall(t.lower())) else "" for t in fresh]
            self.plain = np.append(self.plain, [self.words.setdefault(w, len(self.words)) for w in first])

    def of(self, tokens: list[str]) -> np.ndarray:
        """The number of each token, all learned before."""
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))


def _traits(lexicon: Lexicon) -> Traits:
    """The worker's traits for a lexicon; they go when Spark takes the lexicon's broadcast from the worker."""
    return lexicon.__dict__.setdefault("_traits", Traits())


def _may_be_spaced(loose: np.ndarray) -> bool:
    """Whether a spaced-out word can be among tokens: one of three letters, or two such tokens side by side."""
    return bool((loose > 2).any() or ((loose[1:] > 0) & (loose[:-1] > 0)).any())


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """One row per text, in the order of ``FEATURES``."""
    known, rows = _traits(lexicon), [t.split() for t in texts]
    known.learn({token for row in rows for token in row}, lexicon)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, (row, text) in enumerate(zip(rows, texts, strict=True)):
        if not row:
            continue
        own = known.of(row)
        t = known.table
        s = np.bincount(own, minlength=len(t)) @ t if len(row) > len(t) else t[own].sum(axis=0)
        weight = np.maximum(t[own, 0], t[own, 3])
        at = np.flatnonzero(weight)
        spaced = []
        if _may_be_spaced(known.loose[own]):
            spaced = [max(lexicon.weight(w), lexicon.weight(w.translate(SWAPS))) for m in _SPACED.findall(text) if (w := re.sub(r"[ .\-*_]", "", m.lower()))]
        near = 0
        if len(at) and s[2]:
            you = np.flatnonzero(t[own, 2])
            gap = np.searchsorted(you, at)
            least = np.minimum(np.abs(you[np.minimum(gap, len(you) - 1)] - at), np.abs(you[np.maximum(gap - 1, 0)] - at))
            near = int((least <= NEAR).sum())
        hits = len(at) + sum(x > 0 for x in spaced)
        total = float(weight.sum() + sum(spaced))
        words, letters, chars = len(row), max(1.0, s[8]), max(1.0, s[8] + s[9] + s[10])
        out[i] = (
            hits, hits / words, len(np.unique(known.plain[own[at]])), total, total / words, s[1], near, s[2] / words, int((t[own[at], 3] > 0).sum()) + sum(x > 0 for x in spaced),
            s[4] / words, s[5] / words, s[11] / letters, s[6] / words, s[10] / chars, s[7] / words, math.log1p(words), s[8] / words, s[9] / chars,
        )
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    lo = 0
    while lo < len(column):
        texts, chars = [], 0
        while lo + len(texts) < len(column) and (not texts or chars < CHUNK_CHARS):
            texts.append(column[lo + len(texts)].as_py() or "")
            chars += len(texts[-1])
        yield lo, texts
        lo += len(texts)


def _featurise(lexicon: Lexicon):
    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _chunks(batch.column(0)):
                x = features(texts, lexicon)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1).slice(lo, len(texts)), batch.column(2).slice(lo, len(texts)), batch.column(3).slice(lo, len(texts))], ["x", "label", "weight", "aside"])

    return run


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    forest: Forest
    calibration: Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        return np.clip(self.calibration(self.forest.score(features(texts, self.lexicon))), 0, 1)


def train(sample: DataFrame, boosting: Boosting = Boosting()) -> ToxicityModel:
    """``sample``: text, label (0 or 1), weight if rows stand for others too, bounded."""
    sample = materialize(weighted(sample).withColumn("aside", F.pmod(F.xxhash64("text"), F.lit(4)) == 3), "toxic-sample")
    lexicon = learn_lexicon(sample.where("not aside"))
    rows = sample.mapInArrow(_featurise(lexicon), "x array<double>, label int, weight double, aside boolean").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows.column("label").to_numpy().astype(float)
    weight = rows.column("weight").to_numpy()
    order = np.lexsort((y, *x.T))
    x, y, weight = x[order], y[order], weight[order]
    aside = rows.column("aside").to_numpy()[order]
    forest = fit(x[~aside], y[~aside], boosting, weight[~aside])
    return ToxicityModel(lexicon, forest, Isotonic.fit(forest.score(x[aside]), y[aside], weight[aside]))


def _score(shared):
    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(shared.value.score(texts))], ["id", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row; null and empty texts count as a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(shared), f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def _keep(shared, at: int, threshold: float):
    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _chunks(batch.column(at)):
                yield batch.slice(lo, len(texts)).filter(pa.array(shared.value.score(texts) < threshold))

    return run


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; a map without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, docs.columns.index(text_col), threshold), docs.schema)
