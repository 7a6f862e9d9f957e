"""Language identification with interpolated Kneser-Ney character models.

A text is a row of words (letter runs, lower case); a word is its letters and an
end sign, each predicted from the four characters before it within the word. For
every language the model interpolates the discounted counts of the full context
with those of shorter ones, whose counts are numbers of distinct predecessors.

Counts come from all training documents: tasks add up n-grams, Spark adds up the
tasks and counts the shorter orders, contexts and discounts from every n-gram.
Tasks write the counts as shards (sorted 60-bit hashes with the counts of each
language beside them) to the shared folder, where scoring tasks map them into
memory; the driver gets the languages and their discounts only.

The language with the lowest cross-entropy per character wins. The temperature
of the score and the rejection threshold (text unlike every language) are
calibrated on at most ``CALIBRATION_ROWS`` distinct training texts, an eighth of
them at most, which are chosen by hash and stay out of the counts.

A letter is a character of a Unicode category L; numerals such as ``²`` are none.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.samples import least_hashed
from ledgerloom.llm.scratch import materialize, shared_dir

ORDER = 5
BITS = 12
START, END = 2, 3
CHUNK_CHARS = 2 << 20
SHARD_ROWS = 1 << 18
CALIBRATION_ROWS = 2000
REJECT_QUANTILE = 0.999
CALIBRATION_SHARE = 8
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The letter runs of a text, lower case."""
    runs = WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hash at every predicted character, and the first of each word."""
    mark = chr(START) * (ORDER - 1)
    points = np.frombuffer((mark + (chr(END) + mark).join(words) + chr(END)).encode("utf-32-le"), np.uint32).astype(np.int64)
    half = 1 << (BITS - 1)
    points = np.where(points < half, points, half + points % half)
    grams = np.zeros(len(points) - ORDER + 1, np.int64)
    for i in range(ORDER):
        grams = (grams << BITS) | points[i : i + len(grams)]
    grams = grams[points[ORDER - 1 :] != START]
    ends = np.flatnonzero((grams & ((1 << BITS) - 1)) == END)
    return grams, np.concatenate([[0], ends[:-1] + 1])


def _merge(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}

    def add(lang: str, words: Counter) -> None:
        if words:
            grams, first = codes_of(list(words))
            weight = np.repeat(np.array(list(words.values()), np.int64), np.diff(np.append(first, len(grams))))
            mine = held.setdefault(lang, ([], []))
            keys, counts = _merge([grams], [weight])
            mine[0].append(keys)
            mine[1].append(counts)
            if sum(map(len, mine[0])) > 3_000_000:
                keys, counts = _merge(*mine)
                held[lang] = ([keys], [counts])

    for batch in batches:
        words: dict[str, Counter] = {}
        chars = 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            words.setdefault(lang, Counter()).update(words_of(text))
            chars += len(text)
            if chars > CHUNK_CHARS:
                for k, v in words.items():
                    add(k, v)
                words, chars = {}, 0
        for k, v in words.items():
            add(k, v)
    for lang, parts in held.items():
        keys, counts = _merge(*parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "count"])


def gram_counts(training: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    rows = training.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(_count, "lang string, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _place(table: int) -> int:
    """The table number in the four bits over a hash: n - 1 for n-grams, ORDER + n - 1 for their contexts."""
    return (table << 60) - (1 << 64 if table > 7 else 0)


def _parts(keys: np.ndarray, langs: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """A shard: sorted distinct keys, where each one's rows start, and the rows' languages and numbers."""
    order = np.lexsort((langs, keys))
    keys, first = np.unique(keys[order], return_index=True)
    return [keys, np.append(first, len(order)).astype(np.int64), langs[order].astype(np.int64), x[order].astype(np.int64), y[order].astype(np.int64)]


def _file(folder: str, shard: int) -> tuple[fs.FileSystem, str]:
    path = f"{re.sub('^file:/+', '/', folder)}/{shard}.arrays"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _write(folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        system, path = _file(folder, shard)
        parts = _parts(*(table.column(c).to_numpy() for c in ("key", "lang", "x", "y")))
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            out.write(np.array([len(p) for p in parts], np.int64).tobytes())
            for part in parts:
                out.write(part.tobytes())
        system.move(own, path)
        return pa.table({"shard": pa.array([shard], pa.int64())})

    return run


_OPENED: dict[tuple[str, int], list[np.ndarray]] = {}


@dataclass
class Shards:
    """Counts by key and language: in files of the shared folder, or (``held``) in memory as one shard."""

    count: int
    folder: str = ""
    filled: frozenset[int] = frozenset()
    held: list[np.ndarray] | None = None

    def parts(self, shard: int) -> list[np.ndarray]:
        if self.held is not None:
            return self.held
        if (self.folder, shard) not in _OPENED:
            system, path = _file(self.folder, shard)
            if shard not in self.filled:
                parts = _parts(*(np.zeros(0, np.int64) for _ in range(4)))
            else:
                source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
                whole = np.frombuffer(source.read_buffer(), np.int64)
                parts = np.split(whole[5:], np.cumsum(whole[:4]))
            _OPENED[self.folder, shard] = parts
        return _OPENED[self.folder, shard]

    def find(self, keys: np.ndarray, langs: int) -> tuple[np.ndarray, np.ndarray]:
        """Both numbers of each key and language; 0 where there are none."""
        x, y = np.zeros((len(keys), langs)), np.zeros((len(keys), langs))
        own = np.mod(keys, self.count)
        order = np.argsort(own, kind="stable")
        for shard, rows in zip(np.unique(own).tolist(), np.split(order, np.flatnonzero(np.diff(own[order])) + 1), strict=True):
            known, first, lang, one, two = self.parts(shard)
            at, found = _lookup(known, keys[rows])
            rows, at = rows[found], at[found]
            size = first[at + 1] - first[at]
            entry = np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            rows = np.repeat(rows, size)
            x[rows, lang[entry]], y[rows, lang[entry]] = one[entry], two[entry]
        return x, y


@dataclass
class Model:
    """The counts of all n-grams and contexts, and the discounts by order and language."""

    langs: list[str]
    discount: np.ndarray
    shards: Shards
    floor: float
    temperature: float = 1.0
    reject_over: float = np.inf

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        """Natural logs by n-gram and language: discounted counts, interpolated from the shortest order on."""
        distinct, inverse = np.unique(grams, return_inverse=True)
        prob = np.full((len(distinct), len(self.langs)), np.exp(self.floor))
        for n in range(1, ORDER + 1):
            keys, back = np.unique(distinct & ((1 << (BITS * n)) - 1), return_inverse=True)
            number, _ = self.shards.find(keys | _place(n - 1), len(self.langs))
            contexts, own = np.unique(keys >> BITS, return_inverse=True)
            total, kinds = (t[own] for t in self.shards.find(contexts | _place(ORDER + n - 1), len(self.langs)))
            some = np.maximum(total, 1)
            seen = np.where(number > 0, (number - self.discount[n]) / some, 0)
            prob = seen[back] + np.where(total > 0, self.discount[n] * kinds / some, 1)[back] * prob
        return np.log(prob)[inverse]

    def word_logs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities and predicted characters of each word."""
        grams, first = codes_of(words)
        return np.add.reduceat(self.log_prob(grams), first, axis=0), np.diff(np.append(first, len(grams)))


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _floor(alphabet: int) -> float:
    return -float(np.log(max(2, alphabet) + 1))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of n-gram counts held in memory; ``train`` makes the same one in Spark."""
    langs = sorted(counts)
    discount, rows, letters = np.full((ORDER + 1, len(langs)), 0.5), [], []
    for k, lang in enumerate(langs):
        grams, number = counts[lang]
        for n in range(ORDER, 0, -1):
            discount[n, k] = _discount((number == 1).sum(), (number == 2).sum())
            contexts, own = np.unique(grams >> BITS, return_inverse=True)
            total = np.bincount(own, weights=number, minlength=len(contexts))
            rows.append((grams | _place(n - 1), np.full(len(grams), k), number, np.zeros(len(grams))))
            rows.append((contexts | _place(ORDER + n - 1), np.full(len(contexts), k), total, np.bincount(own, minlength=len(contexts))))
            if n > 1:
                grams, number = np.unique(grams & ((1 << (BITS * (n - 1))) - 1), return_counts=True)
        letters.append(grams)
    parts = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
    return Model(langs, discount, Shards(1, held=_parts(*parts)), _floor(len(np.unique(np.concatenate(letters))) if letters else 0))


def _prime(least: int) -> int:
    while any(least % k == 0 for k in range(2, int(least**0.5) + 1)):
        least += 1
    return least


def learn(counts: DataFrame) -> Model:
    """The model of ``lang, gram, count``: every statistic is a Spark aggregate over all n-grams."""
    spark = counts.sparkSession
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return build({})
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("long") - 1
    table = materialize(counts.select(number.alias("lang"), "gram", "count"), f"grams-{ORDER}")
    discount, rows = np.full((ORDER + 1, len(langs)), 0.5), []
    for n in range(ORDER, 0, -1):
        for r in table.groupBy("lang").agg(F.sum((F.col("count") == 1).cast("long")).alias("ones"), F.sum((F.col("count") == 2).cast("long")).alias("twos")).collect():
            discount[n, r.lang] = _discount(r.ones, r.twos)
        rows.append(table.select(F.col("gram").bitwiseOR(F.lit(_place(n - 1))).alias("key"), "lang", F.col("count").alias("x"), F.lit(0).cast("long").alias("y")))
        contexts = table.groupBy(F.shiftright("gram", BITS).alias("context"), "lang").agg(F.sum("count").alias("x"), F.count("*").alias("y"))
        rows.append(contexts.select(F.col("context").bitwiseOR(F.lit(_place(ORDER + n - 1))).alias("key"), "lang", "x", "y"))
        if n > 1:
            shorter = table.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (n - 1))) - 1)).alias("gram")).agg(F.count("*").alias("count"))
            table = materialize(shorter, f"grams-{n - 1}")
    union = rows[0]
    for part in rows[1:]:
        union = union.unionByName(part)
    union = materialize(union, "gram-rows")
    shards = _prime(max(31, -(-union.count() // SHARD_ROWS)))
    folder = f"{shared_dir(spark)}/ledgerloom/gram-shards-{uuid.uuid4().hex}"
    written = union.withColumn("shard", F.pmod("key", F.lit(shards).cast("long"))).groupBy("shard").applyInArrow(_write(folder), "shard long")
    filled = frozenset(r.shard for r in written.collect())
    return Model(langs, discount, Shards(shards, folder, filled), _floor(table.select("gram").distinct().count()))


def score_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text and language (nats), and characters; no letters: none."""
    words = [words_of(t) if t else [] for t in texts]
    number: dict[str, int] = {}
    for row in words:
        for w in row:
            if w not in number:
                number[w] = len(number)
    sums, sizes = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    if number and model.langs:
        logs, lengths = model.word_logs(list(number))
        for i, row in enumerate(words):
            if row:
                own = np.fromiter(map(number.__getitem__, row), np.int64, len(row))
                sums[i], sizes[i] = logs[own].sum(axis=0), lengths[own].sum()
    return -sums / np.maximum(sizes, 1)[:, None], sizes


def posterior(entropy: np.ndarray, temperature: float) -> np.ndarray:
    z = -entropy * temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def calibration_cut(rows: DataFrame) -> int:
    """Texts with a hash up to this are for calibration."""
    total = rows.count()
    keys = least_hashed(rows.select(F.xxhash64("text").alias("key")).distinct(), "key", CALIBRATION_ROWS, total)
    most = keys.agg(F.max("key")).first()[0]
    share = -(1 << 63) + (1 << 64) // CALIBRATION_SHARE
    return share if most is None else min(most, share)


def train(training: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn from every row with a language and a text, but for those that calibrate (all, if a language has no others)."""
    rows = training.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    cut = calibration_cut(rows)
    aside = F.xxhash64("text") <= cut
    kept = rows.groupBy("lang").agg(F.bool_or(~aside).alias("some")).collect()
    counted = ~aside | F.col("lang").isin([r.lang for r in kept if not r.some])  # a language of few texts stays
    model = learn(materialize(gram_counts(rows.where(counted), "lang", "text"), "grams"))
    if model.langs:
        calibrate(model, rows.where(F.xxhash64("text") <= cut))
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Set the temperature and the rejection threshold from scored ``lang, text`` that are not in the counts."""
    chosen = rows.groupBy(F.xxhash64("text").alias("key"), "lang").agg(F.first("text").alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    scored = chosen.select("lang", "text").mapInArrow(_entropies(shared), "lang string, entropy array<double>").collect()
    scored = sorted((r for r in scored if r.lang in model.langs), key=lambda r: (r.lang, r.entropy))
    if scored:
        entropy = np.array([r.entropy for r in scored])
        truth = np.array([model.langs.index(r.lang) for r in scored])
        grid = [2.0**k for k in range(-2, 8)]
        loss = [-np.log(posterior(entropy, t)[np.arange(len(truth)), truth] + 1e-9).mean() for t in grid]
        model.temperature = grid[int(np.argmin(loss))]
        model.reject_over = float(np.quantile(entropy.min(axis=1), REJECT_QUANTILE)) * 1.05


def _entropies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                entropy, sizes = score_texts(shared.value, part.column(1).to_pylist())
                keep = sizes > 0
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), pa.array(entropy[keep].tolist(), pa.list_(pa.float64()))], ["lang", "entropy"])

    return run


PREDICTION = "lang_pred string, score double, cross_entropy double, rejected boolean"


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                texts, chars = [], 0
                while lo + len(texts) < batch.num_rows and (not texts or chars < CHUNK_CHARS):
                    texts.append(batch.column(1)[lo + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                entropy, sizes = score_texts(model, texts)
                known = (sizes > 0) & bool(model.langs)
                best = entropy.argmin(axis=1) if model.langs else np.zeros(len(texts), np.int64)
                line = np.arange(len(texts))
                score = np.where(known, posterior(entropy, model.temperature)[line, best], 0.0) if model.langs else np.zeros(len(texts))
                lowest = entropy[line, best] if model.langs else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(texts)),
                        pa.array([model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]),
                        pa.array(score),
                        pa.array(lowest, mask=~known),
                        pa.array(~known | (lowest > model.reject_over)),
                    ],
                    ["id", "lang_pred", "score", "cross_entropy", "rejected"],
                )
                lo += len(texts)

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, cross_entropy, rejected`` for every row.

    ``lang_pred`` is ``und`` and the score 0 if the text is null or has no
    letter (or nothing was learned). ``rejected`` marks those and texts whose
    cross-entropy is over the calibrated threshold. Ties go to the first
    language in sorted order; repeated rows are each scored; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(shared), f"id {rows.schema['id'].dataType.simpleString()}, {PREDICTION}").withColumnRenamed("id", id_col)
