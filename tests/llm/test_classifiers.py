"""Language, toxicity, quality and secrets: held-out accuracy, and plain versions of the parts."""

import hashlib
import math
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid, quality, queries, samples, secrets, toxicity
from ledgerloom.llm.gbdt import Boosting, Isotonic, fit, fit_random_forest

LARGER = Path(os.environ.get("LEDGERLOOM_LARGER", "/root/testdata/sf0.01"))
DOCS = "doc_id long, text string, id int, score string, label string"


@pytest.fixture(scope="module")
def larger():
    if not LARGER.exists():
        pytest.skip("no test tables")
    return str(LARGER)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def held_out(spark, sf_dir, out, label):
    rows = out.where("held_out").join(queries.table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("y")), "doc_id").where("y is not null").collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r.y for r in rows])


def test_op4(spark, larger):
    out = queries.op4_language_id(spark, larger)
    docs = queries.table(spark, larger, "documents")
    rows = out.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert out.count() == docs.count()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_kneser_ney_sums_to_one():
    words = {"a": ["the", "then", "hat"], "b": ["der", "die", "das"]}
    counts = {k: np.unique(langid.codes_of(w)[0], return_counts=True) for k, w in words.items()}
    model = langid.build(counts)
    letters = sorted(set("".join(sum(words.values(), []))))
    mask = (1 << langid.BITS) - 1
    for start in ("t", "the", "d", "q"):
        head = langid.codes_of([start])[0][len(start) - 1]
        nexts = np.array([((head & ((1 << (langid.BITS * 4)) - 1)) << langid.BITS | c) for c in [*map(ord, letters), langid.END]])
        total = np.exp(model.log_prob(nexts)).sum(axis=0)
        assert (nexts & mask).tolist() == [*map(ord, letters), langid.END]
        assert ((total <= 1 + 1e-9) & (total > 0.85)).all()  # the rest is for letters never seen


def test_all_grams_are_kept_in_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [(lang, " ".join("".join(rng.choice([*letters], rng.integers(1, 9))) for _ in range(40))) for lang, letters in (("a", "abcdefgh"), ("b", "efghijé"), ("c", "xyzab")) for _ in range(20)]
    training = spark.createDataFrame(texts, "lang string, text string")
    monkeypatch.setattr(langid, "SHARD_ROWS", 100)
    counts = {k: np.unique(langid.codes_of(langid.WORD.findall(" ".join(t for lang, t in texts if lang == k)))[0], return_counts=True) for k in "abc"}
    plain, trained = langid.build(counts), langid.learn(langid.gram_counts(training, "lang", "text"))
    assert sum(len(g) for g, _ in counts.values()) > 5000 and trained.shards.count > 100 and trained.shards.held is None
    assert np.allclose(plain.discount, trained.discount) and plain.floor == trained.floor
    seen = np.concatenate([g for g, _ in counts.values()])
    odd = langid.codes_of(["zebra", "hat", "ëë"])[0]
    assert np.allclose(plain.log_prob(np.append(seen, odd)), trained.log_prob(np.append(seen, odd)))
    for k, (grams, number) in enumerate(counts.values()):  # those seen once too
        number_of, _ = trained.shards.find(grams | langid._place(langid.ORDER - 1), 3)
        assert number_of[:, k].tolist() == number.tolist() and 1 in number


def test_language_cases(spark):
    rows = [(i, t, 1, None, lang) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("der hund und die katze", "de")] * 20)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs, lang_col="label")
    odd = spark.createDataFrame([(100, None, 1, "", ""), (101, "", 1, "", ""), (102, "12 !?", 1, "", ""), (103, "the hat " * 30_000, 1, "", ""), (103, "the hat", 1, "", ""), (None, "die katze", 1, "", "")], DOCS)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()]
    assert got == [(100, "und"), (101, "und"), (102, "und"), (103, "en"), (103, "en"), (None, "de")]
    nothing = langid.train(docs.where("false"), lang_col="label")
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.where("false"), model).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", 0.9), ("op10_quality_classifier", "quality", 0.85)])
def test_held_out(spark, larger, name, label, least):
    out = queries.QUERIES[name](spark, larger)
    score, predicted, y = held_out(spark, larger, out, label)
    assert out.count() == queries.table(spark, larger, "documents").count()
    assert ((score >= 0) & (score <= 1)).all()
    assert auc(score, y) >= least
    assert (predicted == (score >= (0.5 if label == "toxic" else 0.3))).all()


def test_spaced_words_of_long_texts():
    lexicon = toxicity.Lexicon({"idiot": 4.0}, {})
    calm = "calm words " * 400_000
    row = dict(zip(toxicity.FEATURES, toxicity.features([f"i d i o t {calm}i-d-i-o-t"], lexicon)[0], strict=True))
    assert len(calm) > 1 << 22
    assert (row["hits"], row["weight"], row["obfuscated_hits"]) == (2, 8, 2)


def labelled(spark):
    rows = [(f"you are a {w} {i}" if i % 2 else f"a calm word about {w} {i}", i % 2) for i, w in enumerate(["idiot", "garden"] * 60)]
    rows = [(t if y else t.replace("idiot", "river"), y) for t, y in rows]
    return spark.createDataFrame(rows, "text string, label int")


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_cases(spark, module):
    odd = spark.createDataFrame([(1, None, 1, "", ""), (2, "", 1, "", ""), (3, "Y0u !!! id1ot", 1, "", ""), (3, "Y0u !!! id1ot", 1, "", ""), (None, "\n \t", 1, "", ""), (5, "word " * 100_000, 1, "", "")], DOCS)
    for sample in (labelled(spark), labelled(spark).where("label = 1"), labelled(spark).where("false")):
        model = module.train(sample)
        rows = module.score(odd, model).collect()
        assert [r.doc_id for r in rows] == [1, 2, 3, 3, None, 5]
        assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
        assert rows[2].score == rows[3].score and rows[0].score == rows[1].score
    assert module.score(odd.where("false"), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_capped_classes_keep_their_shares(spark, module):
    # One document in three says "idiot"; one in three of those is labelled 1, and no other.
    rng = np.random.default_rng(3)
    filler = [" ".join("".join(rng.choice([*"abcdefgh"], rng.integers(1, 9))) for _ in range(rng.integers(5, 40))) if module is toxicity else f"number {i}" for i in range(3000)]
    rows = [(i, f"you {'idiot !!' if i % 3 == 0 else 'garden'} {filler[i]}", int(i % 3 == 0 and i // 3 % 3 == 0)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    marked = {i for i, _, _ in rows if i % 3 == 0}
    for cap in (5000, 300):
        sample = samples.labelled_sample(docs, docs, "label", cap).cache()
        assert sample.groupBy("label").agg(F.round(F.sum("weight")).alias("n")).orderBy("label").collect() == [(0, 2666), (1, 334)]
        assert sample.count() == (3000 if cap == 5000 else 600)
        scored = module.score(docs, module.train(sample)).collect()
        for rows_of, share in ((marked, 1 / 3), ({*range(3000)} - marked, 0)):
            assert abs(np.mean([r.score for r in scored if r.doc_id in rows_of]) - share) < 0.1


def test_drop_toxic_keeps_columns(spark):
    model = toxicity.train(labelled(spark))
    docs = spark.createDataFrame([(1, "x", 1, "a", "b"), (2, None, 2, None, None)], DOCS)
    out = toxicity.drop_toxic(docs, model, threshold=1.1)
    assert out.schema == docs.schema and out.count() == 2


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    for forest in (fit(x, y, Boosting(trees=20)), fit_random_forest(x, y, trees=10)):
        inner = forest.feature.shape[1]
        for row, got in zip(x[:50], forest.margin(x[:50]), strict=True):
            total = forest.base
            for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
                at = 0
                while at < inner:
                    at = 2 * at + 1 + int(row[feature[at]] > cut[at])
                total += leaf[at - inner]
            assert abs(total - got) < 1e-9
        assert ((forest.score(x) if forest.base else forest.margin(x)) > 0.5).astype(float).tolist() != [0.0] * 500
    assert (((fit(x, y).score(x) > 0.5) == y).mean()) > 0.95


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    score = rng.random(400)
    y = (rng.random(400) < score).astype(float)
    curve = Isotonic.fit(score, y)(np.linspace(0, 1, 50))
    assert (np.diff(curve) >= 0).all() and abs(curve.mean() - 0.5) < 0.1


def test_secret_forest_held_out(spark):
    findings = secrets.labelled_findings(spark, rows=1500)
    forest = secrets.train(findings, trees=40)
    fresh = secrets.labelled_findings(spark, rows=600, seed=11).collect()
    x = np.array([secrets.describe(r.candidate, r.before, r.after, r.rule) for r in fresh], float)
    assert ((forest.margin(x) >= 0.5) == np.array([r.secret == 1 for r in fresh])).mean() >= 0.95


def test_secret_scan(spark):
    forest = secrets.train(secrets.labelled_findings(spark, rows=1500), trees=40)
    key = "AKIA" + "ABCDEFGH" + "12345678"
    rows = [(1, f"key {key} end"), (2, "password = changeme"), (3, None), (4, ""), (5, "é" * 70_000 + f" {key}"), (1, f"key {key} end")]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)
    found = secrets.scan(docs, forest).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
        assert rows[[i for i, _ in rows].index(r.doc_id)][1][r.start : r.end] in (key, "changeme")
    assert len(by[1]) == 2 and by[1][0].is_secret and by[5][0].is_secret and by[5][0].start == 70_001
    assert not by[2][0].is_secret and 3 not in by and 4 not in by
    assert secrets.scan(docs.where("false"), forest).count() == 0


def test_headers_and_keys_are_candidates(spark):
    value = "Zq8vR2xT0kLm4NwY7cB1"
    texts = [f"AccountKey={value};", f"Authorization: Bearer {value}", f"sent with bearer {value} today", f"'private_key': '{value}'", f"client-key = {value}", f'authorization="Basic {value}"', f"storageKey: {value}"]
    for text in texts:
        (rule, start, end), = secrets.candidates(text)
        assert rule == "assignment" and text[start:end].rstrip(";") == value
    assert list(secrets.candidates("the bearer certificates of this company, key points: none")) == []
    forest = secrets.train(secrets.labelled_findings(spark, rows=1500), trees=40)
    found = secrets.scan(spark.createDataFrame([(i, t, 1, "", "") for i, t in enumerate(texts)], DOCS), forest).collect()
    assert len(found) == len(texts) and all(r.is_secret for r in found)


def test_long_secrets_are_whole(spark):
    forest = secrets.train(secrets.labelled_findings(spark, rows=1500), trees=40)
    rng = np.random.default_rng(5)
    pick = lambda chars, n: "".join(rng.choice([*chars], n))
    token, key = pick("abcdefghijkXYZ0123456789_-", 2000), pick("0123456789abcdef", 512)
    docs = spark.createDataFrame([(1, f"token={token} end", 1, "x", "y"), (2, f"bearer {key} end", 1, "x", "y")], DOCS)
    found = {r.doc_id: r for r in secrets.scan(docs, forest).collect()}
    for i, secret, rule in ((1, token, "assignment"), (2, key, "bare_hex")):
        assert (found[i].rule, found[i].end - found[i].start) == (rule, len(secret))
        assert found[i].candidate_sha256 == hashlib.sha256(secret.encode()).hexdigest()


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, 1, None, k) for i, (t, k) in enumerate([("the cat and the hat", "en"), ("der hund und die katze", "de")] * 20)], DOCS)
    model = langid.train(docs, lang_col="label")
    odd = spark.createDataFrame([(1, "² ½ ① ٣ 7", 1, "", ""), (2, "x²the", 1, "", ""), (3, "ʰ", 1, "", "")], DOCS)
    assert [r.lang_pred == "und" for r in langid.identify(odd, model).collect()] == [True, False, False]
    assert langid.words_of("A²B ½ Été _x9y") == ["a", "b", "été", "x", "y"]


def test_calibration_texts_are_not_counted(spark):
    rows = [(lang, f"{stem}{chr(97 + i % 26)}{chr(97 + i // 26)}") for lang, stem in (("a", "ab"), ("b", "cd")) for i in range(300)]
    texts = spark.createDataFrame(rows, "lang string, text string")
    cut = langid.calibration_cut(texts)
    aside = texts.where(F.xxhash64("text") <= cut).count()
    assert 0 < aside <= 300 and aside < texts.count() / 4
    model = langid.train(texts)
    _, kinds = model.shards.find(np.array([langid._place(langid.ORDER)]), 2)
    number, _ = model.shards.find(langid.codes_of(["ab"])[0][:1] | langid._place(langid.ORDER - 1), 2)
    assert number[0].tolist() == [300 - texts.where((F.xxhash64("text") <= cut) & (F.col("lang") == "a")).count(), 0]


def test_private_key_is_whole(spark):
    forest = secrets.train(secrets.labelled_findings(spark, rows=600), trees=20)
    body = "\n".join(["MIIEpAIBAAKCAQEA" * 4] * 20)
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\n-----END RSA PRIVATE KEY-----"
    cut = "-----BEGIN PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, f"a {key} b", 1, "x", "y"), (2, f"{cut} never ends " + f"{cut} " * 20_000, 1, "x", "y")], DOCS)
    found = secrets.scan(docs, forest).where("rule = 'private_key'").collect()
    assert [(r.start, r.end) for r in found if r.doc_id == 1] == [(2, 2 + len(key))]
    assert len([r for r in found if r.doc_id == 2]) == 20_001


def test_planted_secrets_recall(spark, larger):
    """Secrets and decoys made here, not by the module's generator, planted in the documents of the table."""
    rng = np.random.default_rng(9)
    pick = lambda chars, n: "".join(rng.choice([*chars], n))
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    secret = [
        lambda: f"aws_access_key_id = AKIA{pick(letters[26:] + digits, 16)}", lambda: f"github: ghp_{pick(letters + digits, 36)}", lambda: f'password = "{pick(letters + digits + "!%&+", 16)}"',
        lambda: f"api_key: {pick('abcdef' + digits, 40)}", lambda: f"slack xoxb-{pick(digits, 12)}-{pick(letters + digits, 24)}", lambda: f"ACCESS_TOKEN={pick(letters + digits + '_-', 48)}",
    ]
    decoy = [lambda: "password = changeme", lambda: f"commit sha1 {pick('abcdef' + digits, 40)}", lambda: "token: your_token_here", lambda: "secret=os.environ[SECRET]", lambda: f"md5 checksum {pick('abcdef' + digits, 32)}"]
    texts = [r.text for r in queries.table(spark, larger, "documents").where("length(text) between 200 and 2000").orderBy("doc_id").limit(240).collect()]
    rows = [(i, f"{t[:100]} {(secret[i // 2 % 6] if i % 2 else decoy[i // 2 % 5])()} {t[100:]}", 1, "", "") for i, t in enumerate(texts)]
    found = secrets.scan(spark.createDataFrame(rows, DOCS), secrets.train(secrets.labelled_findings(spark))).where("start between 95 and 150").collect()
    hit = {r.doc_id for r in found if r.is_secret}
    planted = {i for i in range(len(rows)) if i % 2}
    assert len(hit & planted) >= 0.95 * len(planted)
    assert len(hit - planted) <= 0.1 * (len(rows) - len(planted))


def test_memory_of_quality_features():
    import tracemalloc

    text = b"Some words, and more of them. " * 300_000
    data = np.frombuffer(text, np.uint8)
    tracemalloc.start()
    quality.features(data, np.array([0, len(data)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * len(data)


def test_kneser_ney_against_dictionaries():
    """Interpolated from the shortest order on, with counts of words in dictionaries of strings."""
    import random
    from collections import Counter, defaultdict

    rng = random.Random(8)
    texts = {lang: Counter("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(80)) for lang, letters in (("a", "abcdé"), ("b", "bcdß"))}
    order, start, end = langid.ORDER, chr(langid.START), chr(langid.END)
    model = langid.build({lang: tuple(np.array(x) for x in zip(*sorted(Counter(np.repeat(*(lambda g, f, c: (g, np.repeat(c, np.diff(np.append(f, len(g))))))(*langid.codes_of(list(words)), list(words.values()))).tolist()).items()), strict=True)) for lang, words in texts.items()})

    probability, alphabet = {}, set()
    for lang, words in texts.items():
        counts = {n: Counter() for n in range(1, order + 1)}
        for word, times in words.items():
            padded = start * (order - 1) + word + end
            alphabet |= set(padded[order - 1 :])
            for i in range(order - 1, len(padded)):
                counts[order][padded[i - order + 1 : i + 1]] += times
        for n in range(order - 1, 0, -1):
            for gram in counts[n + 1]:
                counts[n][gram[1:]] += 1
        total, kinds = defaultdict(int), defaultdict(int)
        for n in counts:
            for gram, c in counts[n].items():
                total[n, gram[:-1]] += c
                kinds[n, gram[:-1]] += 1
        some = {n: (sum(c == 1 for c in counts[n].values()), sum(c == 2 for c in counts[n].values())) for n in counts}
        probability[lang] = (counts, total, kinds, {n: a / (a + 2 * b) if a and b else 0.5 for n, (a, b) in some.items()})

    def plain(lang, gram, n):
        if not n:
            return 1 / (len(alphabet) + 1)
        counts, total, kinds, discount = probability[lang]
        own, context = gram[-n:], gram[-n:][:-1]
        if not total[n, context]:
            return plain(lang, gram, n - 1)
        return max(counts[n][own] - discount[n], 0) / total[n, context] + discount[n] * kinds[n, context] / total[n, context] * plain(lang, gram, n - 1)

    tried = ["abc", "é", "ßßß", "bcd", "zzz", "dcbab"]
    logs, sizes = model.word_logs(tried)
    for word, got, size in zip(tried, logs, sizes, strict=True):
        padded = start * (order - 1) + word + end
        wanted = [sum(math.log(plain(lang, padded[i - order + 1 : i + 1], order)) for i in range(order - 1, len(padded))) for lang in model.langs]
        assert size == len(word) + 1 and np.allclose(got, wanted, rtol=1e-9)


def random_texts(seed, n=60):
    import random

    rng = random.Random(seed)
    words = ["you", "IDIOT", "st0pid", "i.d.i.o.t", "a", "Haus,", "été", "WOW!!!", "nooooo", "x-y-z", "12", "#$%", "{a|b}", "the", "The", "王", "e.g.", "...", "f u n", "longerwordthanallothers"]
    out = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\n\n", "\t", ". "]) for _ in range(rng.randrange(30))) for _ in range(n)]
    return ["", "\n \n", "one", *out, out[0], "a b a b a b"]


@pytest.mark.parametrize("seed", (1, 2))
def test_quality_features_plainly(seed):
    import re

    def plain(text):
        data, fold = text.encode(), lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        words, lines = re.findall(rb"[^\x20\x09-\x0d]+", data), re.findall(rb"[^\n]+", data)
        n, some, sizes = len(words), max(len(words), 1), [len(w) for w in words]
        many = lambda chars: sum(c in chars.encode() for c in data)
        upper = many("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        is_sign = lambda c: c < 0x80 and not chr(c).isalnum() and c not in b" \t\n\x0b\x0c\r"
        digit, signs, wide, chars = many("0123456789"), sum(map(is_sign, data)), sum(c >= 0x80 for c in data), max(sum(sizes), 1)
        capitals = [(sum(65 <= c <= 90 for c in w), sum(97 <= c <= 122 for c in w)) for w in words]
        folded = [fold(w) for w in words]
        pairs = {(folded[i - 1] if i else None, w) for i, w in enumerate(folded)}
        mean = sum(sizes) / some
        return [
            math.log1p(n), mean, sum(s > 12 for s in sizes) / some, sum(s <= 2 for s in sizes) / some, upper / max(chars - digit - signs, 1), digit / chars, many(".") / some, many(",;:") / some, many("!?") / some,
            many("|") / some, many("#$%&*@^~+=<>_\\/") / some, signs / chars, wide / chars, sum(u > 1 and not d for u, d in capitals) / some, sum(65 <= w[0] <= 90 and d > 0 for w, (_, d) in zip(words, capitals, strict=True)) / some,
            sum(sum(map(is_sign, w)) > 1 for w in words) / some, sum(a == b for a, b in zip(folded, folded[1:], strict=False)) / some, len(set(folded)) / some, len(pairs) / some, max(map(folded.count, folded), default=0) / some,
            math.log1p(len(lines)), n / max(len(lines), 1), 1 - len(set(map(fold, lines))) / max(len(lines), 1), sum(x[-1] in b".!?" for x in lines) / max(len(lines), 1), many("{}[]()") / some,
            math.sqrt(max(sum(s * s for s in sizes) / some - mean**2, 0)),
        ]

    import pyarrow as pa

    texts = random_texts(seed)
    for limit in (1 << 20, 40):
        got = np.concatenate([quality.features(data, offsets) for _, _, data, offsets in quality.shards(pa.array(texts), limit)])
        assert got.shape == (len(texts), len(quality.FEATURES))
        for text, own in zip(texts, got, strict=True):
            assert np.allclose(own, plain(text), atol=1e-7), text


@pytest.mark.parametrize("seed", (1, 2))
def test_toxicity_features_plainly(seed, monkeypatch):
    """Sums over tokens one by one, the same whatever texts stand beside them and however small the cache."""
    lexicon = toxicity.Lexicon({"idiot": 4.0, "stupid": 3.0, "haus": 0.5}, {"fun": 1.0, "idio": 2.0})

    def plain(text):
        tokens = text.split()
        if not tokens:
            return [0.0] * len(toxicity.FEATURES)
        traits = [toxicity._token_traits(t, lexicon) for t in tokens]
        weights = [max(t[0], t[3]) for t in traits]
        spaced = []
        loose = [min(3, (len(t) + 1) // 2) if toxicity._LOOSE.fullmatch(t) else 0 for t in tokens]
        if any(x > 2 for x in loose) or any(a and b for a, b in zip(loose, loose[1:], strict=False)):
            for m in toxicity._SPACED.findall(text):
                word = "".join(c for c in m.lower() if c not in " .-*_")
                if word:
                    spaced.append(max(lexicon.weight(word), lexicon.weight(word.translate(toxicity.SWAPS))))
        at, you = [i for i, w in enumerate(weights) if w], [i for i, t in enumerate(traits) if t[2]]
        total = lambda k: sum(t[k] for t in traits)
        first = lambda t: (toxicity._LETTERS.findall(t.lower()) or [""])[0]
        n, hits, weight = len(tokens), len(at) + sum(x > 0 for x in spaced), sum(weights) + sum(spaced)
        letters, chars = max(1.0, total(8)), max(1.0, total(8) + total(9) + total(10))
        near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in at)
        hidden = sum(traits[i][3] > 0 for i in at) + sum(x > 0 for x in spaced)
        return [
            hits, hits / n, len({first(tokens[i]) for i in at}), weight, weight / n, total(1), near, total(2) / n, hidden, total(4) / n, total(5) / n, total(11) / letters, total(6) / n, total(10) / chars, total(7) / n,
            math.log1p(n), total(8) / n, total(9) / chars,
        ]

    texts = random_texts(seed)
    wanted = np.array([plain(t) for t in texts])
    assert wanted[:, 0].any() and np.allclose(toxicity.features(texts, lexicon), wanted)
    monkeypatch.setattr(toxicity, "CACHE_TOKENS", 12)
    fresh = toxicity.Lexicon(lexicon.words, lexicon.stems)
    assert np.allclose(np.concatenate([toxicity.features([t], fresh) for t in texts]), wanted)


def test_findings_of_one_kind_teach_nothing(spark):
    one = spark.createDataFrame([("changeme", "password = ", "", "assignment", 0)], "candidate string, before string, after string, rule string, secret int")
    for findings in (one, one.where("false")):
        with pytest.raises(ValueError):
            secrets.train(findings)
