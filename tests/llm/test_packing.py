"""Packing against the tokenizer itself, and exact round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import packing, queries
from ledgerloom.llm.packing import Limits, best_fit_decreasing, pack_documents, packed_rows, vector_best_fit
from ledgerloom.llm.tokens import CHUNK_CHARS, encoder

WEIRD = ["", "  \n\t ", "a", "It's we'll THEY'RE", "x" * 500, "naïve café ÀÉ", "日本語 текст 12٣", "a<|endoftext|>b", "İstanbul ǅ", "tab\tnew\r\nline", "!!!???...", "don''t '' 's 'S", "\x00\x1f weird   sep", "💥 emoji 1️⃣"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_tokenizer(spark, sf_dir, tokenizer):
    texts = [r.text or "" for r in queries.table(spark, sf_dir, "documents").select("text").collect()] + WEIRD
    coded = encoder(queries.tokenizer_path()).encode(texts)
    for text, data in zip(texts, coded, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_text_in_chunks(tokenizer):
    text = "word and другое " * 10 + "plain words, it's 7 long. " * (CHUNK_CHARS // 20)
    plain = "plain words, it's 7 long. " * (CHUNK_CHARS // 20)
    for t in (text, plain):
        assert np.frombuffer(encoder(queries.tokenizer_path()).encode_long(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check_packed(rows, ids_of, limit):
    bins, pieces = {}, {}
    for r in rows:
        assert 0 < r.length <= limit
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        ids = ids_of[doc]
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // limit)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == r.piece * limit and zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length
        assert sum(r.length for r in own) == len(ids)
    return len(bins)


def test_op1(spark, sf_dir, tokenizer):
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    ids = {r.doc_id: plain_ids(tokenizer, r.text) for r in docs}
    rows = queries.op1_best_fit_packing(spark, sf_dir).collect()
    bins = check_packed(rows, ids, 2048)
    assert {r.doc_id for r in rows} == set(ids)
    assert bins <= -(-sum(map(len, ids.values())) // 2048) * 1.02 + 1


def test_defined_cases(spark, tokenizer):
    data = [(i, t, "clash", 3) for i, t in enumerate([None, *WEIRD, "one two " * 400])]
    docs = spark.createDataFrame(data, "doc_id long, text string, sequence_id string, length int")
    rows = pack_documents(docs, queries.tokenizer_path(), Limits(tokens=64)).collect()
    check_packed(rows, {i: plain_ids(tokenizer, t) for i, t, *_ in data}, 64)
    assert pack_documents(docs.where("false"), queries.tokenizer_path()).count() == 0
    twice = pack_documents(docs.unionByName(docs), queries.tokenizer_path(), Limits(tokens=64)).collect()
    assert len(twice) == 2 * len(rows)
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


@pytest.mark.parametrize("rule", ["residual", "dot"])
@pytest.mark.parametrize("seed", range(3))
def test_every_capacity_holds(rule, seed):
    rng = random.Random(seed)
    lengths = Counter(rng.randint(1, 100) for _ in range(500))
    limits = Limits(tokens=128, documents=4, attention=11_000)
    runs = vector_best_fit(dict(lengths), limits, rule)
    used = Counter()
    for run in runs:
        assert sum(n * k for n, k in run.filled) <= 128 and sum(k for _, k in run.filled) <= 4 and sum(n * n * k for n, k in run.filled) <= 11_000
        for n, k in run.filled:
            used[n] += k * run.count
    assert used == lengths


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_equals_plain(seed):
    rng = random.Random(seed)
    lengths = Counter(rng.randint(1, 60) for _ in range(400))
    rooms = []
    for n in sorted(lengths.elements(), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 100) - n)
    runs = best_fit_decreasing(dict(lengths), 100)
    assert sum(r.count for r in runs) == len(rooms)
    with pytest.raises(ValueError):
        best_fit_decreasing({101: 1}, 100)


def test_op9_round_trip(spark, sf_dir, tokenizer, tmp_path):
    docs = queries.table(spark, sf_dir, "documents")
    wanted = Counter()
    for r in docs.select("text").collect():
        ids = plain_ids(tokenizer, r.text)
        wanted.update(tuple(ids[a : a + 2048]) for a in range(0, len(ids), 2048))
    got, seen = Counter(), []
    rows = queries.op9_token_binary_output(spark, sf_dir)
    index = packing.write_packed(rows, str(tmp_path / "packed")).collect()
    for shard in index:
        ids, positions, lengths, starts = packing.open_packed(str(tmp_path / "packed"), shard.shard, 2048)
        assert len(ids) == len(positions) == shard.rows == len(starts) - 1 and shard.segments == len(lengths) - shard.rows
        for i in range(shard.rows):
            bounds = lengths[starts[i] : starts[i + 1]].tolist()
            assert bounds[0] == 0
            for a, b in zip(bounds, bounds[1:], strict=False):
                assert positions[i, a:b].tolist() == list(range(b - a))
                got[tuple(ids[i, a:b].tolist())] += 1
            assert not ids[i, bounds[-1] :].any() and not positions[i, bounds[-1] :].any()
            seen.append((ids[i].tobytes(), positions[i].tobytes(), bounds))
    assert got == wanted
    rows = rows.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert sorted((bytes(r.input_ids), bytes(r.position_ids), r.cu_seqlens) for r in rows) == sorted(seen)
    assert packed_rows(docs.where("false"), queries.tokenizer_path()).count() == 0


def test_equal_rows_get_rows_of_their_own(spark):
    docs = spark.createDataFrame([(1, "word " * 9000, 1), (1, "word " * 9000, 2), (None, None, 3), (None, "", 4)], "doc_id long, text string, sequence_id int")
    rows = packed_rows(docs, queries.tokenizer_path()).collect()
    assert len(rows) == len({r.sequence_id for r in rows}) == 9
    assert sum(r.cu_seqlens[-1] for r in rows) == 2 * 9001 + 2


def test_ids_that_do_not_fit_are_refused(spark):
    from ledgerloom.llm import queries, tokens

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        tokens.cut_documents(docs, queries.tokenizer_path(), 8, end_id=70_000, id_bytes=2).collect()
    assert tokens.cut_documents(docs, queries.tokenizer_path(), 8, end_id=70_000, id_bytes=4).count() == 1
