"""Token ids of whole documents, cut losslessly into pieces.

The vocabulary's pre-tokenizer always splits at white space and never looks
across a match, so the ids of a text are the ids of its matches in a row. Each
distinct match is encoded once per worker and kept in a bounded cache; texts
with characters for which that shortcut is not plainly exact go to the
tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's cache; a full cache is emptied.
CACHE_WORDS = 700_000
CHUNK_CHARS = 1 << 20

#: The pre-tokenizer for which the shortcut holds (fixed value of the vocabulary file).
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same for ASCII and the precomposed Latin-1 letters.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[\\t\\n\\r !-~{_LATIN}]*")
_MATCH = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^ \\t\\n\\r0-9{_LATIN}]+")
_BLANK = re.compile(r"[ \t\n\r]")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            spec = json.load(file)
        self.quick = _PATTERN in json.dumps(spec.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\") and spec["model"].get("end_of_word_suffix") == "</w>"
        vocab = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.closing[i] = token.endswith("</w>")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(part):
                raise AssertionError("a word's ids do not end where the word ends")
            data, begin = ids.astype("<u4").tobytes(), 0
            for word, end in zip(part, ends.tolist(), strict=True):
                self.cache[word] = data[4 * begin : 4 * end]
                begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        matches = [None if not self.quick or not _PLAIN.fullmatch(t) or any(s in t for s in self.specials) else _MATCH.findall(t.lower()) for t in texts]
        missing = {w for m in matches if m for w in m if w not in self.cache}
        self._learn(sorted(missing))
        get = self.cache.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if m is None else b"".join(map(get, m)) for t, m in zip(texts, matches, strict=True)]

    def encode_long(self, text: str) -> bytes:
        """A text of any length, in chunks that end before a blank where that is exact."""
        if len(text) <= CHUNK_CHARS or not self.quick or not _PLAIN.fullmatch(text) or any(s in text for s in self.specials):
            return self.encode([text])[0]
        out, at = [], 0
        while at < len(text):
            cut = _BLANK.search(text, at + CHUNK_CHARS)
            end = cut.start() if cut else len(text)
            out += self.encode([text[at:end]])
            at = end
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, limit: int, end_id: int, id_bytes: int):
    closing = np.array([end_id], "<u4").tobytes()
    keep_ids = id_bytes > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            row = 0
            while row < batch.num_rows:
                group, chars = [], 0
                while row + len(group) < batch.num_rows and (not group or chars < CHUNK_CHARS):
                    group.append(texts[row + len(group)].as_py() or "")
                    chars += len(group[-1])
                coded = [encode.encode_long(group[0])] if len(group) == 1 else encode.encode(group)
                rows, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
                for i, data in enumerate(coded):
                    data += closing
                    if id_bytes and len(data) and int(np.frombuffer(data, "<u4").max()) >> (8 * id_bytes):
                        raise ValueError(f"an id does not fit in {id_bytes} bytes")
                    for piece, at in enumerate(range(0, len(data), 4 * limit)):
                        part = data[at : at + 4 * limit]
                        rows.append(row + i)
                        pieces.append(piece)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        if id_bytes:
                            ids.append(np.frombuffer(part, "<u4").astype(f"<u{id_bytes}").tobytes())
                row += len(group)
                out = [batch.column(0).take(pa.array(rows)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return run


def cut_documents(docs: DataFrame, tokenizer_path: str, limit: int, end_id: int = 0, id_bytes: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``limit`` ids, with the ids themselves if ``id_bytes`` is 2 or 4.

    A document's ids are those of its text, then ``end_id``; a null or empty
    text has only that one. Rows with a null id are kept with a null id. An id
    that does not fit in ``id_bytes`` is an error.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(tokenizer_path, limit, end_id, id_bytes), PIECES + ", ids binary" * (id_bytes > 0))
