"""Secret scans: format rules find candidates, a random forest removes false positives.

Candidates come from rules for known key formats and from assignments to names
such as ``password`` or ``token``. The forest sees each candidate's length and
classes of characters, how likely its character transitions are in prose and in
random strings, how much of it dictionary words cover, whether it stands in a
path or URL, and the words around it. It is trained from labelled findings.

``labelled_findings`` makes a training table by rule (formats and decoys), for
use where no audited findings are at hand.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.gbdt import Forest, fit_random_forest

#: Findings that the forest may be trained on.
TRAINING_ROWS = 20_000
WINDOW = 40
THRESHOLD = 0.5

#: Formats of well-known keys, and names that hold secrets.
FORMATS = {
    "aws_key_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google_key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}",
    "jwt": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]|-(?!-))*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?",
}
_NAMES = r"passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|(?:account|client|encryption|master|private|shared|signing|storage)[_-]?key|authorization|credential"
_NAMED = rf"(?i:{_NAMES})[A-Za-z0-9_]{{0,24}}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?(?:(?i:bearer|basic)\s{{1,3}})?"
_BEARER = r"(?<![A-Za-z])(?i:bearer)\s{1,3}(?=[^\s\"'<>]*[0-9])(?![0-9a-fA-F]{32,}(?![A-Za-z0-9+/=_-]))"
#: The first two letters of the names, so that most places of a text are passed over without trying them all (a long s counts as s).
_BEGINS = r"(?=[pP][aAwWrR]|[sSſ][eEiIhHtT]|[tT][oO]|[aA][pPcCuU]|[cC][rRlL]|[eE][nN]|[mM][aA]|[bB][eE])"
_ASSIGNED = rf"{_BEGINS}(?:{_NAMED}|{_BEARER})(?P<assigned>[^\s\"'<>]{{6,}})"
_HEX = r"(?<![A-Za-z0-9+/=_-])(?P<bare>[0-9a-fA-F]{32,})(?![A-Za-z0-9+/=_-])"
_RULES = re.compile("|".join([*(f"(?P<{k}>{v})" for k, v in FORMATS.items()), f"(?P<assignment>{_ASSIGNED})", f"(?P<bare_hex>{_HEX})"]))

#: Words that speak for or against a secret nearby, and a small dictionary.
_FOR = frozenset("password passwd pwd secret token key apikey auth credential login bearer private access authorization accountkey clientkey privatekey".split())
_AGAINST = frozenset("example sample dummy test placeholder changeme your commit sha sha256 sha1 md5 checksum digest uuid guid hash version build revision id file path".split())
_DICTIONARY = frozenset(
    "the and for your you pass word password secret token key change me here insert enter value example sample test dummy user name admin default none null true false string "
    "config setting file path home data hello world welcome letme in open door monkey dragon master login access placeholder replace this with foo bar baz abc env get environ process".split()
)
FEATURES = (
    "length", "lower", "upper", "digit", "sign", "entropy", "changes", "prose_transitions", "alternations", "dictionary", "longest_letters", "hex_only", "repeats",
    "in_path", "in_url", "words_for", "words_against", "assigned", "format", "quoted",
)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


#: Frequent letter pairs of European prose.
_PAIRS = frozenset("th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur la el ch ie ll me ne ri ro ic un be ma co di so ta om us em ge ke lo no pe po qu tr wo wh".split())


def _coverage(low: str) -> float:
    """Share of the characters that dictionary words of three letters or more cover, longest first."""
    covered, at = 0, 0
    while at < len(low):
        size = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at : at + n] in _DICTIONARY), 0)
        covered += size
        at += size or 1
    return covered / max(1, len(low))


def describe(candidate: str, before: str, after: str, rule: str) -> tuple[float, ...]:
    """The features of a candidate with the text on either side."""
    n, low = max(1, len(candidate)), candidate.lower()
    kinds = [_kind(c) for c in candidate]
    counts = Counter(candidate)
    pairs = [low[i : i + 2] for i in range(len(low) - 1) if low[i : i + 2].isalpha()]
    near = set(re.findall(r"[a-z0-9]+", f"{before[-WINDOW:]} {after[:WINDOW]}".lower()))
    return (
        float(n), *(kinds.count(k) / n for k in range(4)), -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, sum(p in _PAIRS for p in pairs) / max(1, len(pairs)),
        sum((a < 2) != (b < 2) for a, b in zip(kinds, kinds[1:], strict=False)) / n, _coverage(low), max(map(len, re.findall(r"[A-Za-z]+", candidate)), default=0) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in candidate)), max(counts.values(), default=0) / n,
        float("/" in candidate[1:-1] or "\\" in candidate or before.endswith(("/", "\\"))), float("://" in before[-WINDOW:] or "://" in candidate),
        float(len(near & _FOR)), float(len(near & _AGAINST)), float(rule == "assignment"), float(rule in FORMATS), float(before[-1:] in "\"'"),
    )


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(rule, start, end) of every candidate, in order and without overlaps."""
    for m in _RULES.finditer(text):
        rule = m.lastgroup if m.lastgroup in FORMATS else "assignment" if m.group("assigned") else "bare_hex"
        part = {"assignment": "assigned", "bare_hex": "bare"}.get(rule, rule)
        yield rule, m.start(part), m.end(part)


def labelled_findings(spark: SparkSession, rows: int = 6000, seed: int = 7) -> DataFrame:
    """``candidate, before, after, rule, secret``: half made like secrets, half like what rules find in error."""

    def make(batches):
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                rng = random.Random(seed * 1_000_003 + i)
                pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
                prose = lambda: " ".join("".join(rng.choice(("th", "er", "on", "an", "re", "in", "st", "ou", "en", "ti")) for _ in range(rng.randint(1, 4))) for _ in range(4))
                name = rng.choice(("password", "token", "secret", "api_key", "access_key"))
                assign = f"{prose()} {name}" + rng.choice(("=", ' = "', ": ", "='"))
                kind = rng.randrange(6)
                if i % 2:
                    made = (
                        ("aws_key_id", "AKIA" + pick(string.ascii_uppercase + string.digits, 16), prose() + " "),
                        ("assignment", pick("0123456789abcdef", rng.choice((16, 18, 20, 32, 40, 64))), assign),
                        ("assignment", pick(string.ascii_letters + string.digits, rng.randint(12, 48)), assign),
                        ("assignment", pick(string.ascii_letters + string.digits + "!#$%&*+-/_", rng.randint(8, 24)), assign),
                        (rng.choice((("github_token", "ghp_"), ("stripe_key", "sk_live_"), ("google_key", "AIza"))), pick(string.ascii_letters + string.digits, 36), prose() + " "),
                        ("bare_hex", pick("0123456789abcdef", rng.choice((32, 40, 64))), f"{prose()} {rng.choice(('secret', 'private key', 'bearer', 'auth token'))} "),
                    )[kind]
                    rule, value, before = made
                    if isinstance(rule, tuple):
                        rule, value = rule[0], rule[1] + value
                else:
                    words = rng.sample(sorted(_DICTIONARY), 3)
                    made = (
                        ("assignment", rng.choice(("changeme", "your_password_here", "<password>", "xxxxxxxxxxxx", "********", "placeholder", "password123", "null,null", "example-token"))),
                        ("assignment", rng.choice("_-.").join(words)),
                        ("assignment", "os.environ[" + words[0].upper() + "]"),
                        ("bare_hex", pick("0123456789abcdef", rng.choice((32, 40, 64)))),
                        ("assignment", "/".join(["", "etc", *words])),
                        ("assignment", words[0] + words[1] + str(rng.randint(1, 99))),
                    )[kind]
                    rule, value = made
                    before = f"{prose()} {rng.choice(('commit', 'sha256', 'md5', 'checksum', 'build id', 'uuid'))} " if rule == "bare_hex" else assign
                out.append((value, before, f" {prose()}", rule, i % 2))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:4]), pa.array(cols[4], pa.int32())], ["candidate", "before", "after", "rule", "secret"])

    return spark.range(rows).mapInArrow(make, "candidate string, before string, after string, rule string, secret int")


def train(findings: DataFrame, trees: int = 100) -> Forest:
    """``findings``: candidate, before, after, rule, secret (0 or 1); at most TRAINING_ROWS by hash. Without both kinds nothing can be learned: an error."""
    rows = findings.where("candidate is not null and secret in (0, 1)").orderBy(F.xxhash64("candidate", "before", "after"), "candidate").limit(TRAINING_ROWS).collect()
    if len({r.secret for r in rows}) < 2:
        raise ValueError("findings must have secrets and false positives to learn from")
    x = np.array([describe(r.candidate, r.before or "", r.after or "", r.rule or "") for r in rows], float).reshape(-1, len(FEATURES))
    return fit_random_forest(x, np.array([r.secret for r in rows], float), trees)


@dataclass
class _Found:
    row: int
    rule: str
    start: int
    end: int
    traits: tuple


def _scan(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "end", "rule", "candidate_sha256", "score", "is_secret"]
        import hashlib

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found, sums = [], []
                for i, text in enumerate(part.column(1)):
                    text = text.as_py() or ""
                    for rule, start, end in candidates(text):
                        found.append(_Found(i, rule, start, end, describe(text[start:end], text[max(0, start - 2 * WINDOW) : start], text[end : end + 2 * WINDOW], rule)))
                        sums.append(hashlib.sha256(text[start:end].encode()).hexdigest())
                if found:
                    score = shared.value.margin(np.array([f.traits for f in found], float))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array([f.row for f in found])), pa.array([f.start for f in found], pa.int32()), pa.array([f.end for f in found], pa.int32()),
                            pa.array([f.rule for f in found]), pa.array(sums), pa.array(score), pa.array(score >= threshold),
                        ],
                        names,
                    )

    return run


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, start, end, rule, candidate_sha256, score, is_secret.

    ``start`` and ``end`` count characters. A private key reaches to its END
    line, if it has one before the next line of dashes. Null and empty texts have
    none; very long texts are read whole; repeated rows and rows with null ids
    repeat their findings; an empty table gives no rows; other columns are ignored. A finding
    that the forest takes for a false positive stays, with ``is_secret`` false.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start int, end int, rule string, candidate_sha256 string, score double, is_secret boolean"
    return rows.mapInArrow(_scan(shared, threshold), schema).withColumnRenamed("id", id_col)
