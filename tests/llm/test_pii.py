"""Surrogates: types, writings, coreference and distinctness."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii, queries

KEY = "k"


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def rewrite(spark, texts, key=KEY):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in pii.pseudonymise(docs, key).collect()}


def test_types_and_formats(spark):
    texts = [
        "write to anna.smith77@mail.co.uk, or call +49 (30) 1234-5678!",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1111; ssn 123-45-6789",
        "server 192.168.10.24 iban DE89 3704 0044 0532 0130 00",
        "MR SMITH", "Frau Müller met Dr. House and г-н; Господин Иванов came",
    ]
    out = rewrite(spark, texts)
    mail = re.search(r"\S+@\S+", out[0])[0].rstrip(",")
    assert re.fullmatch(r"[a-z]+\.[a-z]*[0-9]{4}@example\.(com|org|net)|[a-z]+\.[0-9]{4}@example\.(com|org|net)", mail)
    assert re.search(r"\+\d\d \(\d\d\) \d{4}-\d{4}!$", out[0]) and "1234-5678" not in out[0]
    a, b = re.search(r"card ([\d ]{19}) and ([\d-]{19})", out[1]).groups()
    assert a.replace(" ", "") == b.replace("-", "") != "4" + "1" * 15 and luhn(a.replace(" ", "")) and a[0] == "4"
    assert re.search(r"ssn 9\d\d-\d\d-\d{4}$", out[1])
    assert re.search(r"server 10\.\d+\.\d+\.\d+ iban DE\d\d( \d{4}){4} \d\d$", out[2])
    assert re.fullmatch(r"Frau \w+ met Dr\. \w+ and г-н; Господин [А-Яа-я]+ came", out[4])
    assert "Müller" not in out[4] and "House" not in out[4] and "Иванов" not in out[4]


def test_coreference_and_key(spark):
    texts = ["Mr Smith wrote a@b.com", "A@B.COM and Mr Smith", "x a@b.com y"]
    out = rewrite(spark, texts)
    first = re.search(r"\S+@\S+", out[0])[0]
    assert first.upper() in out[1] and first in out[2]
    assert re.search(r"Mr (\w+)", out[0])[1] == re.search(r"Mr (\w+)", out[1])[1]
    assert rewrite(spark, texts) == out
    assert rewrite(spark, texts, "other") != out


def test_entities_stay_distinct(spark):
    ips = [f"10.0.{i // 250}.{i % 250}" for i in range(1500)]
    phones = [f"555-{i:04d}" for i in range(1500)]
    entities = spark.createDataFrame([("ip", e) for e in ips] + [("phone", "555" + p[4:]) for p in phones], "kind string, entity string")
    rows = pii.assign(entities, KEY).collect()
    cores = {(r.kind, r.core) for r in rows}
    assert len(rows) == len(cores) == 3000
    assert not cores & {("ip", e) for e in ips}, "a surrogate is an entity of the corpus"


def test_rest_is_untouched(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    out = queries.op6_pii_surrogates(spark, sf_dir)
    pairs = pii.find(docs).select("doc_id", F.col("text").alias("old"), "_found").join(out, "doc_id").collect()
    assert len(pairs) == docs.count() and any(p.n_entities for p in pairs)
    for p in pairs:
        assert (p.n_entities or 0) == len(p["_found"] or [])
        if not p.n_entities:
            assert p.text == p.old
            continue
        at, pattern = 0, ""
        for match in p["_found"]:
            begin = p.old.index(match, at)
            pattern += re.escape(p.old[at:begin]) + "(.{1,400}?)"
            at = begin + len(match)
        found = re.fullmatch(pattern + re.escape(p.old[at:]), p.text, re.DOTALL)
        assert found and all(new != match for new, match in zip(found.groups(), p["_found"], strict=True))


@pytest.mark.parametrize("column", ["kind", "entity", "pos", "_x"])
def test_defined_cases(spark, column):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a@b.com", 3), (3, "a@b.com", 3), (None, "c@d.org", 4), (5, "word " * 50_000 + "e@f.net", 5)], f"doc_id long, text string, {column} int")
    rows = pii.pseudonymise(docs, KEY, count_col="n").collect()
    assert len(rows) == 6 and rows[0].asDict().keys() == {"doc_id", "text", column, "n"}
    by = {r[column]: r for r in rows}
    assert by[1].text is None and by[2].text == "" and by[1].n == by[2].n == 0
    assert all("@example." in by[k].text for k in (3, 4, 5)) and by[5].text.startswith("word " * 50_000)
    assert pii.pseudonymise(docs.where("false"), KEY).count() == 0


def test_telephone_numbers_go_whole(spark):
    texts = ["call +49 30 1234567 now", "call 030 1234567 now", "call 0049 30 1234567 now", "call +4930123456 now", "on 2024-03-05 12:30:45, 1.2.3"]
    out = rewrite(spark, texts)
    for i, shape in enumerate((r"call \+\d\d \d\d \d{7} now", r"call \d{3} \d{7} now", r"call \d{4} \d\d \d{7} now", r"call \+\d{10} now")):
        assert re.fullmatch(shape, out[i]) and "1234567" not in out[i] and "123456" not in out[i]
    assert out[4] == texts[4]


def test_names_agree_in_a_text_and_across(spark):
    texts = [
        "Mr John Smith met Ann. John Smith left, SMITH too? Smith stayed; Smithson came.", "Mr Smith here", "Dr Anna Roe and Ms Anna Roe", "Dr Anna Roe alone",
        "Κύριος Παπαδόπουλος ήρθε", "Ms 王小明 came. 王小明 left", "Mr Andrea Sole, then Dr Andrea Sole", "Ms Andrea Sole", "Mr Peter Smith",
    ]
    out = rewrite(spark, texts)
    given, surname = re.match(r"Mr (\w+) (\w+) met Ann\. ", out[0]).groups()
    assert re.fullmatch(rf"Mr {given} {surname} met Ann\. {given} {surname} left, SMITH too\? {surname} stayed; Smithson came\.", out[0])
    assert out[1] == f"Mr {surname} here" and re.fullmatch(rf"Mr (?!{given}\b)\w+ {surname}", out[8].replace("-", ""))
    a, b = re.fullmatch(r"Dr ([\w-]+ \w+) and Ms ([\w-]+ \w+)", out[2]).groups()
    assert a == b and out[3] == f"Dr {a} alone" and a.split("-")[0].split()[0] in pii.GIVEN["f", "latin"]
    assert re.fullmatch(r"Κύριος [Ͱ-Ͽ]+ ήρθε", out[4]) and "Παπαδόπουλος" not in out[4]
    han = re.fullmatch(r"Ms ([一-鿿]+) came\. ([一-鿿]+) left", out[5]).groups()
    assert han[0] == han[1] != "王小明"
    he, he2 = re.fullmatch(r"Mr ([\w-]+) \w+, then Dr ([\w-]+) \w+", out[6]).groups()
    assert he == he2 and he.split("-")[0] in pii.GIVEN["m", "latin"] and out[7].split()[1].split("-")[0] in pii.GIVEN["f", "latin"]


def test_ip6_and_iban(spark):
    texts = ["at 2001:db8::8a2e:370:7334, also 2001:0db8:0:0:0:8a2e:0370:7334;", "std::vector, a::b, 12:30:45", "DE89 3704 0044 0532 0130 00 GB29NWBK60161331926819"]
    out = rewrite(spark, texts)
    a, b = re.fullmatch(r"at ([0-9a-f:]+), also ([0-9a-f:]+);", out[0]).groups()
    assert a == b and a.startswith("fd") and len(a) == 39
    assert out[1] == texts[1]
    for iban in re.fullmatch(r"(DE\d\d(?: \d{4}){4} \d\d) (GB\d\dNWBK\d{14})", out[2]).groups():
        plain = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert "3704" not in out[2] and "60161331926819" not in out[2]


def test_permutation(spark):
    for size in (2, 3, 5):
        every = spark.range(10**size).select(F.lpad(F.col("id").cast("string"), size, "0").alias("x"))
        moved = every.select("x", pii.permuted_digits(KEY, F.lit("t"), F.col("x")).alias("y"))
        assert moved.select("y").distinct().count() == 10**size and moved.where("x = y or length(y) <> length(x)").isEmpty()


def test_dense_types_stay_distinct(spark):
    """Every seven-digit number with one first digit, and far more names than there are surrogates without a suffix."""
    phones = spark.range(200_000).select(F.lit("phone").alias("kind"), (F.col("id") + 5_000_000).cast("string").alias("entity"))
    people = spark.range(3000).select(F.lit("given").alias("kind"), F.concat(F.lit("n"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("|f")).alias("entity"))
    mails = spark.range(3000).select(F.lit("email").alias("kind"), F.concat(F.col("id").cast("string"), F.lit("@x.org")).alias("entity"))
    out = pii.assign(phones.unionByName(people).unionByName(mails), KEY)
    assert {r.kind: (r.n, r.d) for r in out.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("core").alias("d")).collect()} == {"phone": (200_000, 200_000), "given": (3000, 3000), "email": (3000, 3000)}


def test_marking_signs_and_any_column_names(spark):
    text = "﷐ a@b.com ﷑x﷒ ﷓ Mr Smith ﷒﷕"
    names = ["doc_id", "text", "_found", "_pii", "_PIIrow", "_id1", "_hash1", "_fresh", "row", "kind", "entity", "n"]
    docs = spark.createDataFrame([(1, text, *names[2:])], names)
    row = pii.pseudonymise(docs, KEY, count_col="count").collect()[0]
    assert list(row.asDict()) == [*names, "count"] and row["count"] == 2 and [row[n] for n in names[2:]] == names[2:]
    assert re.fullmatch("﷐ \\S+@example\\.\\w+ ﷑x﷒ ﷓ Mr \\w+ ﷒﷕", row.text)


def test_whole_names_and_initials(spark):
    texts = [
        "Mr John Michael Smith came. Smith left, John Michael Smith too.", "Mr J. R. Smith paid", "Dr J.R. Smith paid; J.R. Smith's bill", "Mr J.Smith", "Herr Ł. Żak", "Mr J. said",
        "Ms " + "A" + "b" * 90 + " ran", "to " + "x" * 90 + "@" + "y" * 70 + ".com.", "Mr O'Neil-Smythe's car", "Frau الأندلسية",
    ]
    out = rewrite(spark, texts)
    first, second, last = re.match(r"Mr ([\w-]+) ([\w-]+) (\w+) came", out[0]).groups()
    assert out[0] == f"Mr {first} {second} {last} came. {last} left, {first} {second} {last} too." and not {first, second, last} & {"John", "Michael", "Smith"}
    a, b = re.fullmatch(rf"Mr ([A-Z])\. ([A-Z])\. {last} paid", out[1]).groups()
    assert a != "J" and b != "R" and a != b
    assert out[2] == f"Dr {a}.{b}. {last} paid; {a}.{b}. {last}'s bill" and out[3] == f"Mr {a}.{last}"
    assert re.fullmatch(r"Herr [^\W\d_]\. \w+", out[4]) and "Ł" not in out[4] and "Żak" not in out[4] and out[5] == f"Mr {a}. said"
    assert "bb" not in out[6] and out[6].endswith(" ran") and "xx" not in out[7] and "yy" not in out[7]
    assert re.fullmatch(r"Mr \w+'s car", out[8]) and re.fullmatch(r"Frau [\u0600-\u06ff]+", out[9]) and "الأندلسية" not in out[9]


def _plain_iban(country, account):
    digits = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{account}"


def test_numbers_keep_length_and_stay_distinct(spark):
    """Found and replaced plainly: every number keeps its shape and checks, none is left, none meets another."""
    import random

    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    ibans = [_plain_iban(rng.choice(["DE", "FR", "MT"]), number(n)) for n in range(12, 31) for _ in range(60)] + ["FR7630006000011234567890189", "PL61109010140000071219812874"]
    cards = []
    for n in (13, 14, 15, 16, 17, 18, 19):
        for _ in range(150):
            head = rng.choice("3456") + "0" * rng.randrange(4) + number(n)
            head = head[: n - 1]
            cards.append(next(head + str(d) for d in range(10) if luhn(head + str(d))))
    phones = [f"+49 {rng.choice(['0', '00', ''])}{number(3)} {number(rng.randrange(5, 8))}" for _ in range(1500)]
    for kind, values, clean in (("iban", sorted(set(ibans)), lambda x: x), ("card", [c for c in sorted(set(cards)) if len(c) in (15, 16, 17, 18, 19)], lambda x: x), ("phone", sorted({re.sub(r"\D", "", p): p for p in phones}.values()), lambda x: re.sub(r"\D", "", x))):
        out = rewrite(spark, [f"<{v}>" for v in values])
        fresh = [out[i][1:-1] for i in range(len(values))]
        assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) and a != b for a, b in zip(values, fresh, strict=True)), kind
        assert len({clean(x) for x in fresh}) == len(values), kind
        if kind == "card":
            assert all(map(luhn, fresh))
        if kind == "iban":
            assert all(int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 for x in fresh)


def test_mixed_lengths_stay_distinct(spark):
    seven, eight = (spark.range(50_000).select(F.lit("phone").alias("kind"), F.lpad(F.col("id").cast("string"), n, "0").alias("entity")) for n in (7, 8))
    out = pii.assign(seven.unionByName(eight), KEY)
    assert out.select("core").distinct().count() == out.count() == 100_000
    assert out.where("length(core) <> length(entity)").isEmpty()
