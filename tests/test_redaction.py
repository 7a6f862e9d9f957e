import random
import re

import pytest

from ledgerloom.operators import redaction

SCHEMA = "id int, parts array<string>, forbidden array<string>, leaks int"


def plain(parts, forbidden):
    """The same by loops: fields, blocks line by line, counters, then literals."""
    seen = {kind: [] for kind in redaction.REFERENCES}
    hidden = []
    for text in parts:
        for pattern, fake in redaction.FIELDS:
            text = re.sub(pattern, lambda m, fake=fake: m.group(1) + fake, text)
        lines, inside = [], False
        for line in text.split("\n"):
            if re.search(redaction.BLOCK_START, line):
                line, inside = re.sub(r"(Address\s*:).*", r"\1 " + redaction.ADDRESS, line), True
            elif inside and re.search(redaction.BLOCK_END, line):
                inside = False
            elif inside and line.strip():
                line = redaction.HIDDEN
            lines.append(line)
        hidden.append("\n".join(lines))
    out = []
    for text in hidden:
        for kind, (patterns, template, digits) in redaction.REFERENCES.items():
            for label, value in patterns:

                def stand_in(m, kind=kind, template=template, digits=digits):
                    if m.group(2) not in seen[kind]:
                        seen[kind].append(m.group(2))
                    return m.group(1) + template % str(seen[kind].index(m.group(2)) + 1).zfill(digits)

                text = re.sub(f"({label})({value})", stand_in, text)
        text = re.sub(r"\b\d{12}\b", "0" * 12, text)
        wanted = sorted((f for f in forbidden if f), key=len, reverse=True)
        out.append(re.sub("|".join(map(re.escape, wanted)), redaction.HIDDEN, text, flags=re.I) if wanted else text)
    return out, seen


def one(spark, *rows):
    frame = spark.createDataFrame([(n, *r, 7) for n, r in enumerate(rows)], SCHEMA)
    return [r for r in sorted(redaction.redact(frame).collect(), key=lambda r: r.id)]


def test_random_documents(spark):
    rng = random.Random(5)
    pieces = ["Name : Asha Rao", "Address : 12 Lake Road", "Pin code : 560001", "Order Id : 55", "Order Id : 7", "Order Number : 402-1234567-7654321", "Invoice Number : AB-1234567", "Invoice Details : ZZ-99999", "Invoice Number AB-1234567",
              "Payment Transaction ID : pay_77", "ref 123456789012 and 1234567890123", "Billing Address :", "Sold By Address : here", "Flat 12, Lake", "", "  ", "PAN No: X asha RAO", "Description 4 x 100 g", "Shipping Address : a b"]
    rows = [(["\n".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(rng.randrange(4))], rng.sample(["asha rao", "Lake", "Flat 12, Lake", "", None, "(.*"], 3)) for _ in range(60)]
    for got, (parts, forbidden) in zip(one(spark, *rows), rows, strict=True):
        text, seen = plain(parts, forbidden)
        assert got.parts == text
        assert sorted((r.kind, r.value) for r in got.replaced) == sorted((k, v) for k, vs in seen.items() for v in vs)


def test_nothing_there(spark):
    nothing, empty, null, blank = one(spark, (None, None), ([], ["x"]), ([None, "Order Id : 7"], None), ([""], [None, ""]))
    assert (nothing.parts, nothing.leaks) == (None, []) and (empty.parts, empty.leaks) == ([], [])
    assert null.parts == [None, "Order Id : 404-0000001-0000001"] and (blank.parts, blank.leaks) == ([""], [])
    assert redaction.redact(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_and_many_numbers(spark):
    lines = "Billing Address :\n" + "Flat 12\n" * 20000 + "Invoice\n" + "".join(f"Order Id : {n}\n" for n in range(1000, 1300)) * 2
    (got,) = one(spark, ([lines], ["flat"]))
    assert got.parts[0].count("[redacted]") == 20000 and len(got.replaced) == 300
    assert got.parts[0].count("404-000000299-0000001") == 2 and got.replaced[299].stand_in == "404-000000300-0000001" and not got.leaks


def test_what_is_left_is_told_and_fails(spark):
    frame = spark.createDataFrame([(1, ["Order Id : 5551\nsee 5551, not x5551"], [r"a\Eb"], 0), (2, [r"A\EB told"], [r"a\Eb"], 0), (3, ["stay"], ["redacted", "stay"], 0), (4, ["Order Number : 404-0000001-0000001"], None, 0)], SCHEMA)
    out = redaction.redact(frame)
    assert {r.id: r.leaks for r in out.collect()} == {1: ["5551"], 2: [], 3: ["redacted"], 4: ["404-0000001-0000001"]}
    assert redaction.proven(out.where("id = 2")).collect()[0].parts == ["[redacted] told"]
    with pytest.raises(Exception, match="redaction left private values: 1"):
        redaction.proven(out).collect()


def test_work_grows_with_the_patterns_and_not_by_their_powers(spark):
    """Every pass over a text names it a bounded number of times; nested passes named it three times as often each."""
    frame = spark.createDataFrame([(1, ["Order Id : 7"], [], 0)], SCHEMA)
    plan = redaction.redact(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3 * sum(len(patterns) for patterns, _, _ in redaction.REFERENCES.values())


def test_patterns_are_compiled_once_and_values_found_once(spark):
    """A split compiles its pattern for every text, and a search for positions ends by an exception for every value."""
    frame = spark.createDataFrame([(1, ["Order Id : 7"], [], 0)], SCHEMA)
    plan = redaction.redact(frame)._jdf.queryExecution().optimizedPlan().toString()
    patterns = sum(len(patterns) for patterns, _, _ in redaction.REFERENCES.values())
    assert plan.count("split(") == plan.count("split(lambda") == patterns and "array_position" not in plan
    assert plan.count("regexp_extract_all") == 2 * patterns


def test_labels_across_lines_and_within_values(spark):
    rng = random.Random(6)
    pieces = ["Sold", "By Address :", "Sold By  Address\t: x", "Order", "Number : 12", "Place", "of birth", "Billing Address :", "Shipping  Address :", "Flat 7", "", " \t", "Address", ": B", "Name", ": C", "Name :", "Address :",
              "Payment Transaction ID : OrderId:5", "Payment Transaction ID : OrderId:6,Invoice", "Order Id :", "66", "Order Id : 5", "Invoice Number AB-12345", "Invoice Details : AB-12345 Invoice Number : CD-12345", "PAN No"]
    rows = [(["\n".join(rng.choices(pieces, k=rng.randrange(16))) for _ in range(rng.randrange(4))], ["flat"]) for _ in range(200)]
    for got, (parts, forbidden) in zip(one(spark, *rows), rows, strict=True):
        assert got.parts == plain(parts, forbidden)[0]
