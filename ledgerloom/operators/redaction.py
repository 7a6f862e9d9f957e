"""Redaction of printed invoices: who is replaced, what kind of value it is stays, and a proof that nothing is left.

A document is one row with its texts in order (pages, table cells), so all of it is a map: no shuffle, no Python, and
stand-ins are numbered within the row. The same value gets the same stand-in in all texts of its document, since an
order that two invoices name must still be one order.

What it costs are the passes over each text. So an expression that names its text several times is a transform of its own,
and patterns are literals, which a task compiles once, that begin with the plain word of a label, which Java finds by skipping.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stand-ins and the printed labels that are known. A label begins with a plain word.
NAME, ADDRESS, PIN, HIDDEN = "Test Customer", "1 Example Road, Example Locality, Example City", "000000", "[redacted]"
FIELDS = ((r"(Name\s*:\s*)[^\n]+", NAME), (r"(Address\s*:\s*)[^\n]+", ADDRESS), (r"(Pin\s*code\s*:\s*)\d+", PIN))
BLOCK_LABELS = (r"Billing\s*Address\s*:", r"Shipping\s*Address\s*:", r"Sold\s*By\s*Address\s*:")
BLOCK_START = f"(?:{'|'.join(BLOCK_LABELS)})"
BLOCK_END = r"Order\s*(?:Number|Date)|Invoice|PAN\s*No|GST\s*Registration|FSSAI|State/UT|Place\s*of|Sl\.|Description|Tax\s*Invoice"
#: Kind: the labelled patterns (label, value), and the stand-in around its number of so many digits.
REFERENCES = {
    "order": (((r"Order\s*Id\s*:\s*", r"\d+"), (r"Order\s*Number\s*:\s*", r"\d{3}-\d{7}-\d{7}")), "404-000000%s-0000001", 1),
    "invoice": (((r"Invoice\s*Number\s*:?\s*", r"[A-Z0-9][A-Z0-9-]{4,}"), (r"Invoice\s*Details\s*:\s*", r"[A-Z0-9][A-Z0-9-]{4,}")), "TTD1-9900%s", 2),
    "payment": (((r"Payment\s*Transaction\s*ID\s*:\s*", r"\S+"),), "1111PAYREF0000000000%s", 2),
}
BARE_PAYMENT, BARE_STAND_IN = r"\b\d{12}\b", "000000000000"


def _quoted(value: Column) -> Column:
    r"""A pattern that matches ``value`` as it stands, also where it holds ``\E``."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _follow(text: Column, label: str, value: str, by: Column | str) -> Column:
    """``text`` with what follows ``label`` replaced."""
    word = re.match("[A-Za-z]+", label)[0]
    return F.regexp_replace(text, F.lit(f"{word}({label.removeprefix(word)}){value}"), F.lit(f"{word}$1{by}") if isinstance(by, str) else F.concat_ws("", F.lit(f"{word}$1"), by))


def _hide_blocks(text: Column) -> Column:
    """The lines after an address label, up to the next line with a known label, hidden; empty lines stay."""
    *labels, start, end = (x.replace(r"\s*", r"[^\S\n]*") for x in (*BLOCK_LABELS, BLOCK_START, BLOCK_END))
    for label in labels:
        text = _follow(text, label, r"[^\n]*", f" {ADDRESS}")
    # A match is the next line to hide and the empty lines before it; it begins at a label's line or where the last match ended. Looking ahead for initials only saves time.
    first, initials = (f"[\n{''.join(sorted({x[0] for x in labels}))}]", f"[{''.join(sorted({x[0] for x in (*labels, *BLOCK_END.split('|'))}))}]")
    line = rf"(?={first})(\G(?!\A)|{start}[^\n]*)(\n(?:[^\S\n]*\n)*+)(?![^\n]*(?={initials})(?:{start}|{end}))[^\S\n]*+\S[^\n]*"
    return F.regexp_replace(text, line, f"$1$2{HIDDEN}")


def _stand_in(number: Column, template: str, digits: int) -> Column:
    before, after = template.split("%s")
    text = number.cast("string")
    return F.concat(F.lit(before), F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text), F.lit(after))


def _found(texts: Column, label: str, value: str) -> Column:
    """The values that follow a label, text by text."""
    return F.transform(texts, lambda p: F.coalesce(F.regexp_extract_all(p, F.lit(f"{label}({value})"), 1), F.array().cast("array<string>")))


def _numbered(kind: str, found: list[Column]) -> Column:
    """The distinct values that were found, in order of the texts, the patterns and their places, each with its stand-in."""
    _, template, digits = REFERENCES[kind]
    values = F.array_distinct(F.flatten(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), found)))
    # A map, since array_position leaves its loop by an exception, which takes longer than a pass over a page.
    return F.map_from_entries(F.transform(values, lambda v, i: F.struct(v, _stand_in(i + 1, template, digits))))


def _exchange(texts: Column, found: Column, label: str, value: str, numbered: Column) -> Column:
    """``texts`` with the values that were found after a label replaced by their stand-ins."""
    # Other stand-ins of the kind make or break no match, so as many values follow as were found.
    match = f"{label}{value}"

    def several(text: Column, values: Column) -> Column:
        pieces = F.zip_with(F.regexp_extract_all(text, F.lit(match), 0), values, lambda m, v: F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(v)), F.element_at(numbered, v)))
        return F.array_join(F.zip_with(F.split(text, match, -1), pieces, lambda kept, piece: F.concat(kept, F.coalesce(piece, F.lit("")))), "")

    return F.zip_with(texts, found, lambda p, v: F.when(F.size(v) == 0, p).when(F.size(v) == 1, _follow(p, label, value, F.element_at(numbered, F.element_at(v, 1)))).otherwise(several(p, v)))


def redact(documents: DataFrame, parts: str = "parts", forbidden: str | None = "forbidden") -> DataFrame:
    """``documents`` with ``parts`` redacted, and the columns ``replaced`` and ``leaks``.

    ``parts``: array of texts. ``forbidden``: array of private strings to hide wherever they stand, whatever their case
    (the longest first); layout can put them where no label tells. ``replaced``: array of (kind, value, stand_in) for
    numbered references. ``leaks``: what is still there, sorted: forbidden strings anywhere, and replaced values that are not part of a
    longer word, as where an order is named without its label, or a stand-in is a value itself. None: the
    document is clean. A null text stays null, a null array gives a null array and no leaks; null and empty forbidden
    strings are passed over. Other columns stay, but those three names are overwritten.
    """
    own = {c: F.col(f"`{c}`") for c in documents.columns}

    def plain(text: Column) -> Column:
        for pattern, fake in FIELDS:
            text = _follow(text, *pattern.removeprefix("(").split(")", 1), fake)
        return _hide_blocks(text)

    secret = own[forbidden] if forbidden else F.array().cast("array<string>")
    secret = F.array_distinct(F.filter(F.coalesce(secret, F.array().cast("array<string>")), lambda v: F.length(v) > 0))
    by_length = F.transform(F.sort_array(F.transform(secret, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), False), lambda s: s["v"])

    def scrub(text: Column) -> Column:
        return F.when(F.size("_secret") == 0, text).otherwise(F.regexp_replace(text, F.col("_hidden"), F.lit(r"[redacted]")))

    hidden = F.concat(F.lit("(?iu)"), F.array_join(F.transform(F.col("_secret"), _quoted), "|"))
    rows = documents.select("*", F.transform(own[parts], plain).alias("_clean"), by_length.alias("_secret")).withColumn("_hidden", hidden)
    for kind, (patterns, _, _) in REFERENCES.items():
        names = [f"_{kind}{n}" for n in range(len(patterns))]
        rows = rows.withColumns({n: _found(F.col("_clean"), *pattern) for n, pattern in zip(names, patterns, strict=True)})
        rows = rows.withColumn(f"_{kind}", _numbered(kind, [F.col(n) for n in names]))
        rows = rows.withColumn("_clean", reduce(lambda t, f: _exchange(t, F.col(f[0]), *f[1], F.col(f"_{kind}")), zip(names, patterns, strict=True), F.col("_clean")))
    rows = rows.withColumn("_clean", F.transform("_clean", lambda p: scrub(F.regexp_replace(p, BARE_PAYMENT, BARE_STAND_IN))))
    entries = [F.transform(F.map_entries(f"_{kind}"), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("value"), e["value"].alias("stand_in"))) for kind in REFERENCES]
    rows = rows.withColumn("_replaced", F.flatten(F.array(*entries))).withColumn("_whole", F.array_join("_clean", "\n"))
    whole, values = F.col("_whole"), F.coalesce(F.col("_replaced")["value"], F.array().cast("array<string>"))
    left = F.filter(F.col("_secret"), lambda v: F.contains(F.lower(whole), F.lower(v)))
    again = F.filter(values, lambda v: F.regexp_like(whole, F.concat(_quoted(v), F.lit("(?![0-9A-Za-z])(?<![0-9A-Za-z]"), _quoted(v), F.lit(")"))))
    rows = rows.withColumn("_leaks", F.when(F.col("_clean").isNull(), F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.concat(left, again)))))
    new = {parts: F.col("_clean"), "replaced": F.col("_replaced"), "leaks": F.col("_leaks")}
    return rows.select(*(own[c] for c in documents.columns if c not in new), *(c.alias(n) for n, c in new.items()))


def proven(redacted: DataFrame) -> DataFrame:
    """``redacted``, whose computation fails at the first document with leaks; its message does not repeat them."""
    count = F.size("leaks")
    checked = F.when(count > 0, F.raise_error(F.concat(F.lit("redaction left private values: "), count.cast("string")))).otherwise(F.col("leaks"))
    return redacted.withColumn("leaks", checked.cast("array<string>"))
