"""Text functions on narrations, names and amounts, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(narration: Column) -> Column:
    """Lower case, separators to blanks, runs of six digits or more gone, blanks collapsed."""
    out = F.lower(F.coalesce(narration, F.lit("")))
    out = F.regexp_replace(out, r"[-/*_.:,#|]+", " ")
    out = F.regexp_replace(out, r"[0-9]{6,}", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def references(narration: Column) -> Column:
    """The distinct twelve-digit references of a narration, in order."""
    found = F.regexp_extract_all(F.coalesce(narration, F.lit("")), F.lit("(?<![0-9A-Za-z])[0-9]{12}(?![0-9A-Za-z])"), F.lit(0))
    return F.array_distinct(found)


def day_gap(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def to_paise(text: Column) -> Column:
    """Paise of a strictly written amount, or null: grouped thousands, at most two decimals."""
    plain = F.regexp_replace(text, ",", "")
    good = text.rlike(r"^-?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]{1,2})?$")
    return F.when(good, (plain.try_cast("decimal(30,2)") * 100).cast("long"))


def iso_date(text: Column) -> Column:
    """A date written year first or day first with dots, strokes or hyphens; null otherwise."""
    day_first = F.regexp_extract(text, r"^([0-9]{2})[./-]([0-9]{2})[./-]([0-9]{4})$", 0)
    turned = F.concat_ws("-", *(F.regexp_extract(text, r"^([0-9]{2})[./-]([0-9]{2})[./-]([0-9]{4})$", k) for k in (3, 2, 1)))
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(day_first != "", F.try_to_date(turned, "yyyy-MM-dd"))


def transaction_hash(account_id: Column, date: Column, time: Column, amount: Column, narration: Column) -> Column:
    """The identity under which an imported row is recognised."""
    parts = (account_id, date, time, amount, narration)
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


# Units, pack words, counts and containers that make a variant of a product, in the order in which they are taken out.
UNITS = "g|gm|gms|gram|grams|kg|kgs|mg|ml|l|ltr|ltrs|litre|litres|liter|liters"
CONTAINERS = "bottle|pouch|can|jar|tin|box|carton|sachet|packet|refill"
VARIANT_WORDS = (
    rf"\b[0-9]+(\.[0-9]+)?\s*({UNITS})\b",
    r"\b(pack|set|combo|pair)\s+of\s+[0-9]+\b",
    r"\b[0-9]+\s*[x×]\s*[0-9]+(\.[0-9]+)?\s*(g|gm|ml|kg|l)\b",
    r"\b[0-9]+\s*(pcs|pc|pieces|count|units?|tablets?|capsules?|sachets?)\b",
    rf"\b(pet bottle|tetra pak|tetrapak|{CONTAINERS})\b",
)


def canonical_name(text: Column) -> Column:
    """A product name without what its seller prints around it, and without sizes, packs, counts and containers."""
    out = F.regexp_replace(F.lower(without_merchant_noise(text)), "[\u200b-\u200d\ufeff]", "")
    for words in VARIANT_WORDS:
        out = F.regexp_replace(out, words, " ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def without_merchant_noise(text: Column) -> Column:
    """A printed product name without the seller's tariff codes and stock numbers, blanks collapsed."""
    # How sellers print tariff codes (HSN, four to eight digits) and stock numbers (B0 and eight more).
    out = F.regexp_replace(text, r"(?i)\bhsn\s*[:-]\s*[0-9]{4,8}\b", " ")
    out = F.regexp_replace(out, r"(?i)\(\s*hsn[-:\s]*[0-9]{4,8}\s*\)", " ")
    out = F.regexp_replace(out, r"(?i)\|\s*b0[a-z0-9]{8}\s*\(?[^)]*\)?\s*$", " ")
    out = F.regexp_replace(out, r"\bB0[A-Z0-9]{8}\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\(\s*\)", " "), r"\s+", " "))


def variant_difference(a: Column, b: Column) -> Column:
    """``same_product, reason, differing`` of two canonical names compared as sets of words.

    Variants differ by at most one word a side, share at least five, and do not
    differ by a bare number, which reads as a model. Null names have no words.
    """
    own, other = (F.array_distinct(F.filter(F.split(F.coalesce(x, F.lit("")), " "), lambda w: w != "")) for x in (a, b))
    lost, won = F.array_except(own, other), F.array_except(other, own)
    differing = F.concat(lost, won)
    reason = (
        F.when(F.size(differing) == 0, None).when(F.greatest(F.size(lost), F.size(won)) > 1, "many_words").when(F.size(F.array_intersect(own, other)) < 5, "little_in_common")
        .when(F.exists(differing, lambda w: w.rlike("^[0-9]+$")), "bare_number")
    )
    return F.struct(reason.isNull().alias("same_product"), reason.alias("reason"), differing.alias("differing"))


def variant_attributes(text: Column) -> Column:
    """``size`` (the last measure), ``pack`` (the first container) and ``pack_of`` (the first) that a name states, where it does."""
    low = F.lower(without_merchant_noise(text))
    measure = rf"\b([0-9]+(?:\.[0-9]+)?)\s*({UNITS})\b"
    last = F.try_element_at(F.regexp_extract_all(low, F.lit(measure), F.lit(0)), F.lit(-1))
    size = F.concat_ws(" ", F.regexp_extract(last, measure, 1), F.regexp_extract(last, measure, 2))
    pack = F.regexp_replace(F.regexp_extract(low, rf"\b(pet bottle|tetra ?pak|{CONTAINERS})\b", 1), r"\s+", " ")
    many = F.regexp_extract(low, r"\b(?:pack|set|combo|pair)\s+of\s+([0-9]+)\b", 1)
    found = F.create_map(F.lit("size"), F.when(last.isNotNull(), size), F.lit("pack"), F.when(pack != "", pack), F.lit("pack_of"), F.when(many != "", many))
    return F.map_filter(found, lambda _, v: v.isNotNull())


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams of all trigrams (each list without repeats), as a whole number of hundredths (half up)."""
    shared = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - shared
    return F.when(all_ > 0, F.floor((shared * 200 + all_) / (all_ * 2))).otherwise(0).cast("int")


def merchant_slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def mime_type(data: Column) -> Column:
    """What the leading bytes say; null if they say nothing."""
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(F.is_valid_utf8(data.cast("string")), "text/plain")
