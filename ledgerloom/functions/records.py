"""JSON kept as text: parsed into variants, tested, merged and spread into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A variant; null where the text is null or no JSON."""
    return F.try_parse_json(text)


def field(record: Column, path: str, kind: str = "string") -> Column:
    """The value at ``path`` (as ``$.a.b[0]``); null if it is missing or does not fit ``kind``."""
    return F.try_variant_get(record, path, kind)


def has_key(record: Column, key: str) -> Column:
    """Whether an object has a key, null values included."""
    return F.coalesce(F.map_contains_key(F.try_variant_get(record, "$", "map<string,variant>"), key), F.lit(False))


def merged(old: Column, new: Column) -> Column:
    """JSON text of both objects; of a key in both the new value stays, nested objects as a whole. A side that is no object counts as empty."""
    each = lambda text: F.coalesce(F.try_variant_get(parsed(text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    before, after = each(old), each(new)
    kept = F.map_filter(before, lambda k, _: ~F.map_contains_key(after, k))
    return F.to_json(F.map_concat(kept, after))


def rejects(rows: DataFrame, text_col: str) -> DataFrame:
    """One row: how many texts there are, and how many of them are no JSON."""
    bad = F.col(text_col).isNotNull() & parsed(F.col(text_col)).isNull()
    return rows.agg(F.count(text_col).alias("texts"), F.count(F.when(bad, 1)).alias("malformed"))


def elements(rows: DataFrame, text_col: str, path: str, fields: dict[str, tuple[str, str]], place: str = "place") -> DataFrame:
    """``rows`` with a row per element of the array at ``path``: ``place`` from 0, and ``fields`` (name to path and kind).

    Elements that lack a field have null there; a text that is no JSON, or has no array there, gives no rows.
    """
    array = F.try_variant_get(parsed(F.col(text_col)), path, "array<variant>")
    each = rows.select(*rows.columns, F.posexplode(array).alias(place, "_element"))
    return each.select(*rows.columns, place, *(field(F.col("_element"), at, kind).alias(name) for name, (at, kind) in fields.items()))
