"""Shared-expense exports: validation, group keys, the import plan and source words."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import iso_date, to_paise

#: The longest key of a group, and what counts as space besides what Spark's pattern class has.
GROUP_CHARS, SPACES = 64, r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def validate(rows: DataFrame, people: int) -> DataFrame:
    """``line, errors``: what is wrong with each row of an export; none of it may be imported if any is.

    ``rows``: line, date, cost (text), nets (array of text, one per person).
    """
    nets = F.transform("nets", to_paise)
    checks = {
        "bad_date": iso_date(F.col("date")).isNull(), "bad_cost": F.coalesce(to_paise(F.col("cost")) <= 0, F.lit(True)), "bad_net": F.exists(nets, lambda n: n.isNull()),
        "unbalanced": F.abs(F.aggregate(nets, F.lit(0).cast("long"), lambda s, n: s + F.coalesce(n, F.lit(0).cast("long")))) > people,
        "share_over_cost": F.exists(nets, lambda n: F.abs(n) > to_paise(F.col("cost"))),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items())))
    return rows.select("line", F.array_join(found, ",").alias("errors"))


def plan(purchases: DataFrame, source_map: DataFrame) -> DataFrame:
    """Whether each record becomes consumption, stays unclassified, or has an unmapped word.

    A word that is missing from the map was never seen; one with no category is
    known to have none.
    """
    seen = source_map.withColumn("seen", F.lit(True))
    rows = purchases.join(seen, F.col("word") == F.col("source_category"), "left")
    fate = F.when(F.col("category_id").isNotNull(), "consumed").when(F.col("seen").isNull(), "unmapped").otherwise("unclassified")
    return rows.select("event_id", "word", "category_id", fate.alias("fate"))


def vocabulary(purchases: DataFrame, source_map: DataFrame) -> DataFrame:
    """All words, seen or mapped, with how often and for how much they occur."""
    words = purchases.select("word").union(source_map.select("source_category")).distinct()
    usage = purchases.groupBy("word").agg(F.count("*").alias("records"), F.sum("value_paise").alias("value_paise"))
    mapped = source_map.select(F.col("source_category").alias("word"), "category_id", F.lit(True).alias("mapped"))
    rows = words.join(usage, "word", "left").join(mapped, "word", "left")
    return rows.select("word", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("value_paise", F.lit(0)).alias("value_paise"), "category_id", F.coalesce("mapped", F.lit(False)).alias("mapped"))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, for which Spark has no function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def group_key(name: Column) -> Column:
    """A group's name as part of a reference: composed, no control characters, bars as spaces, lower case, 64 characters."""
    clean = F.regexp_replace(F.regexp_replace(nfc(name), r"\p{Cc}", ""), r"\|", " ")
    return F.rtrim(F.substring(F.lower(F.trim(F.regexp_replace(clean, SPACES, " "))), 1, GROUP_CHARS))


def external_ref(group: Column, date: Column, description: Column, cost_paise: Column) -> Column:
    """What names a record of an export: its group's key, day, description and cost, readable rather than hashed."""
    words = F.lower(F.trim(F.regexp_replace(description, SPACES, " ")))
    return F.concat(group, F.lit("|"), date.cast("string"), F.lit("|"), words, F.lit("|"), cost_paise.cast("string"))


@dataclass(frozen=True)
class ImportPlan:
    """What the records of exports become; nothing is written.

    ``evidence``: every record, also those that the owner has no part in, since the balances follow from all of them:
    group, external_ref, date, description, source_category, cost_paise, net_paise, kind, payload (JSON text). ``consumption``:
    external_ref, category_id, amount_paise (negative), consumed_on. ``unclassified``: external_ref, source_category, amount_paise
    of what was consumed under a word without a category. ``unmapped``: words that the map has never seen, once each.
    ``stats``: group, paid, owed_by_me, not_mine, payments.
    """

    evidence: DataFrame
    consumption: DataFrame
    unclassified: DataFrame
    unmapped: DataFrame
    stats: DataFrame


def import_plan(rows: DataFrame, groups: DataFrame, source_map: DataFrame) -> ImportPlan:
    """The plan for ``Exports.rows``; ``groups``: file, group (its name, as the file itself does not tell it).

    A settlement is no consumption, and neither is what the owner paid: that comes from the bank row it will match.
    A word that is missing from ``source_map`` was never seen; one with no category is known to have none. Files without a
    group are left out.
    """
    named = rows.join(groups.select("file", group_key(F.col("group")).alias("group")), "file").withColumn("external_ref", external_ref(F.col("group"), F.col("date"), F.col("description"), F.col("cost_paise")))
    role = F.when(F.col("kind") == "payment", "payments").when(F.col("net_paise") > 0, "paid").when(F.col("net_paise") == 0, "not_mine").otherwise("owed_by_me")
    known = source_map.select(F.col("source_category").alias("category"), "category_id", F.lit(True).alias("seen"))
    judged = named.withColumn("role", role).join(known, "category", "left")
    payload = F.to_json(F.struct("cost_paise", F.col("nets").alias("nets_paise"), "currency", F.col("category").alias("source_category"), "kind", "group"))
    owed = judged.where("role = 'owed_by_me'")
    return ImportPlan(
        named.select("group", "external_ref", "date", "description", F.col("category").alias("source_category"), "cost_paise", "net_paise", "kind", payload.alias("payload")),
        owed.where("category_id is not null").select("external_ref", "category_id", F.col("net_paise").alias("amount_paise"), F.col("date").alias("consumed_on")),
        owed.where("category_id is null").select("external_ref", F.col("category").alias("source_category"), F.col("net_paise").alias("amount_paise")),
        owed.where("seen is null").select(F.col("category").alias("source_category")).distinct(),
        judged.groupBy("group").agg(*(F.count(F.when(F.col("role") == r, 1)).alias(r) for r in ("paid", "owed_by_me", "not_mine", "payments"))),
    )


def vocabulary_worklist(evidence: DataFrame, source_map: DataFrame, categories: DataFrame) -> DataFrame:
    """All words, seen or mapped, with their category and its parent, undecided first, then by what was consumed under them.

    ``evidence``: as in ``ImportPlan``. Only expenses that others paid for the owner are consumed.
    """
    consumed = (F.col("kind") == "expense") & (F.col("net_paise") < 0)
    seen = evidence.groupBy("source_category").agg(F.count("*").alias("records"), F.count(F.when(consumed, 1)).alias("consumed_records"), F.sum(F.when(consumed, -F.col("net_paise"))).alias("consumed_paise"))
    decided = source_map.select("source_category", "category_id", F.lit(True).alias("decided"))
    rows = seen.join(decided, "source_category", "full").join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"), "parent_id"), "category_id", "left")
    rows = rows.join(categories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left")
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "consumed_records", "consumed_paise"))
    return rows.select("source_category", "category_id", "category", "parent", F.coalesce("decided", F.lit(False)).alias("decided"), *counts).orderBy("decided", F.desc("consumed_paise"), "source_category")


def stale(consumption: DataFrame, purchases: DataFrame, source_map: DataFrame) -> DataFrame:
    """Consumption whose category is no longer the one its word maps to."""
    now = plan(purchases, source_map).select(F.col("event_id").alias("evidence_id"), F.col("category_id").alias("now"))
    return consumption.join(now, "evidence_id", "left").where(~F.col("category_id").eqNullSafe(F.col("now"))).select("evidence_id", "category_id", "now")
