"""Pairing transfers between own accounts, in three passes of falling evidence.

Legs of different absolute amounts never compete, nor do legs of one amount with
three days or more without a leg of it between them, so the greedy passes run per
amount and run of days; within one they are sequential by definition (each debit
takes the nearest credit that is still free).
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import day_gap, references
from ledgerloom.operators.predicates import open_leg
from ledgerloom.session import checkpointed

MAX_GAP = 2


def by_reference(txns: DataFrame) -> DataFrame:
    """``txn_id, partner_id, reference``: exactly one other row quotes the reference, and it fits.

    A reference on three rows or more proves nothing, so it pairs none of them.
    """
    rows = txns.select("id", "account_id", "amount_paise", "txn_date", F.posexplode(references(F.col("narration"))).alias("pos", "reference"))
    twice = rows.groupBy("reference").agg(F.count_distinct("id").alias("n")).where("n = 2").select("reference")
    rows = rows.join(twice, "reference", "left_semi")
    other = rows.select("reference", F.col("id").alias("partner_id"), F.col("account_id").alias("other_account"), F.col("amount_paise").alias("other_amount"), F.col("txn_date").alias("other_date"))
    fits = (F.col("id") != F.col("partner_id")) & (F.col("account_id") != F.col("other_account")) & (F.col("amount_paise") == -F.col("other_amount")) & (day_gap(F.col("txn_date"), F.col("other_date")) <= MAX_GAP)
    return rows.join(other, "reference").where(fits).select("id", "partner_id", "reference", "pos", "account_id", "amount_paise")


def reference_pass(txns: DataFrame, locked: DataFrame) -> DataFrame:
    """``debit_id, credit_id, status, evidence``; a leg that the user explained is only suspected.

    Evaluated on the state before the pass: a debit takes its first fitting
    reference, a credit its first debit by account and id.
    """
    legs = txns.where(open_leg() & (F.col("type") != "opening_balance"))
    rows = by_reference(legs).where("amount_paise < 0")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("_n = 1")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("partner_id").orderBy("account_id", "id"))).where("_n = 1")
    return _status(rows.select(F.col("id").alias("debit_id"), F.col("partner_id").alias("credit_id")), locked, "reference")


def _status(pairs: DataFrame, locked: DataFrame, evidence: str) -> DataFrame:
    marks = locked.select("id").distinct()
    rows = pairs.join(marks.select(F.col("id").alias("debit_id"), F.lit(True).alias("_a")), "debit_id", "left").join(marks.select(F.col("id").alias("credit_id"), F.lit(True).alias("_b")), "credit_id", "left")
    held = F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))
    return rows.select("debit_id", "credit_id", F.when(held, "suspected").otherwise("resolved").alias("status"), F.lit(evidence).alias("evidence"))


def _nearest(legs: pd.DataFrame) -> pd.DataFrame:
    """Serial dictatorship within one run of days of one absolute amount: debits by account and id choose in turn.

    The free credits of a day wait by account in order of id, so a choice looks at the
    first of each account on five days, however many credits there are.
    """
    debits = legs[legs.amount_paise < 0].sort_values(["account_id", "id"])
    credits = legs[legs.amount_paise > 0].sort_values("id")
    waiting: dict[int, dict[int, deque[int]]] = {}
    for own in credits.itertuples():
        waiting.setdefault(own.day, {}).setdefault(own.account_id, deque()).append(own.id)
    out = []
    for own in debits.itertuples():
        choices, best = 0, None
        for day in range(own.day - MAX_GAP, own.day + MAX_GAP + 1):
            for account, line in waiting.get(day, {}).items():
                if line and account != own.account_id and (own.target < 0 or account == own.target):
                    choices += len(line)
                    first = (abs(day - own.day), line[0], line)
                    best = first if best is None or first[:2] < best[:2] else best
        if best:
            out.append((own.id, best[2].popleft(), choices))
    return pd.DataFrame(out, columns=["debit_id", "credit_id", "choices"]).astype("int64")


def _greedy(legs: DataFrame) -> DataFrame:
    """Pairs of ``_nearest``, for each absolute amount and each run of days in which legs of it lie at most two days apart.

    Runs come from the distinct days of an amount, not from its rows; legs of different runs can never pair.
    """
    rows = legs.select("id", "account_id", "amount_paise", F.unix_date("txn_date").cast("long").alias("day"), "target", F.abs("amount_paise").alias("size"))
    days = rows.groupBy("size", "day").agg(F.min("amount_paise").alias("lo"), F.max("amount_paise").alias("hi"))
    in_order = Window.partitionBy("size").orderBy("day")
    days = days.withColumn("starts", F.coalesce(F.col("day") - F.lag("day").over(in_order) > MAX_GAP, F.lit(False)).cast("int")).withColumn("run", F.sum("starts").over(in_order))
    both = days.withColumn("least", F.min("lo").over(Window.partitionBy("size", "run"))).withColumn("most", F.max("hi").over(Window.partitionBy("size", "run"))).where("least < 0 and most > 0")
    return rows.join(both.select("size", "day", "run"), ["size", "day"]).groupBy("size", "run").applyInPandas(_nearest, "debit_id long, credit_id long, choices long")


def amount_date_pass(txns: DataFrame) -> DataFrame:
    """Debits without a status and the nearest free credit of the same amount elsewhere: suspected."""
    legs = txns.where("transfer_status is null and type <> 'opening_balance'").withColumn("target", F.lit(-1).cast("long"))
    return _greedy(legs).select("debit_id", "credit_id", F.lit("suspected").alias("status"), F.lit("amount_date").alias("evidence"))


def keyword_pass(txns: DataFrame, keywords: DataFrame, locked: DataFrame) -> DataFrame:
    """Debits that name another own account: one partner resolves, several are suspected, none is pending.

    ``keywords``: account_id, keyword, kind. Only account numbers and payment
    handles count; the lowest keyword by account wins. There are few, so they are
    sent to all tasks (bounded by the number of own accounts).
    """
    strong = keywords.where("kind in ('account_number', 'upi_handle')").select(F.col("account_id").alias("target"), F.lower("keyword").alias("keyword"))
    legs = txns.where(open_leg() & (F.col("type") != "opening_balance"))
    named = legs.where("amount_paise < 0 and narration is not null").join(F.broadcast(strong), F.lower("narration").contains(F.col("keyword")) & (F.col("target") != F.col("account_id")))
    named = named.groupBy("id").agg(F.min("target").alias("target"))
    rows = legs.join(named, "id", "left")
    chosen = checkpointed(_greedy(rows.where("target is not null or amount_paise > 0").withColumn("target", F.coalesce("target", F.lit(-1)))))
    paired = _status(chosen.select("debit_id", "credit_id"), locked, "keyword").join(chosen.select("debit_id", "choices"), "debit_id")
    paired = paired.select("debit_id", "credit_id", F.when(F.col("choices") > 1, "suspected").otherwise(F.col("status")).alias("status"), "evidence")
    alone = named.select(F.col("id").alias("debit_id")).join(chosen.select("debit_id"), "debit_id", "left_anti")
    return paired.unionByName(alone.select("debit_id", F.lit(None).cast("long").alias("credit_id"), F.lit("pending").alias("status"), F.lit("keyword").alias("evidence")))


def mark(txns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``txns`` with the statuses of a pass; a pair's group is its debit's id."""
    legs = pairs.select(F.explode(F.array("debit_id", "credit_id")).alias("id"), F.col("status").alias("_status"), F.when(F.col("credit_id").isNotNull(), F.col("debit_id")).alias("_group")).where("id is not null")
    rows = txns.join(legs, "id", "left")
    new = {"transfer_status": F.coalesce("_status", "transfer_status"), "transfer_group_id": F.when(F.col("_status").isNotNull(), F.col("_group")).otherwise(F.col("transfer_group_id"))}
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in txns.columns))


def detect(txns: DataFrame, keywords: DataFrame, locked: DataFrame) -> DataFrame:
    """All pairs of the three passes; each pass sees what the one before it left."""
    first = checkpointed(reference_pass(txns, locked))
    after = mark(txns, first)
    second = checkpointed(keyword_pass(after, keywords, locked))
    return first.unionByName(second).unionByName(amount_date_pass(mark(after, second)))


def decide(txns: DataFrame, group_id: int, status: str) -> DataFrame:
    """``txns`` with a whole group confirmed (resolved), rejected, or unlinked (no status and no group)."""
    if status not in ("resolved", "rejected", "unlinked"):
        raise ValueError("unknown decision")
    hit = F.col("transfer_group_id").eqNullSafe(F.lit(group_id))
    kept = F.lit(None).cast("string") if status == "unlinked" else F.lit(status)
    out = txns.withColumn("transfer_status", F.when(hit, kept).otherwise(F.col("transfer_status")))
    return out.withColumn("transfer_group_id", F.when(hit & F.lit(status == "unlinked"), F.lit(None).cast("long")).otherwise(F.col("transfer_group_id")))


def page(txns: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of transfers by group, newest first, with all legs of each."""
    key = F.coalesce(F.concat(F.lit("g:"), F.col("transfer_group_id").cast("string")), F.concat(F.lit("txn:"), F.col("id").cast("string")))
    rows = txns.where("transfer_status is not null").withColumn("key", key)
    groups = rows.groupBy("key").agg(F.min("txn_date").alias("first_date")).orderBy(F.desc("first_date"), F.desc("key")).offset(offset).limit(limit)
    return rows.join(groups, "key").select("key", "first_date", "id", "account_id", "amount_paise", "txn_date", "transfer_status").orderBy(F.desc("first_date"), F.desc("key"), "amount_paise", "id")
