"""The balance walk: running totals held against the balances a bank states.

Ledger order is date, statement, place in the statement, id; missing statements
sort last. Running totals go in two levels, months within an account and rows
within a month, so one large account is many window partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_order() -> list[Column]:
    return [F.col("txn_date").asc(), F.col("statement_id").asc_nulls_last(), F.col("statement_seq").asc_nulls_last(), F.col("id").asc()]


def running_total(txns: DataFrame) -> DataFrame:
    """``txns`` with ``run``: the sum of the account's amounts up to and with the row."""
    month = F.trunc("txn_date", "month")
    rows = txns.withColumn("_month", month)
    months = rows.groupBy("account_id", "_month").agg(F.sum("amount_paise").alias("_sum"))
    earlier = Window.partitionBy("account_id").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("account_id", "_month", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("account_id", "_month").orderBy(*ledger_order()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(months, ["account_id", "_month"]).withColumn("run", F.col("_before") + F.sum("amount_paise").over(within)).drop("_month", "_before")


def checkpoints(stated: DataFrame) -> DataFrame:
    """Rows with a stated balance: ``expected_paise`` and whether it is the adopted anchor.

    The first stated balance of an account without an opening row is adopted;
    every later one must equal the one before plus the amounts between.
    """
    opened = stated.where("type = 'opening_balance'").select("account_id").distinct().withColumn("opened", F.lit(True))
    rows = running_total(stated).where("bank_balance_paise is not null").join(opened, "account_id", "left")
    order = Window.partitionBy("account_id").orderBy(*ledger_order())
    prev_stated, prev_run = F.lag("bank_balance_paise").over(order), F.lag("run").over(order)
    rows = rows.withColumn("_prev", prev_stated).withColumn("_prev_run", prev_run).withColumn("_first", F.row_number().over(order) == 1)
    anchor = F.col("_first") & F.col("opened").isNull()
    expected = F.when(anchor, F.col("bank_balance_paise")).when(F.col("_first"), F.col("run")).otherwise(F.col("_prev") + F.col("run") - F.col("_prev_run"))
    return rows.withColumn("anchor", anchor).withColumn("expected_paise", expected).drop("_prev", "_prev_run", "_first", "opened")


def discrepancies(stated: DataFrame) -> DataFrame:
    rows = checkpoints(stated).where("expected_paise <> bank_balance_paise")
    return rows.select("account_id", F.col("id").alias("transaction_id"), "txn_date", "expected_paise", F.col("bank_balance_paise").alias("stated_paise"), (F.col("bank_balance_paise") - F.col("expected_paise")).alias("difference_paise"))


def reconcile(stated: DataFrame) -> DataFrame:
    """One row per account with its verdict."""
    points = checkpoints(stated)
    last = F.max_by(F.struct("bank_balance_paise", "run"), F.struct("txn_date", F.coalesce("statement_id", F.lit(1 << 60)).alias("s"), F.coalesce("statement_seq", F.lit(1 << 60)).alias("q"), "id"))
    per = points.groupBy("account_id").agg(
        F.count("*").alias("checkpoints"), F.sum(F.when(F.col("expected_paise") != F.col("bank_balance_paise"), 1).otherwise(0)).alias("discrepancies"),
        F.max(F.when(F.col("anchor"), F.col("bank_balance_paise") - F.col("run"))).alias("implied_opening_paise"), last.alias("last"),
    )
    all_ = stated.groupBy("account_id").agg(F.sum("amount_paise").alias("balance_paise"), F.max((F.col("type") == "opening_balance").cast("int")).alias("opened"))
    rows = all_.join(per, "account_id", "left")
    points_, bad = F.coalesce("checkpoints", F.lit(0)), F.coalesce("discrepancies", F.lit(0))
    return rows.select(
        "account_id", "balance_paise", points_.alias("checkpoints"), bad.alias("discrepancies"), "implied_opening_paise",
        (F.col("last.bank_balance_paise") - F.col("last.run") - F.coalesce("implied_opening_paise", F.lit(0))).alias("total_difference_paise"),
        F.when(F.col("opened") == 1, "opening_balance_row").when(points_ > 0, "first_stated_balance").otherwise("none").alias("opening_anchor"),
        (points_ > 0).alias("verifiable"), (bad == 0).alias("reconciled"),
    )


def anomalies(stated: DataFrame) -> DataFrame:
    """Accounts whose statements can be checked and do not agree."""
    return reconcile(stated).where("verifiable and not reconciled")


def self_check(stated: DataFrame) -> DataFrame:
    """Adjacent rows of a statement whose balances do not follow from the amount."""
    order = Window.partitionBy("account_id", "statement_id").orderBy(F.col("txn_date"), F.col("statement_seq").asc_nulls_last(), F.col("id"))
    rows = stated.where("statement_id is not null").withColumn("previous_paise", F.lag("bank_balance_paise").over(order))
    return rows.where(F.col("previous_paise") + F.col("amount_paise") != F.col("bank_balance_paise")).select("account_id", "statement_id", "id", "previous_paise", "amount_paise", "bank_balance_paise")
