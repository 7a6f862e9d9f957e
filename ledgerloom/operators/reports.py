"""Reports: where money went, what was consumed, what is still unexplained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.predicates import explainable_spend, with_explained


def total(x: Column | str) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def total_where(condition, x: Column | str) -> Column:
    return total(F.when(condition, F.col(x) if isinstance(x, str) else x).otherwise(0))


def named_categories(categories: DataFrame) -> DataFrame:
    """``category_id, category, parent_id, parent, excluded``; excluded if the parent is."""
    parents = categories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"), F.col("excluded_from_spend").alias("_above"))
    own = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"), "parent_id", F.col("excluded_from_spend").alias("_own"))
    rows = own.join(parents, "parent_id", "left")
    return rows.select("category_id", "category", "parent_id", "parent", (F.col("_own") | F.coalesce("_above", F.lit(False))).alias("excluded"))


def by_category(txns: DataFrame, allocations: DataFrame, categories: DataFrame) -> DataFrame:
    """Signed sums by category and provenance over explainable spending."""
    spend = txns.where(explainable_spend()).select(F.col("id").alias("transaction_id"))
    rows = allocations.join(spend, "transaction_id").join(named_categories(categories), "category_id")
    return rows.groupBy("category_id", "category", "parent").agg(
        *(total_where(F.col("source") == s, "amount_paise").alias(f"{s}_paise") for s in ("user", "rule", "evidence")),
        total("amount_paise").alias("total_paise"), F.count_distinct("transaction_id").alias("transactions"), total(F.abs("amount_paise")).alias("moved_paise"),
    )


def totals(txns: DataFrame, allocations: DataFrame) -> DataFrame:
    """Money out and in, and what is unexplained: absolute by transaction before it is summed."""
    rows = with_explained(txns.where(explainable_spend()), allocations)
    open_ = F.abs(F.col("amount_paise") - F.col("explained"))
    out, in_ = F.col("amount_paise") < 0, F.col("amount_paise") > 0
    return rows.agg(
        total_where(out, -F.col("amount_paise")).alias("out_paise"), total_where(in_, "amount_paise").alias("in_paise"), total(open_).alias("unexplained_paise"),
        total_where(out, open_).alias("unexplained_out_paise"), total_where(in_, open_).alias("unexplained_in_paise"), F.count("*").alias("transactions"),
    )


def by_rule(txns: DataFrame, allocations: DataFrame, rules: DataFrame) -> DataFrame:
    """What each rule explains, provisionally or confirmed; rules without matches stay."""
    spend = txns.where(explainable_spend()).select(F.col("id").alias("transaction_id"), "txn_date")
    touched = allocations.withColumn("_rule", F.coalesce("rule_id", "confirmed_from_rule_id")).where("_rule is not null").join(spend, "transaction_id")
    impact = touched.groupBy("_rule").agg(
        F.count("*").alias("allocations"), F.count_distinct("transaction_id").alias("transactions"), total(F.abs("amount_paise")).alias("moved_paise"), total("amount_paise").alias("net_paise"),
        F.count(F.when(F.col("rule_id").isNotNull(), 1)).alias("provisional"), F.count(F.when(F.col("rule_id").isNull(), 1)).alias("confirmed"),
        F.min("txn_date").alias("first_seen"), F.max("txn_date").alias("last_seen"),
    )
    rows = rules.select(F.col("id").alias("rule_id"), "name", "enabled", "priority").join(impact, F.col("rule_id") == F.col("_rule"), "left").drop("_rule")
    return rows.fillna(0, ["allocations", "transactions", "moved_paise", "net_paise", "provisional", "confirmed"])


def summary(txns: DataFrame, allocations: DataFrame) -> DataFrame:
    """Net over everything; unexplained and provisional over explainable spending only."""
    rule = allocations.where("source = 'rule'").groupBy(F.col("transaction_id").alias("id")).agg(F.sum(F.abs("amount_paise")).alias("provisional"))
    rows = with_explained(txns, allocations).join(rule, "id", "left").withColumn("gate", explainable_spend())
    return rows.agg(
        total("amount_paise").alias("net_paise"), total_where(F.col("gate"), F.abs(F.col("amount_paise") - F.col("explained"))).alias("unexplained_paise"),
        F.count(F.when(F.col("gate") & (F.col("amount_paise") != F.col("explained")), 1)).alias("unexplained_transactions"), total_where(F.col("gate"), F.coalesce("provisional", F.lit(0))).alias("provisional_paise"),
    )


def by_month(txns: DataFrame, allocations: DataFrame) -> DataFrame:
    """Debits by month; months without any are absent."""
    sums = allocations.groupBy(F.col("transaction_id").alias("id")).agg(F.sum("amount_paise").alias("explained"), *(F.sum(F.when(F.col("source") == s, F.col("amount_paise")).otherwise(0)).alias(s) for s in ("rule", "user", "evidence")))
    rows = txns.where(explainable_spend() & (F.col("amount_paise") < 0)).join(sums, "id", "left").fillna(0, ["explained", "rule", "user", "evidence"])
    return rows.groupBy(F.date_format("txn_date", "yyyy-MM").alias("month")).agg(
        total(-F.col("amount_paise")).alias("out_paise"), total(-F.col("rule")).alias("provisional_paise"), total(-F.col("user")).alias("confirmed_paise"), total(-F.col("evidence")).alias("evidence_paise"),
        total(F.abs(F.col("amount_paise") - F.col("explained"))).alias("unexplained_paise"), F.count("*").alias("debits"),
    )


def month_trend(months: DataFrame) -> DataFrame:
    """Change on the month before, in paise and per cent to one place (none on a zero base)."""
    last = F.lag("out_paise").over(Window.orderBy("month"))
    rows = months.select("month", "out_paise").withColumn("last", last).withColumn("delta_paise", F.col("out_paise") - F.col("last"))
    return rows.select("month", "out_paise", "delta_paise", F.when(F.col("last") != 0, F.floor(F.col("delta_paise") * 1000 / F.abs("last") + 0.5).cast("long")).alias("change_permille"))


def consumption_rows(txns: DataFrame, allocations: DataFrame, consumption: DataFrame, categories: DataFrame) -> DataFrame:
    """What was consumed: own spending that counts, and what others paid."""
    spend = txns.where(explainable_spend()).select(F.col("id").alias("transaction_id"), "account_id", F.col("txn_date").alias("consumed_on"))
    counted = named_categories(categories).where("not excluded").select("category_id")
    none = F.lit(None).cast("long")
    own = allocations.join(counted, "category_id", "left_semi").join(spend, "transaction_id")
    own = own.select("id", F.lit("allocation").alias("origin"), "transaction_id", none.alias("evidence_id"), "account_id", "category_id", "amount_paise", "consumed_on", "source")
    theirs = consumption.select("id", F.lit("paid_for_you").alias("origin"), none.alias("transaction_id"), "evidence_id", none.alias("account_id"), "category_id", "amount_paise", "consumed_on", "source")
    return own.unionByName(theirs)


def consumption_by_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    named = named_categories(categories).select("category_id", "category", "parent")
    return rows.join(named, "category_id").groupBy("category_id", "category", "parent").agg(total(-F.col("amount_paise")).alias("consumed_paise"), F.count("*").alias("entries"))


def side_terms(rows: DataFrame) -> DataFrame:
    theirs = F.col("origin") == "paid_for_you"
    return rows.agg(
        total_where(theirs, -F.col("amount_paise")).alias("paid_for_you_paise"), total_where(~theirs & (F.col("amount_paise") > 0), "amount_paise").alias("received_paise"), total(-F.col("amount_paise")).alias("consumed_paise")
    )


def money_terms(txns: DataFrame, allocations: DataFrame, categories: DataFrame) -> DataFrame:
    """Money out, unexplained, and fronted for others (an excluded category), over debits."""
    fronted = allocations.join(named_categories(categories).where("excluded").select("category_id"), "category_id", "left_semi")
    fronted = fronted.groupBy(F.col("transaction_id").alias("id")).agg(F.sum("amount_paise").alias("fronted"))
    rows = with_explained(txns.where(explainable_spend() & (F.col("amount_paise") < 0)), allocations).join(fronted, "id", "left")
    return rows.agg(
        total(-F.col("amount_paise")).alias("money_out_paise"), total(-(F.col("amount_paise") - F.col("explained"))).alias("unexplained_paise"), total(-F.coalesce("fronted", F.lit(0))).alias("fronted_paise")
    )


def unclassified(purchases: DataFrame, source_map: DataFrame) -> DataFrame:
    """What was consumed under words without a category: never seen, or known to have none."""
    mapped = source_map.where("category_id is not null").select(F.col("source_category").alias("word"))
    return purchases.join(mapped, "word", "left_anti").agg(total("value_paise").alias("unclassified_paise"), F.count("*").alias("records"))


def unaccounted(money: DataFrame, side: DataFrame) -> DataFrame:
    """Consumed less what the money terms say it must be; both frames have one row."""
    rows = money.withColumn("_one", F.lit(1)).join(side.withColumn("_one", F.lit(1)), "_one")
    expected = F.col("money_out_paise") - F.col("unexplained_paise") - F.col("fronted_paise") + F.col("paid_for_you_paise") - F.col("received_paise")
    return rows.select("consumed_paise", (F.col("consumed_paise") - expected).alias("unaccounted_paise"))


def balances(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    sums = txns.groupBy("account_id").agg(F.sum("amount_paise").alias("balance_paise"), F.count("*").alias("transactions"))
    return accounts.join(sums, F.col("id") == F.col("account_id"), "left").select("id", "name", "bank", F.coalesce("balance_paise", F.lit(0)).alias("balance_paise"), F.coalesce("transactions", F.lit(0)).alias("transactions"))


def transfer_counts(txns: DataFrame) -> DataFrame:
    """Transfers by status: a group counts once, an ungrouped leg by itself."""
    key = F.coalesce(F.concat(F.lit("g:"), F.col("transfer_group_id").cast("string")), F.concat(F.lit("txn:"), F.col("id").cast("string")))
    return txns.where("transfer_status is not null").groupBy("transfer_status").agg(F.count_distinct(key).alias("transfers"), F.count("*").alias("legs"))


def rollup_parents(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Totals of each parent with its children, from ``by_category`` rows."""
    owner = categories.select(F.col("id").alias("category_id"), F.coalesce("parent_id", "id").alias("root_id"))
    return rows.join(owner, "category_id").groupBy("root_id").agg(total("total_paise").alias("total_paise"), total("transactions").alias("transactions"), F.count("*").alias("categories"))


def category_usage(categories: DataFrame, allocations: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """Each category with its parent's name and how much refers to it, parents first."""
    rows = categories.join(categories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left")
    for name, frame in (("allocations", allocations), ("rules", rules), ("items", items)):
        counts = frame.where("category_id is not null").groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias(name))
        rows = rows.join(counts, "id", "left").fillna(0, [name])
    return rows.select("id", "name", "parent_id", "parent", "excluded_from_spend", "allocations", "rules", "items").orderBy(F.coalesce("parent", "name"), F.col("parent").asc_nulls_first(), "name")


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Allocations and rules of each parent with those of its children, from ``category_usage`` rows; ``scale`` is the most allocations of any, at least 1."""
    kids = usage.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sum("allocations").alias("_allocations"), F.sum("rules").alias("_rules"))
    rows = usage.where("parent_id is null").join(kids, "id", "left").select("id", "name", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("allocations", "rules")))
    return rows.withColumn("scale", F.greatest(F.lit(1).cast("long"), rows.agg(F.max("allocations")).scalar()))


def compare_periods(txns: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Spending of a period and of the equally long one before it."""
    days = F.datediff(F.lit(date_to).cast("date"), F.lit(date_from).cast("date")) + 1
    start = F.date_sub(F.lit(date_from).cast("date"), days)
    rows = txns.where(explainable_spend() & (F.col("amount_paise") < 0) & F.col("txn_date").between(start, F.lit(date_to).cast("date")))
    now = F.col("txn_date") >= F.lit(date_from).cast("date")
    return rows.agg(total_where(now, -F.col("amount_paise")).alias("now_paise"), total_where(~now, -F.col("amount_paise")).alias("before_paise"))
