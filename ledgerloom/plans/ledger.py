"""A ledger seen through the star-schema tables: every view is a lazy DataFrame.

The same definitions exist as SQL in ``oracle_views``; both must change together.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import held

#: Ids of mirror legs lie above those of all orders.
MIRROR = 1_000_000_000_000
LEDGER_ORDER = ("txn_date", "statement_id", "statement_seq", "id")
#: The lines of an order, by everything that tells them apart.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
#: Lines of a part, about, where whole orders are put together. Beyond 200 parts Spark sorts what a task writes in its memory.
PART_LINES = 1_200_000

#: name, conditions (field, op, value, kind), mode, category, priority, enabled
RULES = (
    (1, "anvils", (("narration", "contains", "anvil", "string"),), "all", 1001, 10, True),
    (2, "blue bolts", (("narration", "contains", "blue", "string"), ("narration", "contains", "bolt", "string")), "all", 2002, 20, True),
    (3, "gears or large", (("narration", "contains", "gear", "string"), ("amount_paise", "lt", -45000000, "number")), "any", 3003, 10, True),
    (4, "switched off", (("narration", "contains", "cold", "string"),), "all", 4004, 90, False),
    (5, "late rings", (("narration", "contains", "ring", "string"), ("txn_date", "gt", "1999-01-01", "string")), "all", 5005, 10, True),
    (6, "incoming", (("amount_paise", "gt", 30000000, "number"),), "all", 6006, 5, True),
)


def paise(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


class Ledger:
    """Views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def once(self, *views: str) -> Ledger:
        """The same ledger with some views computed once; for queries that read them, or others made of them, several times."""
        out = Ledger(self.spark, self.folder)
        for view in views:
            out.__dict__[view] = held(getattr(out, view))
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def accounts(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("bank"))

    @cached_property
    def kinds(self) -> DataFrame:
        """The product types, ranked: there are as many as parent categories."""
        types = self.table("part").select("p_type").distinct()
        return types.select("p_type", F.dense_rank().over(Window.orderBy("p_type")).cast("long").alias("rank"))

    @cached_property
    def parts(self) -> DataFrame:
        part = self.table("part").join(self.kinds, "p_type")
        leaf = F.col("rank") * 1000 + F.substring("p_brand", 7, 9).cast("long")
        return part.select("p_partkey", "p_name", "p_brand", "p_type", "rank", leaf.alias("leaf"))

    @cached_property
    def categories(self) -> DataFrame:
        parents = self.kinds.select(F.col("rank").alias("id"), F.col("p_type").alias("name"), F.lit(None).cast("long").alias("parent_id"), (F.col("rank") % 5 == 0).alias("excluded_from_spend"))
        leaves = self.parts.select(F.col("leaf").alias("id"), F.col("p_brand").alias("name"), F.col("rank").alias("parent_id"), (F.col("leaf") % 1000 == 7).alias("excluded_from_spend")).distinct()
        return parents.unionByName(leaves)

    @cached_property
    def base(self) -> DataFrame:
        first = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey"))
        orders = self.table("orders").join(self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(first, "o_orderkey", "left").join(self.parts, "p_partkey", "left")
        sign = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(-1)
        return orders.select(
            F.col("o_orderkey").alias("id"), (F.col("c_nationkey") + 1).cast("long").alias("account_id"), F.to_date("o_orderdate").alias("txn_date"), (sign * paise("o_totalprice")).alias("amount_paise"),
            F.coalesce("p_name", F.lit("cash")).alias("part_name"), F.coalesce("p_brand", F.lit("none")).alias("brand"), F.coalesce("leaf", F.lit(1).cast("long")).alias("leaf"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        k = F.col("id")
        narration = F.concat(F.lit("UPI-Debit-"), F.lpad(k.cast("string"), 12, "0"), F.lit("-"), F.upper("part_name"), F.lit("-"), F.col("brand"))
        own = self.base.select(
            "id", "account_id", F.when(k % 13 != 0, F.year("txn_date") * 100 + F.month("txn_date")).cast("long").alias("statement_id"), (k % 1000).alias("statement_seq"), "txn_date", "amount_paise",
            F.when(k % 97 == 0, "opening_balance").when(k % 89 == 0, "transfer").otherwise("regular").alias("type"), F.when(k % 41 != 0, narration).alias("narration"),
            F.when(k % 89 == 0, "resolved").when(k % 79 == 0, "suspected").when(k % 83 == 0, "rejected").when(k % 71 == 0, "pending").alias("transfer_status"),
            F.when((k % 89 == 0) | (k % 79 == 0), F.floor(k / 2)).cast("long").alias("transfer_group_id"),
        )
        none = F.lit(None)
        mirror = self.base.where(k % 50 == 0).select(
            (k + MIRROR).alias("id"), (F.col("account_id") % 25 + 1).alias("account_id"), none.cast("long").alias("statement_id"), none.cast("long").alias("statement_seq"),
            F.date_add("txn_date", (k % 4).cast("int")).alias("txn_date"), (-F.col("amount_paise")).alias("amount_paise"), F.lit("regular").alias("type"), narration.alias("narration"),
            none.cast("string").alias("transfer_status"), none.cast("long").alias("transfer_group_id"),
        )
        return own.unionByName(mirror)

    @cached_property
    def stated(self) -> DataFrame:
        """Transactions with the balances their bank states."""
        from ledgerloom.operators.reconcile import running_total

        run = running_total(self.transactions)
        k = F.col("id")
        stated = F.col("run") + F.when(k % 500 == 0, 12345).otherwise(0)
        return run.withColumn("bank_balance_paise", F.when(k % 16 != 0, stated)).drop("run")

    @cached_property
    def allocations(self) -> DataFrame:
        k = F.col("id")
        source = F.when(k % 7 == 0, "user").when(k % 3 == 0, "rule").when(k % 11 == 0, "evidence")
        rows = self.base.withColumn("source", source).where("source is not null")
        half = F.expr("amount_paise div 2")
        rule = (k % 6 + 1).cast("long")
        return rows.select(
            "id", k.alias("transaction_id"), F.when(k % 2 == 0, F.col("amount_paise")).otherwise(half).alias("amount_paise"), F.col("leaf").alias("category_id"),
            F.when(F.col("source") == "rule", F.lit("0.80")).otherwise("1.00").cast("decimal(3,2)").alias("confidence"), "source",
            F.when(F.col("source") == "rule", rule).alias("rule_id"), F.when(F.col("source") == "evidence", k).alias("evidence_id"),
            F.when((F.col("source") == "user") & (k % 14 == 0), rule).alias("confirmed_from_rule_id"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        schema = "id long, name string, match_mode string, category_id long, priority int, enabled boolean"
        return self.spark.createDataFrame([(i, n, m, c, p, e) for i, n, _, m, c, p, e in RULES], schema)

    @cached_property
    def evidence(self) -> DataFrame:
        k = F.col("id")
        net = F.when(k % 3 == 0, F.abs("amount_paise")).when(k % 3 == 1, -F.expr("abs(amount_paise) div 2")).otherwise(0).cast("long")
        return self.base.select(
            "id", F.when(k % 2 == 0, "invoice").otherwise("shared").alias("source_type"), F.concat(F.lit("ORD-"), k.cast("string")).alias("external_ref"), F.date_add("txn_date", (k % 7).cast("int")).alias("evidence_date"),
            F.abs("amount_paise").alias("cost_paise"), net.alias("my_net_paise"), F.when(k % 4 == 0, "payment").otherwise("expense").alias("kind"), F.col("part_name").alias("description"),
        )

    @cached_property
    def evidence_transactions(self) -> DataFrame:
        return self.base.where("id % 55 = 0").select(F.col("id").alias("evidence_id"), F.col("id").alias("transaction_id"))

    @cached_property
    def lines(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
        rows = self.table("lineitem").withColumn("line_index", F.row_number().over(order) - 1)
        goods = F.col("l_tax") != 0
        return rows.select(F.col("l_orderkey").alias("evidence_id"), "line_index", F.when(goods, F.col("l_partkey")).alias("item_id"), F.when(goods, "goods").otherwise("fee").alias("kind"), paise("l_extendedprice").alias("amount_paise"))

    @cached_property
    def items(self) -> DataFrame:
        return self.parts.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("label"), F.when(F.col("p_partkey") % 3 != 0, F.col("leaf")).alias("category_id"))

    @cached_property
    def printed(self) -> DataFrame:
        """A product name for each part as a seller may print it, with sizes, packs, containers and tariff codes."""
        size, k, cents = F.col("p_size").cast("string"), F.col("p_partkey"), (F.round(F.col("p_retailprice") * 100).cast("long") % 1000).cast("string")
        head, name = F.concat(size, F.lit(" g doses, ")), F.concat_ws(" ", F.initcap("p_name"), "p_brand")
        form = F.lit(0)
        for i, word in enumerate(("ring", "bolt", "gear", "anvil", "widget"), 1):
            form = F.when(F.col("p_name").contains(word), i).otherwise(form)
        more = {
            1: F.concat(F.lit(" (PET Bottle) "), size, F.lit(" ML")), 2: F.concat(F.lit(" Pack of "), size, F.lit(", "), cents, F.lit(".5kgs (HSN-22029990)")), 3: F.concat(F.lit(" Tetra Pak 4 x "), size, F.lit("g")),
            4: F.concat(F.lit(" combo of "), size, F.lit(" - "), cents, F.lit(" litres | B0ABCDEFG1 ( B0ABCDEFG1 )")), 5: F.concat(F.lit(" Refill "), size, F.lit(" tablets HSN: 04039090")),
        }
        tail = F.lit("")
        for i, words in more.items():
            tail = F.when(form == i, words).otherwise(tail)
        return self.table("part").select(k.alias("item_id"), F.concat(F.when(F.col("p_size") > 25, head).otherwise(""), name, tail).alias("name"))

    @cached_property
    def aliases(self) -> DataFrame:
        return self.parts.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("item_id"), F.lit("invoice").alias("source_type"), F.lit("sku").alias("alias_kind"), F.col("p_partkey").cast("string").alias("alias_value"))

    @cached_property
    def artifacts(self) -> DataFrame:
        """A stored document for each order with lines, and the record that was read from it; goods of even items print a SKU."""
        # Parts by the number of lines: what a task sorts does not grow with the table. Fee lines go by their part as well, so they do not meet in one task.
        k, rows = F.col("id"), self.table("lineitem")
        parts = max(self.spark.sparkContext.defaultParallelism, math.ceil(rows.count() / PART_LINES))
        goods = lambda r: r["l_tax"] != 0
        each = rows.select("l_orderkey", *LINE_ORDER).join(self.table("part").select("p_partkey", "p_name"), (F.col("l_partkey") == F.col("p_partkey")) & goods(rows), "left").repartition(parts, "l_orderkey")
        rows = each.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(paise("l_extendedprice")).alias("total"), F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "p_name"))).alias("all"))
        line = lambda r, i: F.struct(
            F.when(goods(r), r["p_name"]).otherwise("Delivery fee").alias("description"), F.when(goods(r) & (r["l_partkey"] % 2 == 0), r["l_partkey"].cast("string")).alias("sku"),
            F.when(goods(r), "goods").otherwise("fee").alias("kind"), (i % 3).cast("int").alias("qty"), F.round(r["l_extendedprice"] * 100).cast("long").alias("amount_paise"),
        )
        lines = F.transform("all", line)
        invoices = F.array(F.struct(F.lit("INV").alias("invoice_number"), F.col("total").alias("total_paise"), lines.alias("lines")))
        ref, day = F.concat(F.lit("ORD-"), k.cast("string")), F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int"))
        record = F.struct(ref.alias("external_ref"), day.alias("order_date"), F.col("total").alias("total_paise"), invoices.alias("invoices"))
        status = F.when(k % 5 == 0, "unsupported").when(k % 5 == 1, "failed").when(k % 5 == 2, "parsed").otherwise("staged")
        return rows.select(
            "id", day.cast("timestamp").alias("created_at"), F.when(k % 7 == 0, "image/png").otherwise("application/pdf").alias("mime"), F.lit("invoice").alias("source_type"), ref.alias("external_ref"),
            status.alias("parse_status"), F.when(k % 5 == 1, "timeout").alias("parse_error"), F.lit(None).cast("timestamp").alias("parsed_at"), F.when(k % 5 >= 2, record).alias("record"),
        )

    @cached_property
    def purchases(self) -> DataFrame:
        return self.table("events").where("event_type = 'purchase'").select("event_id", "user_id", "ts", paise("value").alias("value_paise"), F.concat(F.lit("w"), F.floor(F.hour("ts") / 4).cast("string")).alias("word"))

    @cached_property
    def source_map(self) -> DataFrame:
        """Words to categories; w3 is known to have none, w5 was never seen."""
        return self.spark.createDataFrame([("w0", 1), ("w1", 2), ("w2", 3), ("w3", None), ("w4", 4)], "source_category string, category_id long")

    @cached_property
    def consumption(self) -> DataFrame:
        rows = self.purchases.join(self.source_map, F.col("word") == F.col("source_category"))
        rows = rows.where("category_id is not null and value_paise <> 0")
        return rows.select(F.col("event_id").alias("id"), F.col("event_id").alias("evidence_id"), "category_id", (-F.col("value_paise")).alias("amount_paise"), F.to_date("ts").alias("consumed_on"), F.lit("evidence").alias("source"))

    @cached_property
    def jobs(self) -> DataFrame:
        k, at = F.col("event_id"), F.col("ts")
        state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "error", "failed").otherwise("done")
        took = F.make_dt_interval(secs=(k % 90).cast("decimal(18,6)"))
        rows = self.table("events").select(k.alias("id"), (k % 500).alias("artifact_id"), F.col("user_id").alias("batch_id"), state.alias("state"), (k % 4).cast("int").alias("attempts"), at.alias("created_at"), took.alias("took"))
        return rows.select(
            "id", "artifact_id", "batch_id", "state", "attempts", "created_at", F.when(F.col("state") == "running", F.col("created_at")).alias("claimed_at"),
            F.when(F.col("state").isin("done", "failed"), F.col("created_at") + F.col("took")).alias("finished_at"), F.when(F.col("state") == "failed", F.when(F.col("id") % 2 == 0, "timeout").otherwise("not_an_invoice")).alias("error_kind"),
        )
