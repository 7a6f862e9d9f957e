"""Writes as explicit change sets: idempotent appends, merges and scoped replacement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed


@dataclass(frozen=True)
class ChangeSet:
    """Rows to remove and rows to add. A dry run is one that nobody commits."""

    inserts: DataFrame
    deletes: DataFrame

    def counters(self) -> DataFrame:
        """``created, removed`` as one row."""
        parts = [df.select(F.lit(int(k == 0)).alias("c"), F.lit(int(k == 1)).alias("r")) for k, df in enumerate((self.inserts, self.deletes))]
        return parts[0].unionByName(parts[1]).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("created"), F.coalesce(F.sum("r"), F.lit(0)).alias("removed"))

    def commit(self, current: DataFrame, key: list[str]) -> DataFrame:
        """``current`` after the change."""
        return current.join(self.deletes.select(*key), key, "left_anti").unionByName(self.inserts)


def _apart(rows: DataFrame, value: list[str], side: str) -> DataFrame:
    """Rows with all of ``value`` as one key, and a number that tells equal ones apart."""
    keyed = rows.withColumn(f"_{side}", F.struct(*value))
    return keyed.withColumn(f"_{side}_n", F.row_number().over(Window.partitionBy(f"_{side}").orderBy("id")))


def net(change: ChangeSet, value: list[str]) -> ChangeSet:
    """``change`` without what it takes away and brings back alike in all columns ``value``, once for once; nulls are alike."""
    came, went = _apart(change.inserts, value, "in"), _apart(change.deletes, value, "out")
    alike = lambda: F.col("_in").eqNullSafe(F.col("_out")) & (F.col("_in_n") == F.col("_out_n"))
    inserts = came.join(went.select("_out", "_out_n"), alike(), "left_anti").select(*change.inserts.columns)
    deletes = went.join(came.select("_in", "_in_n"), alike(), "left_anti").select(*change.deletes.columns)
    return ChangeSet(inserts, deletes)


def compose(first: ChangeSet, second: ChangeSet, value: list[str]) -> ChangeSet:
    """One change set with the effect of ``first`` and then ``second``, netted over the columns ``value``."""
    return net(ChangeSet(first.inserts.unionByName(second.inserts), first.deletes.unionByName(second.deletes)), value)


def append_new(current: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows to insert: those whose key is new, the first in ``order`` of each key."""
    first = Window.partitionBy(key).orderBy(*order)
    return incoming.join(current.select(key), key, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*incoming.columns)


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``current`` merged with ``incoming``: incoming wins, its last row in ``order`` of each key."""
    last = Window.partitionBy(*key).orderBy(*(c for c in order))
    fresh = incoming.withColumn("_n", F.row_number().over(last)).withColumn("_of", F.count("*").over(Window.partitionBy(*key))).where("_n = _of").drop("_n", "_of")
    return current.join(fresh.select(*key), key, "left_anti").select(*current.columns).unionByName(fresh)


def replace_scope(current: DataFrame, scope: DataFrame, on: list[str], fresh: DataFrame) -> DataFrame:
    """``current`` with the rows of ``scope`` replaced by ``fresh``."""
    return current.join(scope.select(*on).distinct(), on, "left_anti").select(*current.columns).unionByName(fresh)


def next_ids(current: DataFrame, fresh: DataFrame, order: list[Column], id_col: str = "id") -> DataFrame:
    """``fresh`` with ids after the largest of ``current``, in ``order``.

    Numbers go in two levels, so that they need no single sorted partition: rows
    are range-partitioned, counted by partition and numbered within it. The
    partitioned rows are checkpointed, since both steps must see the same ones.
    """
    spark = fresh.sparkSession
    top = current.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(fresh.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    before, run = {}, top
    for part in sorted(sizes):
        before[part], run = run, run + sizes[part]
    starts = spark.createDataFrame(sorted(before.items()), "_part int, _start long")
    within = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(F.broadcast(starts), "_part").withColumn(id_col, F.col("_start") + F.row_number().over(within)).drop("_part", "_start")


def violations(transactions: DataFrame, allocations: DataFrame, categories: DataFrame) -> DataFrame:
    """``assertion, broken``: how many rows break each invariant of the schema."""
    over = allocations.groupBy("transaction_id").agg(F.sum(F.abs("amount_paise")).alias("s")).join(transactions.select(F.col("id").alias("transaction_id"), "amount_paise"), "transaction_id")
    checks = {
        "allocation_without_transaction": allocations.join(transactions.select(F.col("id").alias("transaction_id")), "transaction_id", "left_anti"),
        "allocation_without_category": allocations.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti"),
        "allocation_of_nothing": allocations.where("amount_paise = 0"),
        "rule_without_rule_id": allocations.where("(source = 'rule') <> (rule_id is not null)"),
        "confirmed_but_not_user": allocations.where("confirmed_from_rule_id is not null and source <> 'user'"),
        "over_allocated": over.where(F.col("s") > F.abs("amount_paise")),
        "repeated_transaction": transactions.groupBy("id").count().where("count > 1"),
        "three_levels": categories.where("parent_id is not null").join(categories.where("parent_id is not null").select(F.col("id").alias("parent_id")), "parent_id", "left_semi"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("broken")).select(F.lit(name).alias("assertion"), "broken")
        out = one if out is None else out.unionByName(one)
    return out
