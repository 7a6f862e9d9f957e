"""Filters over the ledger. Each definition that must be single lives here."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ID = 2**53 - 1


def explainable_spend() -> Column:
    """Neither opening balances nor transfers, typed or resolved; a missing status passes."""
    return (F.col("type") != "opening_balance") & (F.col("type") != "transfer") & ~F.col("transfer_status").eqNullSafe("resolved")


def open_leg() -> Column:
    """A leg that may still be paired: neither resolved nor rejected."""
    return ~F.col("transfer_status").eqNullSafe("resolved") & ~F.col("transfer_status").eqNullSafe("rejected")


def iso_date(text: str) -> datetime.date:
    """A real calendar date written YYYY-MM-DD, or ValueError."""
    date = datetime.date.fromisoformat(text)
    if date.isoformat() != text:
        raise ValueError(f"not a date: {text}")
    return date


def positive_id(value: object) -> int | None:
    """Digits only, over zero and within exact doubles; blank or repeated counts as absent."""
    if value is None or isinstance(value, (list, tuple)) or not str(value).strip():
        return None
    text = str(value).strip()
    if not text.isascii() or not text.isdigit() or not 0 < int(text) <= MAX_ID:
        raise ValueError(f"not an id: {value}")
    return int(text)


@dataclass(frozen=True)
class LedgerFilter:
    """What a listing or report may be narrowed to; None narrows nothing."""

    date_from: str | None = None
    date_to: str | None = None
    account_id: int | None = None
    category_id: int | None = None
    rule_id: int | None = None
    source: str | None = None
    search: str | None = None
    direction: str | None = None
    spend_only: bool = False
    ids: tuple[int, ...] | None = None
    limit: int = 100
    offset: int = 0

    def __post_init__(self):
        start, end = (iso_date(x) if x else None for x in (self.date_from, self.date_to))
        if start and end and start > end:
            raise ValueError("date_from is after date_to")
        if self.source not in (None, "user", "rule", "evidence", "unexplained"):
            raise ValueError("unknown source")
        if self.direction not in (None, "in", "out"):
            raise ValueError("unknown direction")
        if not 1 <= self.limit <= 500 or self.offset < 0:
            raise ValueError("limit must be 1 to 500 and offset not negative")

    def apply(self, txns: DataFrame, allocations: DataFrame, categories: DataFrame) -> DataFrame:
        out = txns
        if self.date_from:
            out = out.where(F.col("txn_date") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            out = out.where(F.col("txn_date") <= F.lit(self.date_to).cast("date"))
        if self.account_id is not None:
            out = out.where(F.col("account_id") == self.account_id)
        if self.ids is not None:
            out = out.where(F.col("id").isin(list(self.ids)))
        if self.spend_only:
            out = out.where(explainable_spend())
        if self.direction:
            out = out.where(F.col("amount_paise") > 0 if self.direction == "in" else F.col("amount_paise") < 0)
        if self.search:
            out = out.where(F.lower("narration").contains(self.search.lower()))
        if self.category_id is not None:
            out = with_category(out, allocations, categories, self.category_id)
        if self.rule_id is not None:
            out = with_allocation(out, allocations.where(F.col("rule_id") == self.rule_id))
        if self.source == "unexplained":
            out = unexplained(out, allocations)
        elif self.source:
            out = with_allocation(out, allocations.where(F.col("source") == self.source))
        return out


def with_allocation(txns: DataFrame, allocations: DataFrame) -> DataFrame:
    """Transactions that have one of the allocations."""
    return txns.join(allocations.select(F.col("transaction_id").alias("id")), "id", "left_semi")


def with_category(txns: DataFrame, allocations: DataFrame, categories: DataFrame, category_id: int) -> DataFrame:
    """Transactions with an allocation to the category or one of its children."""
    family = categories.where((F.col("id") == category_id) | (F.col("parent_id") == category_id)).select(F.col("id").alias("category_id"))
    return with_allocation(txns, allocations.join(F.broadcast(family), "category_id", "left_semi"))


def explained(allocations: DataFrame) -> DataFrame:
    """``transaction_id, explained``: summed before any join, so nothing fans out."""
    return allocations.groupBy("transaction_id").agg(F.sum("amount_paise").alias("explained"))


def with_explained(txns: DataFrame, allocations: DataFrame) -> DataFrame:
    sums = explained(allocations).withColumnRenamed("transaction_id", "id")
    return txns.join(sums, "id", "left").withColumn("explained", F.coalesce("explained", F.lit(0)))


def unexplained(txns: DataFrame, allocations: DataFrame) -> DataFrame:
    """Transactions whose allocations do not add up to the amount."""
    return with_explained(txns, allocations).where("amount_paise <> explained").drop("explained")


def unlinked(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence without a link to a transaction."""
    return evidence.join(links.select(F.col("evidence_id").alias("id")), "id", "left_anti")


def sibling_clash(categories: DataFrame, name: str, parent_id: int | None) -> DataFrame:
    """Categories under the same parent, or none, whose names differ only by case."""
    return categories.where(F.col("parent_id").eqNullSafe(F.lit(parent_id)) & (F.lower("name") == name.lower()))


def like_items(items: DataFrame, pattern: str) -> DataFrame:
    """Catalogue search; per cent signs and underscores in the pattern are wildcards."""
    return items.where(F.lower("label").like(f"%{pattern.lower()}%"))
