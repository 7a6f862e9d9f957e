"""Bounded labelled samples for training classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import materialize


def least_hashed(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """At most ``most`` rows with the smallest 64-bit hashes in ``key``; ``total``: how many rows there are.

    Hashes spread evenly, so a cut at the share that should hold twice as many
    rows goes before the sort: however many tasks there are, they sort few rows.
    """
    cut = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * (2 * most + 1000) // max(1, total))
    return rows.where(F.col(key) <= cut).orderBy(key).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label, weight``: at most ``most_per_class`` documents of each class, chosen by hashed id.

    ``weight`` is how many labelled documents of its class a row stands for, so
    weighted shares of the classes are those of all labels, capped or not. The
    chosen ids are at most twice the cap, so they are sent to the tasks that read
    the documents. Null labels, labels other than 0 and 1 and null ids are left
    out; a document labelled twice keeps its largest label.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label"))
    known = materialize(known, "labels")
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    weights = [max(1.0, totals.get(k, 0) / most_per_class) for k in (0, 1)]
    keyed = known.select(F.col(id_col).alias("_id"), "label", F.xxhash64(id_col).alias("key"))
    parts = [least_hashed(keyed.where(F.col("label") == k), "key", most_per_class, totals.get(k, 0)).withColumn("weight", F.lit(weights[k])) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("_id", "label", "weight")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), "label", "weight")


def weighted(sample: DataFrame) -> DataFrame:
    """``sample`` as text, label, weight; every row weighs 1 if it has no weights."""
    return sample.select("text", "label", F.col("weight") if "weight" in sample.columns else F.lit(1.0).alias("weight"))
