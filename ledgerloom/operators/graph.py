"""Groups of things that are joined in pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``pairs``; nulls are left out.

    Every round each node takes the smallest label among its neighbours' and then
    that label's own label, so paths shorten by halves. A node's neighbours meet
    in a minimum, which is combined before the shuffle; labels are checkpointed each round.
    A checkpoint's size is guessed too small, so joins with labels are kept from going through the driver.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = checkpointed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label").hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = checkpointed(step.join(jump.hint("merge"), "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if moved.where("label <> old").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")
