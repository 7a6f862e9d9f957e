"""Connected components by alternating large-star and small-star steps.

Nothing is gathered on the driver except one counter per round. A hub node's
neighbours are never collected: both steps take only a minimum per node, which
Spark combines before the shuffle, and then join it back, where adaptive
execution splits a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import discard, materialize

#: The steps halve the depth of every tree, so this is reached by no real input.
MAX_ROUNDS = 64


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``node, component`` for every node that has an edge.

    ``component`` is the smallest node reachable. Self loops, repeated and
    reversed edges are allowed; nulls are dropped; no edges give no rows.
    """
    pairs = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, pairs = pairs, materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "star")
        discard(last)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
