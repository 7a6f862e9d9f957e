"""Ordered changes to a ledger that are each applied once, and trees written level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.changes import ChangeSet, next_ids
from ledgerloom.session import checkpointed

APPLIED = "name string, place int, checksum string"


@dataclass(frozen=True)
class Step:
    """A named change: its text (what its checksum is taken of) and what it does to each table."""

    name: str
    text: str
    change: Callable[[dict[str, DataFrame]], dict[str, ChangeSet]]

    @property
    def checksum(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()


def no_steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], APPLIED)


def run_steps(tables: dict[str, DataFrame], applied: DataFrame, steps: list[Step], keys: dict[str, list[str]]) -> tuple[dict[str, DataFrame], DataFrame, dict[str, dict[str, ChangeSet]]]:
    """The tables after all steps that are not in ``applied`` (``name, place, checksum``), the new ``applied``, and each step's change sets.

    Steps run in their order, each on the tables as the ones before left them. A
    step that was applied with another text, one that is missing or out of order, and a name
    given twice are errors, and then nothing is changed. Tables are checkpointed after
    each step, so that lineage does not grow with the history.
    """
    names = [s.name for s in steps]
    if len(set(names)) < len(names):
        raise ValueError("step names must differ")
    known = {r.name: r for r in applied.collect()}
    for place, step in enumerate(steps[: len(known)]):
        if step.name not in known or known[step.name].place != place:
            raise ValueError(f"step {step.name!r} is out of order")
        if known[step.name].checksum != step.checksum:
            raise ValueError(f"step {step.name!r} was changed after it was applied")
    if len(known) > len(steps):
        raise ValueError(f"applied steps are missing: {sorted(set(known) - set(names))}")
    done, out = {}, dict(tables)
    for step in steps[len(known) :]:
        done[step.name] = step.change(out)
        for table, change in done[step.name].items():
            out[table] = checkpointed(change.commit(out[table], keys[table]))
    fresh = [(s.name, place, s.checksum) for place, s in enumerate(steps) if s.name in done]
    return out, applied.unionByName(applied.sparkSession.createDataFrame(fresh, APPLIED)), done


def insert_tree(nodes: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """New rows ``id, parent_id`` and the columns ``key`` for ``nodes`` that ``current`` lacks, parents before children.

    ``nodes``: ``key`` and ``parents``, the keys of the ancestors from the root (an array of
    structs like ``key``). A node is known by its parent and its own key; known
    nodes keep their ids and hand them to new children. Every level is one
    insert whose ids the next level takes. A parent that is in neither is an error.
    """
    own = F.struct(*key)
    every = nodes.select(*key, "parents").distinct().withColumn("level", F.size("parents"))
    deepest = every.agg(F.max("level")).first()[0]
    table, out = current.select("id", "parent_id", *key), current.select("id", "parent_id", *key).where("false")
    above = None  # path to id of the level before
    for level in range((deepest if deepest is not None else -1) + 1):
        rows = every.where(F.col("level") == level).withColumn("path", F.concat("parents", F.array(own)))
        if level == 0:
            rows = rows.withColumn("parent_id", F.lit(None).cast("long"))
        else:
            rows = rows.join(above.select(F.col("path").alias("parents"), F.col("id").alias("parent_id")), "parents", "left")
            if not rows.where("parent_id is null").isEmpty():
                raise ValueError(f"nodes of level {level} without their parent")
        found = table.select(F.col("id").alias("_id"), F.struct("parent_id", *key).alias("_k"))
        rows = checkpointed(rows.join(found, F.struct("parent_id", *key).eqNullSafe(F.col("_k")), "left"))
        fresh = rows.where("_id is null").select("parent_id", *key, "path")
        made = checkpointed(next_ids(table.select("id"), fresh, [F.col("path")])) if not fresh.isEmpty() else fresh.withColumn("id", F.lit(0).cast("long"))
        above = rows.where("_id is not null").select("path", F.col("_id").alias("id")).unionByName(made.select("path", "id"))
        added = made.select("id", "parent_id", *key)
        table, out = table.unionByName(added), out.unionByName(added)
    return out
