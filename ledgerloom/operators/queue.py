"""The document queue as table transitions; ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEASE_MINUTES, MAX_ATTEMPTS = 5, 3
#: Errors after which another attempt can succeed.
TRANSIENT = ("timeout", "unavailable", "out_of_memory")
OUTSTANDING = ("queued", "running")


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Artifacts to enqueue: those without an outstanding job, once each."""
    busy = jobs.where(F.col("state").isin(*OUTSTANDING)).select("artifact_id")
    return wanted.select("artifact_id").distinct().join(busy, "artifact_id", "left_anti")


def claim(jobs: DataFrame, batches: DataFrame, now: str, count: int = 1) -> DataFrame:
    """The oldest queued jobs of consented batches, claimed."""
    ready = jobs.where("state = 'queued'").join(batches.where("consented_at is not null").select("batch_id"), "batch_id", "left_semi")
    rows = ready.orderBy("created_at", "id").limit(count)
    return rows.select("id", "batch_id", (F.col("attempts") + 1).alias("attempts"), F.lit("running").alias("state"), at(now).alias("claimed_at"))


def heartbeat(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """``id, claimed_at``: running jobs whose lease the last of their beats (``id, at``) renews; late beats of others do nothing.

    A beat must come within the lease, and it never moves a lease backwards. ``streaming.leases`` does this on a stream.
    """
    last = jobs.where("state = 'running'").join(beats, "id").where((F.col("at") > F.col("claimed_at")) & (F.col("at") <= F.col("claimed_at") + F.expr(f"interval {LEASE_MINUTES} minutes")))
    return last.groupBy("id").agg(F.max("at").alias("claimed_at"))


def reclaim(jobs: DataFrame, now: str) -> DataFrame:
    """Running jobs whose lease has run out go back to the queue, or fail on their last attempt."""
    expired = jobs.where((F.col("state") == "running") & (F.col("claimed_at") < at(now) - F.expr(f"interval {LEASE_MINUTES} minutes")))
    return expired.select("id", F.when(F.col("attempts") < MAX_ATTEMPTS, "queued").otherwise("failed").alias("state"), "attempts")


def retry(jobs: DataFrame) -> DataFrame:
    """What becomes of failed jobs: requeued after a transient error while attempts are left."""
    again = F.col("error_kind").isin(*TRANSIENT) & (F.col("attempts") < MAX_ATTEMPTS)
    return jobs.where("state = 'failed'").select("id", F.when(again, "queued").otherwise("failed").alias("state"))


def settled(jobs: DataFrame) -> DataFrame:
    """Batches with nothing outstanding and when they ended."""
    busy = jobs.where(F.col("state").isin(*OUTSTANDING)).select("batch_id")
    return jobs.join(busy, "batch_id", "left_anti").groupBy("batch_id").agg(F.max("finished_at").alias("finished_at"), F.count("*").alias("jobs"))


def progress(jobs: DataFrame) -> DataFrame:
    """Jobs of each batch by state and the share that is over, in thousandths."""
    states = ("queued", "running", "done", "failed")
    rows = jobs.groupBy("batch_id").agg(F.count("*").alias("total"), *(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in states))
    return rows.withColumn("done_permille", F.expr("(done + failed) * 1000 div total"))


def active_batches(batches: DataFrame, jobs: DataFrame, now: str, limit: int = 10) -> DataFrame:
    """Batches that are unfinished, or finished within the hour, with their jobs by state; the newest first.

    ``batches``: batch_id, kind, total (as asked for, which may be under what was done), created_at, consented_at, finished_at.
    """
    shown = batches.where(F.col("finished_at").isNull() | (F.col("finished_at") > at(now) - F.expr("interval 1 hour"))).orderBy(F.desc("created_at"), "batch_id").limit(limit)
    states = ("queued", "running", "done", "failed")
    mine = jobs.join(shown.select("batch_id"), "batch_id", "left_semi").groupBy("batch_id").agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in states))
    rows = shown.join(mine, "batch_id", "left").fillna(0, states)
    return rows.select("batch_id", "kind", "total", *states, F.col("consented_at").isNotNull().alias("consented"), F.col("finished_at").isNotNull().alias("finished"), "created_at").orderBy(F.desc("created_at"), "batch_id")


def outlook(counts: DataFrame, median: Column) -> DataFrame:
    """``counts`` with ``remaining_seconds``, ``settled`` and ``fraction_done``.

    Without a median over 0 there is no rate, so no estimate. A batch is settled if nothing is outstanding, whatever
    its total says, and its fraction never passes 1.
    """
    outstanding, finished = F.col("queued") + F.col("running"), F.col("done") + F.col("failed")
    left = F.when(median > 0, F.when(outstanding == 0, F.lit(0)).otherwise(F.round(outstanding * median)).cast("long"))
    fraction = F.least(F.lit(1.0), finished / F.greatest(F.col("total"), finished, F.lit(1)))
    return counts.withColumns({"remaining_seconds": left, "settled": outstanding == 0, "fraction_done": fraction})


def median_seconds(jobs: DataFrame) -> DataFrame:
    """Exact median of how long finished jobs took, in whole seconds; none if not over 0."""
    took = F.unix_timestamp("finished_at") - F.unix_timestamp("created_at")
    return jobs.where("state = 'done'").agg(F.round(F.percentile(took, 0.5)).cast("long").alias("m")).select(F.when(F.col("m") > 0, F.col("m")).alias("median_seconds"))


def latest_failure(jobs: DataFrame) -> DataFrame:
    """The last failure of each artifact."""
    rows = jobs.where("state = 'failed'").groupBy("artifact_id").agg(F.max_by(F.struct("id", "error_kind", "finished_at"), F.struct("finished_at", "id")).alias("last"), F.count("*").alias("failures"))
    return rows.select("artifact_id", F.col("last.id").alias("job_id"), F.col("last.error_kind").alias("error_kind"), F.col("last.finished_at").alias("finished_at"), "failures")
