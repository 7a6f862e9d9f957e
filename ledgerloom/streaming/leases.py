"""Leases of queued jobs on a stream: a claim starts one, a heartbeat renews it, its end gives the job back.

State is one small row and the events not yet settled, per job; timers of the state store end leases, so no table of
jobs is scanned. Events wait until the watermark passes them and are then taken in order of time, so the result is that
of all events in order, however batches cut them. Needs the RocksDB state store (``session`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.queue import LEASE_MINUTES, MAX_ATTEMPTS

ENDED = "job_id long, state string, attempts int, ended_ms long"


class _Lease(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "attempts int, ends long")
        self.waiting = handle.getListState("waiting", "at long, event string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(int(e.at_ms), e.event) for e in frame.itertuples()])
            for at in set(frame.at_ms):
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((int(at), event) for at, event in self.waiting.get())
        due, later = [w for w in waiting if w[0] <= now], [w for w in waiting if w[0] > now]
        attempts, ends = self.lease.get() if self.lease.exists() else (0, None)
        out, before = [], ends

        def end() -> None:
            nonlocal attempts, ends
            lost = attempts >= MAX_ATTEMPTS
            out.append((key[0], "failed" if lost else "queued", attempts, ends))
            attempts, ends = 0 if lost else attempts, None

        for at, event in due:
            if ends is not None and ends < at:
                end()
            if event == "claimed" and ends is None:
                attempts, ends = attempts + 1, at + LEASE_MINUTES * 60_000
            elif event == "heartbeat" and ends is not None:
                ends = at + LEASE_MINUTES * 60_000
            elif event == "finished":
                attempts, ends = 0, None
        if ends is not None and ends <= now:
            end()
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if attempts:
            self.lease.update((attempts, ends))
        else:
            self.lease.clear()
        if ends is not None and ends != before:
            self.handle.registerTimer(ends)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "state", "attempts", "ended_ms"])

    def close(self) -> None:
        pass


def ended(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``job_id, state, attempts, ended_at`` of leases that ran out: ``queued`` again, or ``failed`` on the last attempt.

    ``events``: a stream of job_id, event (claimed, heartbeat, finished) and at. Events at one instant come in the order
    claimed, finished, heartbeat. A claim of a leased job and a heartbeat of a job without a lease do nothing; an event at the
    very end of a lease is in time; ``finished`` forgets the job, and so does failing. Events later than ``delay`` are dropped, and rows
    with a null in any of the three pass nothing.
    """
    rows = events.where("job_id is not null and event is not null and at is not null").withWatermark("at", delay)
    rows = rows.select("job_id", "event", F.unix_millis("at").alias("at_ms"), "at")
    out = rows.groupBy("job_id").transformWithStateInPandas(_Lease(), ENDED, "Append", "EventTime")
    return out.select("job_id", "state", "attempts", F.timestamp_millis("ended_ms").alias("ended_at"))
