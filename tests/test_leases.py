import datetime
import random

import pytest

from ledgerloom.streaming import leases

START = datetime.datetime(2024, 1, 1)
MINUTE = 60_000


def plain(events):
    """All events of each job in order of time, and an instant after the last one."""
    out = []
    for job in {e[0] for e in events}:
        attempts, ends = 0, None
        for _, event, at in sorted((e for e in events if e[0] == job), key=lambda e: (e[2], e[1])) + [(job, "over", 10**9)]:
            if ends is not None and ends < at:
                out.append((job, "failed" if attempts == 3 else "queued", attempts, ends))
                attempts, ends = attempts % 3, None
            if event == "claimed" and ends is None:
                attempts, ends = attempts + 1, at + 5 * MINUTE
            if event == "heartbeat" and ends is not None:
                ends = at + 5 * MINUTE
            if event == "finished":
                attempts, ends = 0, None
    return sorted(out)


def run(spark, folder, batches):
    for n, batch in enumerate(batches):
        rows = [(job, event, START + datetime.timedelta(milliseconds=at)) for job, event, at in batch]
        spark.createDataFrame(rows, "job_id long, event string, at timestamp").coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema("job_id long, event string, at timestamp").parquet(f"{folder}/in/*")
        query = leases.ended(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    zero = int(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    got = spark.read.parquet(f"{folder}/out").selectExpr("job_id", "state", "attempts", f"unix_millis(ended_at) - {zero}").collect()
    return sorted(map(tuple, got))


@pytest.mark.parametrize("seed", [1, 2])
def test_leases_end_as_in_a_plain_loop(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(rng.randrange(8), rng.choices(["claimed", "heartbeat", "finished"], [5, 8, 1])[0], rng.randrange(120) * MINUTE // 2) for _ in range(150)]
    # shuffled by less than the delay, so that nothing is late
    events.sort(key=lambda e: e[2] + rng.random() * 4 * MINUTE)
    batches = [events[:70], events[70:], [(99, "finished", 10**8)]]
    assert run(spark, tmp_path, batches) == plain(events)


def test_late_and_missing_heartbeats(spark, tmp_path):
    first = [(1, "claimed", 0), (2, "claimed", 0), (2, "heartbeat", 4 * MINUTE), (3, "claimed", 0), (3, "finished", MINUTE), (None, "claimed", 0), (5, "claimed", 0), (5, "heartbeat", 5 * MINUTE), (9, "finished", 18 * MINUTE)]
    # the watermark stands at 8 minutes: the beat of job 1 is too late, and that of job 2 in time
    second = [(1, "heartbeat", 4 * MINUTE), (2, "heartbeat", int(8.5 * MINUTE)), (9, "finished", 100 * MINUTE)]
    got = run(spark, tmp_path, [first, second])
    assert got == [(1, "queued", 1, 5 * MINUTE), (2, "queued", 1, int(13.5 * MINUTE)), (5, "queued", 1, 10 * MINUTE)]
