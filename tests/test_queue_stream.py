"""Leases, fenced results and idempotent requests in streams: against batch, against a plain fold, and after a crash."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import jobs
from auditlake.plans import ledger
from auditlake.sources.tables import read
from auditlake.streaming import queue
from auditlake.streaming.events import source

SF = "/root/testdata/sf0.001"
MINUTE = 60_000_000
DAWN = 28_000_000 * MINUTE  # the log's minute 0; a stream's watermark begins at 1970
MESSAGE = "job_id long, at long, kind string, state string, attempts long, lease_until long, error string"


@pytest.fixture(scope="module")
def events(spark):
    return read(spark, SF, "events")


def files(events, folder, n):
    """The log in n files, in order of time."""
    rows = events.toPandas().sort_values(["ts", "event_id"], kind="stable")
    size = -(-len(rows) // n)
    for i in range(n):
        events.sparkSession.createDataFrame(rows.iloc[i * size : (i + 1) * size], events.schema).coalesce(1).write.mode("append").parquet(folder)


def one_by_one(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stream_of(spark, rows, folder):
    """Messages, one list for each micro-batch."""
    for batch in rows:
        spark.createDataFrame(batch, MESSAGE).withColumns({"at": F.col("at") + DAWN, "lease_until": F.col("lease_until") + DAWN}).withColumn("ts", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(folder)
    return one_by_one(spark, folder, spark.read.parquet(folder).schema)


def job(i, at, state="QUEUED", attempts=0, lease=None):
    return (i, at, "job", state, attempts, lease, None)


def result(i, at, attempt, error=None):
    return (i, at, "result", None, attempt, None, error)


def steps(rows):
    return sorted(map(str, ((r.job_id, (r.at - DAWN) // MINUTE, r.new_state, r.error, r.new_attempts) for r in rows.collect())))


def test_leases(spark, tmp_path):
    hold = queue.HOLD // MINUTE
    batches = [
        [job(i, 0) for i in (1, 2, 3, 4)] + [job(5, 0, attempts=2), job(6, 0, "RUNNING", 1, 3 * MINUTE), job(7, 0, "SUCCEEDED", 1)],
        [result(1, MINUTE, 1), result(2, 2 * MINUTE, 1, "TIMEOUT"), job(1, MINUTE), result(7, MINUTE, 1), result(99, MINUTE, 1)],
        [result(3, (hold + 1) * MINUTE, 1), result(3, (hold + 2) * MINUTE, 2)],  # the lease of the first attempt is over
        [job(8, 30 * MINUTE)],
    ]
    want = [
        (1, 0, "RUNNING", None, 1), (1, 1, "SUCCEEDED", None, 1), (2, 0, "RUNNING", None, 1), (2, 2, "FAILED", "TIMEOUT", 1),
        (3, 0, "RUNNING", None, 1), (3, hold, "RUNNING", None, 2), (3, hold + 1, None, "STALE", 1), (3, hold + 2, "SUCCEEDED", None, 2),
        (4, 0, "RUNNING", None, 1), (4, hold, "RUNNING", None, 2), (4, 2 * hold, "FAILED", "INTERRUPTED", 2),
        (5, 0, "FAILED", "INTERRUPTED", 2), (6, 3, "RUNNING", None, 2), (6, 3 + hold, "FAILED", "INTERRUPTED", 2),
        (7, 1, None, "STALE", 1), (8, 30, "RUNNING", None, 1), (99, 1, None, "STALE", 1),
    ]
    got = queue.replayed(queue.leases(stream_of(spark, batches, str(tmp_path)), "0 seconds"), "leases")
    assert steps(got) == sorted(map(str, want))


def test_leases_do_not_depend_on_batches(spark, tmp_path):
    """Random jobs and results in one batch and in seven give the same rows, those of a plain fold."""
    random.seed(5)
    log, hold = [], queue.HOLD
    for i in range(60):
        at = random.randrange(0, 40 * MINUTE)
        log.append(random.choice([job(i, at), job(i, at, attempts=random.randrange(3)), job(i, at, "RUNNING", 1, at + random.randrange(hold)), job(i, at, "FAILED", 1)]))
        log += [result(i, at + random.randrange(1, 3 * hold), random.randrange(1, 3), random.choice([None, "TIMEOUT"])) for _ in range(random.randrange(3))]
    log.append(job(-1, 10**11 // 4))  # all leases end before it, nothing is forgotten yet
    log.sort(key=lambda m: m[1])
    want = []
    for i in {m[0] for m in log}:
        state, attempts, lease = None, 0, None
        for _, at, kind, to, n, until, error in [m for m in log if m[0] == i] + [(i, 10**11 // 4, "end", None, None, None, None)]:
            while state == "RUNNING" and lease < at:
                if attempts == 2:
                    state = "FAILED"
                    want.append((i, lease, "FAILED", "INTERRUPTED", 2))
                else:
                    attempts += 1
                    want.append((i, lease, "RUNNING", None, attempts))
                    lease += hold
            if kind == "job":
                state, attempts, lease = to, n, until
                if to == "QUEUED":
                    state, attempts, lease = ("FAILED", n, None) if n >= 2 else ("RUNNING", n + 1, at + hold)
                    want.append((i, at, state, "INTERRUPTED" if n >= 2 else None, attempts))
            elif kind == "result":
                fresh = state == "RUNNING" and attempts == n
                state = ("FAILED" if error else "SUCCEEDED") if fresh else state
                want.append((i, at, state if fresh else None, error if fresh else "STALE", n))
    size = -(-len(log) // 7)
    for name, batches in (("one", [log]), ("seven", [log[k : k + size] for k in range(0, len(log), size)])):
        rows = queue.replayed(queue.leases(stream_of(spark, batches, str(tmp_path / name)), "0 seconds"), "leases").collect()
        assert sorted(str((r.job_id, r.at - DAWN, r.new_state, r.error, r.new_attempts)) for r in rows) == sorted(map(str, want)), name


def test_first_claims_are_those_of_the_batch(events):
    spark = events.sparkSession
    first = ledger.QUERIES["queue_claims_stream"](spark, SF)
    batch = jobs.claims(jobs.jobs(events)).select("job_id", "new_state", "error", "new_attempts")
    assert sorted(map(str, first.collect())) == sorted(map(str, batch.collect())) and first.count() > 0


def test_fencing(spark, events, tmp_path):
    want = jobs.fenced_results(events)
    rows = want.select("event_id", "user_id", "revision")
    files(rows.join(events.select("event_id", "ts"), "event_id"), str(tmp_path / "in"), 3)
    current = want.select("user_id", "current").distinct()
    stream = one_by_one(spark, str(tmp_path / "in"), "event_id long, user_id long, revision long")
    queue.judged(stream, queue.fence(lambda: current), queue.FENCED, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = queue.outcomes(spark, str(tmp_path / "out"), queue.FENCED).select("event_id", "user_id", "revision", "current", "accepted")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("not accepted").count() and got.filter("accepted").count()


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_crash_changes_nothing(spark, events, tmp_path, when):
    """The stream dies in its second batch, before or after the batch is written, and goes on from its checkpoint."""
    files(events, str(tmp_path / "in"), 3)
    out, cp, calls = str(tmp_path / "out"), str(tmp_path / "cp"), []

    def dying(batch, past):
        calls.append(1)
        if len(calls) == 2:
            if when == "after":
                queue.ingest(batch, past).write.mode("overwrite").partitionBy("accepted").parquet(f"{out}/batch=1")
            raise RuntimeError("killed")
        return queue.ingest(batch, past)

    run = lambda judge: queue.judged(one_by_one(spark, str(tmp_path / "in"), events.schema), judge, queue.INGESTED, out, cp)
    with pytest.raises(Exception, match="killed"):
        run(dying).awaitTermination()
    assert queue.outcomes(spark, out, queue.INGESTED).select("batch").distinct().count() == (1 if when == "before" else 2)
    run(queue.ingest).awaitTermination()
    got = queue.outcomes(spark, out, queue.INGESTED)
    want = jobs.idempotent(events).select("event_id", "fingerprint", "first_id", "state")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.filter("accepted <> (state = 'ACCEPTED')").count() == 0 and {r.state for r in got.collect()} == {"ACCEPTED", "CONFLICT"} | {r.state for r in want.collect()}


def test_a_request_delivered_again_is_a_replay(spark, events, tmp_path):
    some = events.limit(40).union(events.limit(10))
    for k in range(2):
        some.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = one_by_one(spark, str(tmp_path / "in"), events.schema)
    queue.judged(stream, queue.ingest, queue.INGESTED, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = queue.outcomes(spark, str(tmp_path / "out"), queue.INGESTED)
    accepted = got.filter("accepted")
    assert got.count() == 100 and accepted.select("event_id").distinct().count() == accepted.count() == jobs.idempotent(events.limit(40)).filter("state = 'ACCEPTED'").count()
