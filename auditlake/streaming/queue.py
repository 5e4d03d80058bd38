"""The job queue, fenced results and idempotent requests as Structured Streaming, with batches that may be run again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from auditlake.operators.jobs import ATTEMPTS, KEY, LEASE, jobs, requests
from auditlake.sources.tables import new_folder

#: Microseconds of a lease, and for which a finished job is remembered, so that late results are still refused.
HOLD, KEEP = LEASE * 1_000_000, 86_400_000_000
#: Most jobs whose states are kept together; any number gives the same rows.
BLOCK = 256
STEPS = "job_id long, at long, new_state string, error string, new_attempts long, new_lease long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases(StatefulProcessor):
    """The jobs of a block of BLOCK successive numbers: a claim when one is queued, another whenever its lease ends, and the result of the attempt that holds it.

    A job's state is (state, attempts, deadline): the deadline of a running job is the end of its lease, that of a
    finished one the time when it is forgotten. A block's states are read and written together, and one timer of event
    time stands for its earliest deadline, so calls grow with blocks and not with jobs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", "job_id long, state string, attempts long, deadline long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        jobs, due = self._held()
        out = []
        for m in sorted(rows, key=lambda m: (m.job_id, m.at, m.kind)):  # a job's own messages of one batch
            job, steps = _until(jobs.get(m.job_id), m.at)
            if m.kind == "result":
                job, step = _result(job, m)
            elif job is not None:
                step = None  # sent again
            elif m.state == "QUEUED":
                job, step = _claim(m.attempts, m.at)
            else:
                job, step = (m.state, m.attempts, m.lease_until if m.state == "RUNNING" else m.at + KEEP), None
            out += [Row(job_id=m.job_id, **s) for s in (*steps, *([step] if step else []))]
            jobs[m.job_id] = job
        self._store(jobs, due)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        jobs, _ = self._held()
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        for number, job in jobs.items():
            jobs[number], steps = _until(job, now)
            out += [Row(job_id=number, **s) for s in steps]
        self._store(jobs, None)  # the timer that fired is gone
        return iter(out)

    def _held(self) -> tuple[dict, int | None]:
        """States by job, and the earliest deadline."""
        jobs = {j[0]: tuple(j)[1:] for j in self.jobs.get()}
        return jobs, min((job[2] for job in jobs.values()), default=None)

    def _store(self, jobs: dict, due: int | None) -> None:
        held = [(number, *job) for number, job in jobs.items() if job is not None]
        first = min((j[3] for j in held), default=None)
        if due is not None and first != due:
            self.handle.deleteTimer(due // 1000 + 1)
        if held:
            self.jobs.put(held)
        else:
            self.jobs.clear()
        if first is not None and first != due:
            self.handle.registerTimer(first // 1000 + 1)

    def close(self) -> None:
        pass


def _step(at, state, error, attempts, lease=None) -> dict:
    return {"at": at, "new_state": state, "error": error, "new_attempts": attempts, "new_lease": lease}


def _claim(attempts: int, at: int) -> tuple[tuple, dict]:
    """A job taken by a worker: it runs once more, or has failed if its attempts are spent."""
    if attempts >= ATTEMPTS:
        return ("FAILED", attempts, at + KEEP), _step(at, "FAILED", "INTERRUPTED", attempts)
    return ("RUNNING", attempts + 1, at + HOLD), _step(at, "RUNNING", None, attempts + 1, at + HOLD)


def _until(job: tuple | None, time: int) -> tuple[tuple | None, list[dict]]:
    """The job at a time, and the claims of leases that ended before it; None once it is forgotten."""
    steps = []
    while job is not None and job[2] < time:
        if job[0] == "RUNNING":
            job, step = _claim(job[1], job[2])
            steps.append(step)
        else:
            job = None
    return job, steps


def _result(job: tuple | None, m: Row) -> tuple[tuple | None, dict]:
    """A result counts if its attempt still holds the job; else it is stale and changes nothing."""
    if job is None or job[0] != "RUNNING" or job[1] != m.attempts:
        return job, _step(m.at, None, "STALE", m.attempts)
    state = "FAILED" if m.error else "SUCCEEDED"
    return (state, m.attempts, m.at + KEEP), _step(m.at, state, m.error, m.attempts)


def messages(events: DataFrame) -> DataFrame:
    """The jobs of an event log as messages of kind job; a result names its job, attempt, time and error."""
    rows = jobs(events).select("job_id", F.col("created").alias("at"), F.lit("job").alias("kind"), "state", "attempts", "lease_until", F.lit(None).cast("string").alias("error"))
    return rows.withColumn("ts", F.timestamp_micros("at"))


def leases(stream: DataFrame, late: str) -> DataFrame:
    """Every claim, end and refused result of the jobs of a stream of messages, as they happen.

    A lease that ended shows when the watermark has passed it by a millisecond. Messages up to `late` behind the latest
    are still taken; within a batch they are put in order. Messages without a job or a time belong to no job and are left out.
    """
    rows = stream.filter("job_id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.withColumn("block", F.col("job_id") - F.pmod("job_id", F.lit(BLOCK)))
    return rows.groupBy("block").transformWithState(Leases(), STEPS, "Append", "EventTime")


def replayed(rows: DataFrame, name: str) -> DataFrame:
    """All rows that a stream yields from what its source holds now, as a table."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, name)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # needed by state with timers
    try:
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    finally:
        if held is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


Judge = Callable[[DataFrame, DataFrame], DataFrame]


def outcomes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What `judged` wrote: the columns of schema, `accepted` and the number of the batch."""
    return spark.read.schema(f"{schema}, batch long, accepted boolean").parquet(folder)


def judged(stream: DataFrame, judge: Judge, schema: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Accepted and refused rows of a stream, apart in two partitions of each batch's folder.

    `judge` gets a batch and what batches before it accepted, and gives the columns of schema and `accepted`. A batch is
    one write over a folder of its own and reads earlier batches only, so one that is run again after a crash writes
    the same once more.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], f"{schema}, accepted boolean").write.mode("ignore").partitionBy("accepted").parquet(f"{folder}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        past = outcomes(batch.sparkSession, folder, schema).filter((F.col("batch") < number) & F.col("accepted"))
        judge(batch, past).write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FENCED = "event_id long, user_id long, revision long, current long"
INGESTED = "event_id long, user_id long, event_type string, day date, fingerprint string, first_id long, state string"


def fence(current: Callable[[], DataFrame]) -> Judge:
    """Results (event_id, user_id, revision) against the revision that holds now, read anew for each batch; without one a result is refused."""

    def judge(batch: DataFrame, past: DataFrame) -> DataFrame:
        rows = batch.join(current(), "user_id", "left")
        return rows.select("event_id", "user_id", "revision", "current", F.coalesce(F.col("revision") == F.col("current"), F.lit(False)).alias("accepted"))

    return judge


def ingest(batch: DataFrame, past: DataFrame) -> DataFrame:
    """Requests by user, kind and day: the first ever is accepted; later ones are replays if their fingerprint is its, else conflicts.

    A request that is delivered again, in the same batch or later, is a replay.
    """
    copy = F.row_number().over(Window.partitionBy("event_id").orderBy("at"))
    rows, keys = requests(batch).withColumn("copy", copy), [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in KEY]
    new = rows.groupBy(*KEY).agg(F.min_by(F.struct("event_id", "fingerprint"), F.struct("at", "event_id")).alias("f")).select(*KEY, "f.*", F.lit(True).alias("new"))
    first = new.unionByName(past.select(*KEY, "event_id", "fingerprint", F.lit(False).alias("new")))
    first = first.groupBy(*KEY).agg(F.min_by(F.struct("event_id", "fingerprint", "new"), "new").alias("g")).select(*KEY, "g.*")
    both = rows.alias("r").join(first.alias("f"), keys[0] & keys[1] & keys[2])
    accepted = F.col("f.new") & (F.col("r.copy") == 1) & (F.col("r.event_id") == F.col("f.event_id"))
    state = F.when(accepted, "ACCEPTED").when(F.col("r.fingerprint") == F.col("f.fingerprint"), "REPLAYED").otherwise("CONFLICT")
    return both.select("r.event_id", *[f"r.{k}" for k in KEY], "r.fingerprint", F.col("f.event_id").alias("first_id"), state.alias("state"), accepted.alias("accepted"))
