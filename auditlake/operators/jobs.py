"""Extraction jobs and inboxes from event logs: leases, attempts, stale results, replays, latest rows, validity in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.events import in_order, micros
from auditlake.sources.tables import written

#: Seconds of a lease and attempts of a job.
LEASE, ATTEMPTS = 360, 2
STATES = {"signup": "QUEUED", "click": "RUNNING", "purchase": "SUCCEEDED", "error": "FAILED", "view": "QUEUED"}


def jobs(events: DataFrame) -> DataFrame:
    """(job_id, owner, state, attempts, created, lease_until, finished) with times in microseconds; each event is a job."""
    state = F.element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), F.col("event_type"))
    at = micros("ts")
    rows = events.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("owner"), state.alias("state"), (F.col("event_id") % 3).alias("attempts"), at.alias("created"))
    lease = F.when(F.col("state") == "RUNNING", F.col("created") + LEASE * 1_000_000)
    done = F.when(F.col("state").isin("SUCCEEDED", "FAILED") & (F.col("job_id") % 11 != 0), F.col("created") + 1_000_000)
    return rows.withColumns({"lease_until": lease, "finished": done})


def claims(table: DataFrame, now: int | None = None) -> DataFrame:
    """Jobs that a worker may claim at a time, oldest first within their hour, and what the claim makes of each.

    A job is open if it is queued or its lease is over; one with ATTEMPTS attempts fails instead of running again.
    Without a time, the last one of the table is now. Places count within the hour of creation, so that no task sorts all.
    """
    table = table.withColumn("now", F.lit(table.agg(F.max("created")).first()[0] if now is None else now).cast("long"))
    rows = table.filter((F.col("state") == "QUEUED") | ((F.col("state") == "RUNNING") & (F.col("lease_until") < F.col("now"))))
    spent = F.col("attempts") >= ATTEMPTS
    hour = F.floor(F.col("created") / F.lit(3_600_000_000)).cast("long")
    place = F.row_number().over(Window.partitionBy("hour").orderBy("created", "job_id")).cast("long")
    rows = rows.withColumn("hour", hour).withColumn("place", place)
    return rows.select(
        "job_id", "hour", "place", F.when(spent, "FAILED").otherwise("RUNNING").alias("new_state"), F.when(spent, "INTERRUPTED").alias("error"),
        (F.col("attempts") + F.when(spent, 0).otherwise(1)).alias("new_attempts"), F.when(~spent, F.col("now") + LEASE * 1_000_000).alias("new_lease"),
    )


def next_job(table: DataFrame, now: int | None = None) -> DataFrame:
    """The one job that is claimed next."""
    return claims(table, now).orderBy("hour", "place").limit(1).select("job_id", "new_state", "new_attempts")


def latest_success(table: DataFrame) -> DataFrame:
    """Each owner's latest successful job: one without an end time is the latest, then the later end, then the larger id."""
    order = F.struct(F.col("finished").isNull().alias("open"), "finished", "job_id")
    return table.filter("state = 'SUCCEEDED'").groupBy("owner").agg(F.max_by(F.struct("job_id", "finished"), order).alias("j")).select("owner", "j.job_id", "j.finished")


def latest_decision(events: DataFrame) -> DataFrame:
    """Each user's latest purchase or error whose properties hold a positive number k."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    rows = events.filter(F.col("event_type").isin("purchase", "error")).withColumn("k", k).filter("k > 0")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "k"), F.struct(micros("ts"), "event_id")).alias("e")).select("user_id", "e.event_id", "e.event_type", "e.k")


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    """Events with at and owner (the user as text, empty for none), sorted by owner and time and cut into parts by sampled ranges, so that a user with many is in several tasks."""
    owner = F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("owner")
    return written(in_order(rows.select(owner, "user_id", micros("ts").alias("at"), "event_id", *more), "owner", "at", "event_id"), "ordered")


def _in_part():
    """Rows of a user in a part, in order."""
    return Window.partitionBy("owner", "part").orderBy("at", "event_id")


def _so_far():
    return _in_part().rowsBetween(Window.unboundedPreceding, 0)


def _earlier():
    """A user's parts before one."""
    return Window.partitionBy("owner").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def fenced_results(events: DataFrame) -> DataFrame:
    """Results (purchases) with the revision (signups so far) that they were made for, and whether it is still the current one."""
    rows = _ordered(events.withColumn("new", (F.col("event_type") == "signup").cast("long")), "event_type", "new")
    parts = rows.groupBy("owner", "part").agg(F.sum("new").alias("n"))
    parts = parts.withColumns({"before": F.coalesce(F.sum("n").over(_earlier()), F.lit(0)), "current": F.sum("n").over(Window.partitionBy("owner"))}).drop("n")
    rows = rows.withColumn("inside", F.sum("new").over(_so_far())).filter("event_type = 'purchase'").join(parts, ["owner", "part"])
    revision = F.col("before") + F.col("inside")
    return rows.select("event_id", "user_id", revision.alias("revision"), "current", (revision == F.col("current")).alias("accepted"))


KEY = ["user_id", "event_type", "day"]


def requests(events: DataFrame) -> DataFrame:
    """Events as requests with their key, time and fingerprint."""
    print_ = F.sha2(F.concat_ws("|", F.lit("value"), F.format_string("%.2f", F.col("value"))), 256)
    return events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), micros("ts").alias("at"), print_.alias("fingerprint"))


def idempotent(events: DataFrame) -> DataFrame:
    """Requests by user, kind and day: the first is accepted, a later one with the same fingerprint is a replay, any other a conflict."""
    rows = requests(events)
    first = rows.groupBy(*KEY).agg(F.min_by(F.struct("event_id", "fingerprint"), F.struct("at", "event_id")).alias("f"))
    state = F.when(F.col("event_id") == F.col("f.event_id"), "ACCEPTED").when(F.col("fingerprint") == F.col("f.fingerprint"), "REPLAYED").otherwise("CONFLICT")
    return rows.join(first, KEY).select("event_id", "fingerprint", F.col("f.event_id").alias("first_id"), state.alias("state"))


def active_admission(table: DataFrame, most: int) -> DataFrame:
    """Whether an owner may start a job: fewer than `most` are queued or running."""
    active = F.count_if(F.col("state").isin("QUEUED", "RUNNING"))
    return table.groupBy("owner").agg(active.alias("active")).select("owner", "active", (F.col("active") < most).alias("admitted"))


def inbox(events: DataFrame, recipient: int) -> DataFrame:
    """One recipient's notifications, latest first; those with an even number are read."""
    rows = events.filter(F.col("user_id") == recipient)
    return rows.select("event_id", "event_type", (F.col("event_id") % 2 == 0).alias("read")).orderBy(F.col("event_id").desc())


def inbox_counts(events: DataFrame, unread_only: bool = False) -> DataFrame:
    """Notifications and unread ones of each recipient."""
    rows = events.filter("event_id % 2 <> 0") if unread_only else events
    return rows.groupBy(F.col("user_id").alias("recipient")).agg(F.count("*").alias("total"), F.count_if(F.col("event_id") % 2 != 0).alias("unread"))


def limit_history(events: DataFrame) -> DataFrame:
    """Each user's limit (the value of purchases, to cents) with the time from which it holds and the time when the next one does."""
    rows = _ordered(events.filter("event_type = 'purchase'").withColumn("amount", F.col("value").cast("decimal(22,2)")), "amount")
    begins = rows.groupBy("owner", "part").agg(F.min("at").alias("begin"))
    parts = begins.withColumn("next_part", F.lead("begin").over(Window.partitionBy("owner").orderBy("part"))).drop("begin")
    rows = rows.withColumn("next_row", F.lead("at").over(_in_part())).join(parts, ["owner", "part"])
    return rows.select("user_id", "event_id", "amount", F.col("at").alias("valid_from"), F.coalesce("next_row", "next_part").alias("valid_to"))


def authority_as_of(events: DataFrame) -> DataFrame:
    """Decisions (views, of their value to cents) with the limit that their user had then, and whether it covers them.

    The limit is that of the user's last purchase before the decision, by time and then event_id; without one nothing is
    covered. Limits and decisions are one sorted log, cut by sampled ranges; each part carries on the last limit of those
    before it, so there is no join by range, and a user with many events is in several tasks.
    """
    amount = F.col("value").cast("decimal(22,2)")
    limit = F.when(F.col("event_type") == "purchase", F.struct(F.col("event_id").alias("limit_id"), amount.alias("amount")))
    rows = _ordered(events.filter(F.col("event_type").isin("purchase", "view")).withColumns({"limit": limit, "asked": amount}), "event_type", "limit", "asked")
    last = F.max_by("limit", F.when(F.col("limit").isNotNull(), F.struct("at", "event_id")))
    parts = rows.groupBy("owner", "part").agg(last.alias("last"))
    parts = parts.withColumn("before", F.last("last", ignorenulls=True).over(_earlier())).drop("last")
    rows = rows.withColumn("inside", F.last("limit", ignorenulls=True).over(_so_far())).filter("event_type = 'view'").join(parts, ["owner", "part"])
    held = F.coalesce("inside", "before")
    return rows.select("event_id", "user_id", F.col("asked").alias("amount"), held["limit_id"].alias("limit_id"), held["amount"].alias("limit_amount"), F.coalesce(F.col("asked") <= held["amount"], F.lit(False)).alias("within"))
