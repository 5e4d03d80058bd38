"""Event logs in batch: latest rows, sliding windows, sessions, and a folded workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.sources.tables import written

#: What an action does in a state; any other pair leaves the state as it is.
STEPS = {
    ("DRAFT", "SUBMIT"): "PROJECT_REVIEW",
    ("CHANGES_REQUESTED", "SUBMIT"): "PROJECT_REVIEW",
    ("PROJECT_REVIEW", "APPROVE"): "FINANCE_REVIEW",
    ("PROJECT_REVIEW", "REQUEST_CHANGES"): "CHANGES_REQUESTED",
    ("PROJECT_REVIEW", "REJECT"): "REJECTED",
    ("FINANCE_REVIEW", "APPROVE"): "APPROVED",
    ("FINANCE_REVIEW", "REQUEST_CHANGES"): "CHANGES_REQUESTED",
    ("FINANCE_REVIEW", "REJECT"): "REJECTED",
}
ACTIONS = {"signup": "SUBMIT", "purchase": "APPROVE", "view": "REQUEST_CHANGES", "error": "REJECT"}


def micros(c: str):
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def latest(events: DataFrame) -> DataFrame:
    """Each user's last event, the larger id of equal times."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")
    return events.groupBy("user_id").agg(last).select("user_id", "e.event_id", "e.event_type", "e.value")


def failure_limiter(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """Errors with the number of the user's errors in the time before and at them, and whether they are over the limit."""
    window = Window.partitionBy("user_id").orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    rows = events.filter("event_type = 'error'").withColumn("n", F.count("*").over(window))
    return rows.select("event_id", "user_id", "n", (F.col("n") >= most).alias("blocked"))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """rows sorted by order over all partitions, cut by sampled ranges, so that a key with many rows is in several.

    `part` numbers the partitions. The columns must set equal rows apart only where their order matters.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their place from 1 in order over all partitions: places within a part, and the rows of the parts before it.

    One task holds one row for each part, and so does what is broadcast.
    """
    rows = written(in_order(rows, *order), "numbered")
    sizes = rows.groupBy("part").agg(F.count("*").alias("rows_of_part"))
    before = F.coalesce(F.sum("rows_of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    rows = rows.withColumn("inside", inside).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    return rows.withColumn("place", (F.col("before") + F.col("inside")).cast("long")).drop("part", "before", "inside")


def _fold_parts(states: list[str]):
    """(user_id, part, to, moves) of each user's rows in a partition: where each state leads, and in how many moves."""
    table = [{i: states.index(STEPS[s, a]) for i, s in enumerate(states) if (s, a) in STEPS} for a in ACTIONS.values()]
    effects = {}

    def effect(to, action):
        found = table[action]
        return tuple(found.get(x, x) for x in to), tuple(i for i, x in enumerate(to) if x in found)

    def run(batches):
        import pyarrow as pa

        names = ["user_id", "part", "to", "moves"]
        open_ = None
        kind = None

        def batch(rows):
            user, part, to, moves = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(user, kind), pa.array(part, pa.int32()), pa.array(to, pa.list_(pa.int32())), pa.array(moves, pa.list_(pa.int64()))], names)

        for b in batches:
            done, kind = [], b.schema.field("user_id").type
            for user, part, action in zip(*(b.column(c).to_pylist() for c in ("user_id", "part", "action")), strict=True):
                if open_ is None or open_[0] != user:
                    if open_:
                        done.append(open_)
                    open_ = [user, part, tuple(range(len(states))), [0] * len(states)]
                key = open_[2], action
                if key not in effects:
                    effects[key] = effect(*key)
                open_[2], moved = effects[key]
                for i in moved:
                    open_[3][i] += 1
            if done:
                yield batch(done)
        if open_:
            yield batch([open_])

    return run


def fold_workflow(events: DataFrame) -> DataFrame:
    """Each user's events as actions on one document: its last state, and how many actions had an effect.

    A row of actions is a map from each state to the state it leads to and the moves on the way. Such maps can be put
    together, so each partition folds its part of a user's log, and at most one map a partition meets for a user.
    """
    states = sorted({x for (s, _), t in STEPS.items() for x in (s, t)})
    action = F.create_map(*[F.lit(x) for i, name in enumerate(ACTIONS) for x in (name, i)])
    rows = events.select("user_id", "ts", "event_id", F.try_element_at(action, F.col("event_type")).alias("action")).filter("action is not null")
    parts = in_order(rows, "user_id", "ts", "event_id", "action").select("user_id", "part", "action")
    parts = parts.mapInArrow(_fold_parts(states), f"user_id {events.schema['user_id'].dataType.simpleString()}, part int, to array<int>, moves array<bigint>")
    lists = parts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("part", "to", "moves"))).alias("log"))
    start = F.struct(F.lit(states.index("DRAFT")).alias("state"), F.lit(0).cast("long").alias("moves"))

    def step(acc, e):
        return F.struct(F.get(e["to"], acc["state"]).alias("state"), (acc["moves"] + F.get(e["moves"], acc["state"])).alias("moves"))

    names = F.array(*map(F.lit, states))
    return lists.select("user_id", F.aggregate("log", start, step).alias("r")).select("user_id", F.get(names, F.col("r.state")).alias("state"), "r.moves")


def tumbling(events: DataFrame, width: str) -> DataFrame:
    rows = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(micros("w.start").alias("start_us"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", micros("w.start").alias("start_us"), "n")


def properties(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def fan_out(events: DataFrame, recipients: DataFrame) -> DataFrame:
    """One notification for each recipient and day of an event kind, however many events there were."""
    rows = events.join(recipients, events.user_id % 7 == recipients.sender).select("recipient", "event_type", F.to_date("ts").alias("day"), "event_id")
    return rows.groupBy("recipient", "event_type", "day").agg(F.min("event_id").alias("event_id"))
