"""Folds of event logs in which one user holds most events, against a loop in Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import events as batch
from auditlake.operators import intake, jobs


def logs(seed, spread):
    rng = np.random.default_rng(seed)
    kinds = [*batch.ACTIONS, "click"]
    users = [1] * 3000 + rng.integers(2, 40, 1500).tolist() + [None] * 50
    return [(u, int(rng.integers(0, spread)), i, kinds[int(rng.integers(0, 5))]) for i, u in enumerate(users)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, s long, event_id long, event_type string")
    return df.withColumn("ts", F.expr("timestamp_micros(1700000000000000 + s * 1000000)"))


def parts_of_the_hot_user(df, *order):
    return batch.in_order(df, *order).filter("user_id = 1").select("part").distinct().count()


def test_workflow_with_a_hot_user(spark):
    rows = logs(1, 900)  # many events have one time
    df = frame(spark, rows)
    want = {}
    for user, _, _, kind in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if kind in batch.ACTIONS:
            state, moves = want.get(user, ("DRAFT", 0))
            to = batch.STEPS.get((state, batch.ACTIONS[kind]))
            want[user] = (to or state, moves + (to is not None))
    assert {r.user_id: (r.state, r.moves) for r in batch.fold_workflow(df).collect()} == want
    assert parts_of_the_hot_user(df, "user_id", "ts", "event_id") > 2
    assert "collect_list(struct(ts" not in batch.fold_workflow(df)._jdf.queryExecution().optimizedPlan().toString()
    assert batch.fold_workflow(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread,seconds", [(100_000, 60), (100_000, 7_000), (3_000, 1), (3_000, 10_000), (50, 7), (1, 5), (20_000, 0)])
def test_admission_with_a_hot_user(spark, spread, seconds):
    rows = logs(spread + seconds, spread)
    df = frame(spark, rows).withColumn("ts", F.when(F.col("event_id") % 997 != 5, F.col("ts")))
    want, last = {}, {}
    for user, s, i, _ in sorted(rows, key=lambda r: (r[2] % 997 != 5, r[1])):
        yes, no = want.get(user, (0, 0))
        if i % 997 == 5 or user not in last or s - last[user] >= seconds:
            want[user] = (yes + 1, no)
            if i % 997 != 5:
                last[user] = s
        else:
            want[user] = (yes, no + 1)
    assert {r.user_id: (r.admitted, r.refused) for r in intake.admission(df, seconds).collect()} == want
    assert intake.admission(df.limit(0), seconds).count() == 0
    assert "aggregate(" not in intake.admission(df, seconds)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("parts", [1, 7])
def test_limits_and_revisions_over_cut_logs(spark, parts):
    rng = random.Random(5)
    kinds = ["purchase", "view", "signup", "error"]
    rows = [(i, f"2024-01-01 00:{rng.randint(0, 30):02}:00", 1 if rng.random() < 0.6 else rng.choice([2, 3, 4, None]), rng.choice(kinds), rng.randint(0, 900) / 100) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    logs, limits, decisions, results = {}, [], [], []
    for r in sorted(rows, key=lambda r: (r[2] or 0, r[1], r[0])):
        logs.setdefault(r[2], []).append(r)
    for user, log in logs.items():
        held, revision, signups = None, 0, sum(r[3] == "signup" for r in log)
        for i, (e, at, _, kind, value) in enumerate(log):
            revision += kind == "signup"
            if kind == "purchase":
                held = e, value
                limits.append((user, e, value, next((r[1] for r in log[i + 1 :] if r[3] == "purchase"), None)))
                results.append((e, user, revision, signups, revision == signups))
            if kind == "view":
                decisions.append((e, user, value, *(held or (None, None)), held is not None and value <= held[1]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        number = lambda x: None if x is None else float(x)
        got = [(r.event_id, r.user_id, number(r.amount), r.limit_id, number(r.limit_amount), r.within) for r in jobs.authority_as_of(df).collect()]
        assert sorted(got, key=str) == sorted(decisions, key=str)
        assert sorted(map(tuple, jobs.fenced_results(df).collect()), key=str) == sorted(results, key=str)
        end = F.date_format(F.timestamp_micros("valid_to"), "yyyy-MM-dd HH:mm:ss")
        got = [(r.user_id, r.event_id, number(r.amount), r.end) for r in jobs.limit_history(df).withColumn("end", end).collect()]
        assert sorted(got, key=str) == sorted(limits, key=str)
        for f in (jobs.authority_as_of, jobs.fenced_results, jobs.limit_history):
            assert f(df.filter("event_id < 0")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
