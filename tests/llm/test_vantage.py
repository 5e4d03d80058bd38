"""Nearest neighbours by vantage-point trees against brute force: exact at factor one, with recall above it, and on edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import common, vantage

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, id long, cell long, shard long, number string"


def brute(rows, k=20):
    """rows: (id, vector). Each distinct row with an id divisible by 20 asks; equal lengths only."""
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for i, q in ok:
        if i % 20 == 0:
            found = []
            for j, v in ok:
                if j != i and len(v) == len(q):
                    s = 0.0
                    for a, b in zip(q, v):
                        s += a * b
                    found.append((-s, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(lambda x: None if x is None else float(x), v)), 1, 2, 3, 4, "n") for i, v in rows], SCHEMA)


def found(df):
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard_rows,leaf", [(4096, 256), (40, 4)])
def test_given_vectors(spark, shard_rows, leaf):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in df.collect()]
    assert found(vantage.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, shard_rows=shard_rows, leaf=leaf)) == brute(rows)


@pytest.mark.parametrize("shard_rows,leaf", [(4096, 256), (50, 3), (7, 1)])
def test_edge_vectors(spark, shard_rows, leaf):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(200)]
    rows += [(200 + i, [0.5, -1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(120)]  # copies, with queries among them
    rows += [(400 + i, np.eye(6)[i % 6].tolist()) for i in range(60)]  # all products with others are 0 or 1
    rows += [(500 + i, rng.integers(-1, 2, 3).tolist()) for i in range(60)] + [(600, [2.0]), (601, [-3.0]), (620, [1.0, 2.0])]
    rows += [(20, None), (40, []), (60, [0.0] * 6), (80, [math.nan] + [1.0] * 5), (100, [math.inf] + [1.0] * 5), (700, [None] + [1.0] * 5), (None, [1.0] * 6)]
    rows += rows[:50] + [(20, [9.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (21, [9.0, 1.0, 0.0, 0.0, 0.0, 0.0])]  # repeated rows, and ids with two vectors
    assert found(vantage.nearest(frame(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, shard_rows=shard_rows, leaf=leaf)) == brute(rows)
    none = common.materialize(frame(spark, rows).limit(0), "none")
    assert vantage.nearest(none, "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_of_queries_meet_copies_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(vantage, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    assert found(vantage.nearest(frame(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, shard_rows=60, leaf=8)) == brute(rows)


def clustered(rng, n):
    centers = rng.normal(size=(40, 16))
    x = centers[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_factor_over_one_keeps_the_recall(spark):
    x = clustered(np.random.default_rng(5), 4000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df, want = frame(spark, rows), {(q, v) for q, _, v, _ in brute(rows)}
    recall = {}
    for factor in (1.0, 1.5, 4.0):
        got = {(q, v) for q, _, v, _ in found(vantage.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, factor=factor, shard_rows=500, leaf=32))}
        recall[factor] = len(got & want) / len(want)
    assert recall[1.0] == 1 and recall[1.5] >= 0.9, recall


def test_bounds_leave_rows_out():
    x = clustered(np.random.default_rng(6), 4000)
    q, ids, visited = x[::100], np.arange(len(x)), {}
    for factor in (1.0, 1.5, 4.0):
        s = vantage.Shard(ids, x, 1.0, 20, 32)
        s.search(ids[::100], q, np.full(len(q), -np.inf), factor)
        visited[factor] = s.visited / (len(q) * len(x))
    assert visited[4.0] < visited[1.5] < visited[1.0] < 0.6, visited
