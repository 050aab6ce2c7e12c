"""Nearest records against brute force, with entities over many tasks."""

import random

import pytest

from tidemark.llm import nearest
from tidemark.llm.nearest import nearest_join

L = "run string, ts bigint, fid bigint, distance string"
R = "run string, sts bigint, sid bigint, distance string"


def truth(left, right, tol):
    out = set()
    for run, ts, fid, _ in left:
        best = None
        if run is not None and ts is not None:
            c = [(abs(t - ts), t, i) for r, t, i, _ in right if r == run and t is not None and i is not None]
            best = min(c) if c and min(c)[0] <= tol else None
        out.add((run, ts, fid, best[2] if best else None, best[0] if best else None))
    return out


@pytest.mark.parametrize("seed,entities,rows_per_task", [(1, 40, 1_000_000), (2, 1, 40), (3, 3, 25), (4, 200, 10)])
def test_against_brute_force(spark, seed, entities, rows_per_task):
    rnd = random.Random(seed)
    run = lambda: f"r{rnd.randrange(entities)}" if rnd.random() < 0.98 else None
    left = [(run(), rnd.randrange(5000) if rnd.random() < 0.95 else None, i, "x") for i in range(300)]
    right = [(run(), rnd.randrange(5000) if rnd.random() < 0.95 else None, i, "x") for i in range(300)]
    left += left[:20]
    right += right[:20]
    got = nearest_join(spark.createDataFrame(left, L).repartition(7), spark.createDataFrame(right, R), "run", "ts", "fid", "sts", "sid", 60, rows_per_task).collect()
    assert len(got) == len({(r.run, r.ts, r.fid) for r in got}) == len(set(left))
    assert {tuple(r) for r in got} == truth(left, right, 60)


def test_right_records_far_over_task_edges(spark, monkeypatch):
    """One entity; two right records with hundreds of left ones between them, in many tasks without any right record."""
    monkeypatch.setattr(nearest, "STRETCH", 4)
    left = [("a", 1000 + i, i, "") for i in range(400)]
    right = [("a", 990, 1, ""), ("a", 1450, 2, "")]
    got = nearest_join(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "run", "ts", "fid", "sts", "sid", 10**6, 10).collect()
    assert {tuple(r) for r in got} == truth(left, right, 10**6)


def test_nothing_goes_through_the_driver(spark):
    df = nearest_join(spark.createDataFrame([("a", 1, 1, "")] * 9, L), spark.createDataFrame([("a", 2, 1, "")], R), "run", "ts", "fid", "sts", "sid", 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RangePartitioning") == plan.count("rangepartitioning") == 0 and [tuple(r) for r in df.collect()] == [("a", 1, 1, 1, 1)]  # placed once, before


def test_ties_and_empty_tables(spark):
    left, right = [("a", 10, 1, ""), ("a", 20, 2, "")], [("a", 5, 1, ""), ("a", 15, 9, ""), ("a", 15, 3, "")]
    join = lambda a, b, tol=5: {tuple(r)[2:] for r in nearest_join(spark.createDataFrame(a, L), spark.createDataFrame(b, R), "run", "ts", "fid", "sts", "sid", tol).collect()}
    assert join(left, right) == {(1, 1, 5), (2, 3, 5)}
    assert join(left, right, 4) == {(1, None, None), (2, None, None)}
    assert join([], right) == set() and join(left, []) == {(1, None, None), (2, None, None)} and join([], []) == set()
