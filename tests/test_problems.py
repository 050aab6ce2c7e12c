"""The table operators against brute force, and their defined cases: NULLs, repeats, ties, empty tables, hot keys, clashing names."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, paged
from tidemark.operators.cells import diff_copies, snapshot_changes
from tidemark.operators.changefeed import apply_feed
from tidemark.operators.grid import regular_grid
from tidemark.operators.lifecycle import CLOSE, OPEN, REDUCE, operations
from tidemark.operators.orphans import ForeignKey, orphan_cascade, stale_references
from tidemark.operators.paged import paged_fold
from tidemark.operators.patches import Patches
from tidemark.plans.scratch import materialize, table
from tidemark.queries.problems import ORDER, p2_found

MESSAGES = "symbol string, trade_date string, seq bigint, type tinyint, order_id bigint, size int, recv_ts timestamp"
OPS = "k bigint, seq bigint, op tinyint, qty bigint"


def random_ops(seed, n, keys):
    rnd = random.Random(seed)
    return [(rnd.randrange(keys), i, rnd.choice((OPEN, OPEN, REDUCE, REDUCE, REDUCE, CLOSE)), rnd.randrange(0, 12)) for i in range(n)]


def walk(ops, state=None):
    """Sequential truth: the states and the orphans with their kinds."""
    state, orphans, prev = dict(state or {}), [], {}
    for k, seq, op, qty in sorted(ops, key=lambda x: x[1]):
        s = state.get(k, 0)
        if op == OPEN:
            state[k], prev[k] = s if s > 0 else qty, False
            continue
        if s <= 0:
            orphans.append((k, seq, "inherited" if prev.get(k) else "direct"))
        prev[k] = s <= 0
        state[k] = 0 if op == CLOSE else max(s - qty, 0)
    return {k: s for k, s in state.items() if s > 0}, orphans


@pytest.mark.parametrize("keys,chunk,fan_in", [(200, 4096, 256), (3, 16, 4), (1, 7, 2)])
def test_feed_against_a_walk(spark, keys, chunk, fan_in):
    ops = random_ops(keys, 1500, keys)
    df = spark.createDataFrame(ops, OPS).repartition(5)
    got = {r.k: r.size_left for r in apply_feed(df, ["k"], "seq", 1500, 12, chunk=chunk, fan_in=fan_in).collect()}
    assert got == walk(ops)[0]


@pytest.mark.parametrize("keys,page,stretch", [(200, 16384, 1024), (3, 50, 1024), (1, 100, 1024), (2, 7, 3), (40, 5, 2)])
def test_orphans_against_a_walk(spark, monkeypatch, keys, page, stretch):
    monkeypatch.setattr(paged, "SUPER", stretch)
    ops = random_ops(keys + 1, 1500, keys)
    df = spark.createDataFrame(ops, OPS).repartition(5)
    got = sorted((r.k, r.seq, r.kind) for r in stale_references(df, ["k"], "seq", page=page).collect())
    assert got == sorted(walk(ops)[1])


def test_a_chain_settles_in_few_rounds(spark, monkeypatch):
    """One order that lives through all its pages: the rounds are the logarithm of the pages, and each joins only what isn't settled."""
    n, rounds = 4096, []
    monkeypatch.setattr(paged, "materialize", lambda df: rounds.append(1) or materialize(df))
    ops = [(1, 0, OPEN, 3 * n), *[(1, i, REDUCE if i % 3 else OPEN, 1) for i in range(1, n)], (1, n, CLOSE, 0), (1, n + 1, REDUCE, 1)]
    got = stale_references(spark.createDataFrame(ops, OPS), ["k"], "seq", page=16).collect()
    assert [(r.seq, r.kind) for r in got] == [(n + 1, "direct")] and len(rounds) <= 2 + 8


def test_the_cascade_decides_on_the_given_tables(spark):
    d = Path("/root/testdata/sf0.01")
    if not d.exists():
        pytest.skip("no test tables here")
    out = p2_found(spark, str(d))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Inner" in plan
    ops = operations(table(spark, str(d), "messages"))
    pages = paged_fold(ops, ORDER, "seq", Patches(), [], lambda items, s: F.struct(F.size(items).alias("n"), s.alias("opening")))
    deep = pages.where("parent IS NOT NULL")
    assert deep.where("r.opening.size > 0").count() > 30  # pages that are read from what their parent left


def test_feed_on_a_base(spark):
    ops = [(1, 0, REDUCE, 3), (2, 1, CLOSE, 0), (3, 2, OPEN, 7), (4, 3, OPEN, 9), (5, 4, REDUCE, 1)]
    base = {1: 10, 2: 5, 4: 2, 6: 8}
    got = {
        r.k: r.size_left
        for r in apply_feed(spark.createDataFrame(ops, OPS), ["k"], "seq", 4, 10, spark.createDataFrame(list(base.items()), "k bigint, size_left bigint"), chunk=2, fan_in=2).collect()
    }
    assert got == walk(ops, base)[0] == {1: 7, 3: 7, 4: 2, 6: 8}


def test_feed_and_orphans_of_nothing(spark):
    empty = spark.createDataFrame([], OPS)
    assert apply_feed(empty, ["k"], "seq", 0, 0).count() == 0 and stale_references(empty, ["k"], "seq").count() == 0
    base = spark.createDataFrame([(1, 5)], "k bigint, size_left bigint")
    assert apply_feed(empty, ["k"], "seq", 0, 5, base).collect()[0].size_left == 5


def test_null_keys_are_values(spark):
    df = spark.createDataFrame([(None, 0, OPEN, 5), (None, 1, REDUCE, 2), (None, 2, CLOSE, 0), (None, 3, REDUCE, 1), (None, 4, REDUCE, 1), (None, 5, OPEN, 4)], OPS)
    for page in (100, 2):
        assert [r.kind for r in stale_references(df, ["k"], "seq", page=page).orderBy("seq").collect()] == ["direct", "inherited"]
    assert [(r.k, r.size_left) for r in apply_feed(df, ["k"], "seq", 5, 5, chunk=2, fan_in=2).collect()] == [(None, 4)]


def test_operations_take_the_last_version(spark):
    t = lambda s: f"2031-01-06 09:30:{s:02d}"
    rows = [
        ("A", "d", 0, 1, 7, 10, t(0)), ("A", "d", 0, 1, 7, 99, t(5)), ("A", "d", 0, 1, 7, 99, t(5)),  # corrected and repeated
        ("A", "d", 1, 2, 7, None, t(1)), ("A", "d", 2, 3, None, 5, t(1)), ("A", "d", 3, 2, 0, 5, t(1)), ("A", "d", None, 3, 7, 5, t(1)), ("A", "d", 4, 5, 7, 5, None), ("A", "d", 5, None, 7, 5, t(1)),
        ("A", "d", 6, 4, 8, -3, t(1)),
    ]
    df = spark.createDataFrame(rows, MESSAGES.replace("recv_ts timestamp", "r string")).withColumn("recv_ts", F.to_timestamp("r")).withColumn("op", F.lit("clash"))
    assert sorted(map(tuple, operations(df).collect())) == [("A", "d", 7, 0, OPEN, 99), ("A", "d", 7, 1, REDUCE, 0), ("A", "d", 8, 6, REDUCE, 0)]


def test_cascade_over_tables(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    b = spark.createDataFrame([(10, 1), (11, 9), (12, None), (11, 9), (13, 8)], "id int, a int")
    c = spark.createDataFrame([(100, 10, 1), (101, 11, 1), (102, 77, 1), (103, 13, 101)], "id int, b int, extra int")
    d = spark.createDataFrame([(1000, 101), (1001, 100), (1002, 102)], "id int, c int")
    fks = [ForeignKey("b", ("a",), "a", ("id",)), ForeignKey("c", ("b",), "b", ("id",)), ForeignKey("d", ("c",), "c", ("id",))]
    got = orphan_cascade({"a": a, "b": b, "c": c, "d": d}, {t: ["id"] for t in "abcd"}, fks)
    assert {t: sorted((r.id, r.kind, r.depth) for r in df.collect()) for t, df in got.items()} == {
        "b": [(11, "direct", 0), (13, "direct", 0)],
        "c": [(101, "inherited", 1), (102, "direct", 0), (103, "inherited", 1)],
        "d": [(1000, "inherited", 2), (1002, "inherited", 1)],
    }


def test_a_cascade_of_any_depth(spark):
    node = spark.createDataFrame([(i, i - 1) for i in range(12)], "id int, up int").where("id > 0 OR up = -1")
    got = orphan_cascade({"n": node.coalesce(1)}, {"n": ["id"]}, [ForeignKey("n", ("up",), "n", ("id",))])["n"]
    assert sorted((r.id, r.depth) for r in got.collect()) == [(i, i) for i in range(12)]


def test_cascade_with_a_cycle_and_empty_tables(spark):
    node = spark.createDataFrame([(1, 2), (2, 1), (3, 99), (4, 3), (5, 4)], "id int, up int")
    got = orphan_cascade({"n": node}, {"n": ["id"]}, [ForeignKey("n", ("up",), "n", ("id",))])["n"]
    assert sorted((r.id, r.kind, r.depth) for r in got.collect()) == [(3, "direct", 0), (4, "inherited", 1), (5, "inherited", 2)]
    empty = spark.createDataFrame([], "id int, up int")
    assert orphan_cascade({"n": empty}, {"n": ["id"]}, [ForeignKey("n", ("up",), "n", ("id",))])["n"].count() == 0


# --- grid
READ = "k string, ts bigint, seq bigint, v bigint, q bigint, period_ns string, status string"


def grid(spark, rows, spans, **kw):
    r = spark.createDataFrame(rows, READ)
    s = spark.createDataFrame(spans, "k string, a bigint, b bigint, v string")
    out = regular_grid(r, s, ["k"], "ts", "seq", ["v"], ["q"], F.col("v").isNotNull(), "a", "b", 10, **({"slices": 5} | kw))
    return {(x.k, x.period_ns): x for x in out.collect()}


def test_grid_weights_and_marks(spark):
    rows = [("A", 12, 0, 100, 1, "", ""), ("A", 16, 1, 200, 2, "", ""), ("A", 16, 1, 200, 2, "", ""), ("A", 45, 2, 300, None, "", ""), ("A", 31, 3, None, 5, "", ""), ("A", None, 4, 7, 7, "", "")]
    g = grid(spark, rows, [("A", 0, 60, ""), ("B", 0, 60, ""), (None, 0, 60, "")])
    assert sorted(k for k in g) == [("A", t) for t in range(0, 60, 10)]
    assert (g["A", 0].status, g["A", 0].v_twa, g["A", 0].cover_ns, g["A", 0].q_sum) == ("empty", None, 0, 0)
    assert (g["A", 10].status, g["A", 10].n_readings, g["A", 10].v_twa, g["A", 10].coverage, g["A", 10].q_sum) == ("observed", 2, (100 * 4 + 200 * 4) / 8, 0.8, 3)
    assert (g["A", 20].status, g["A", 20].v_twa, g["A", 30].n_readings) == ("filled", 200, 0)
    assert (g["A", 40].v_twa, g["A", 40].q_sum, g["A", 50].v_twa) == ((200 * 5 + 300 * 5) / 10, 0, 300)


def test_grid_longest_hold_and_readings_outside(spark):
    rows = [("A", -25, 0, 5, 1, "", ""), ("A", 38, 1, 7, 1, "", ""), ("A", 70, 2, 9, 1, "", "")]
    g = grid(spark, rows, [("A", 0, 60, "")])
    assert [g["A", t].status for t in range(0, 60, 10)] == ["filled", "filled", "filled", "observed", "filled", "filled"] and g["A", 0].v_twa == 5
    g = grid(spark, rows, [("A", 0, 60, "")], max_hold=4)
    assert [g["A", t].cover_ns for t in range(0, 60, 10)] == [0, 0, 0, 2, 2, 0]


def test_grid_ties_and_empty_inputs(spark):
    g = grid(spark, [("A", 5, 1, 10, 1, "", ""), ("A", 5, 2, 20, 1, "", ""), ("A", 5, 0, 30, 1, "", "")], [("A", 0, 10, "")])
    assert g["A", 0].v_twa == 20 and g["A", 0].n_readings == 3
    assert grid(spark, [], [("A", 0, 10, "")]) == {} and grid(spark, [("A", 5, 1, 1, 1, "", "")], []) == {}
    g = grid(spark, [("A", 5, 1, None, 1, "", "")], [("A", 0, 20, ""), ])
    assert [g["A", t].status for t in (0, 10)] == ["empty", "empty"]


@pytest.mark.parametrize("slices", [1, 5, 7])
def test_grid_against_brute_force(spark, slices):
    rnd = random.Random(slices)
    rows = list({t: ("A", t, t, rnd.randrange(1, 9), 1, "", "") for t in (rnd.randrange(-20, 140) for _ in range(60))}.values())
    g = grid(spark, rows, [("A", 20, 100, "")], slices=slices)
    step = {}
    for t in range(-20, 100):
        known = [r for r in rows if r[1] <= t]
        step[t] = max(known, key=lambda r: r[1])[3] if known else None
    for c in range(20, 100, 10):
        here = [step[t] for t in range(c, c + 10) if step[t] is not None]
        assert g["A", c].cover_ns == len(here) and g["A", c].n_readings == sum(c <= r[1] < c + 10 for r in rows)
        assert g["A", c].v_twa == pytest.approx(sum(here) / len(here)) if here else g["A", c].v_twa is None


# --- cells
def test_diff(spark):
    schema = "k int, p bigint, s int, side string, fields int"
    left = spark.createDataFrame([(1, 5, 1, "", 0), (1, 5, 1, "", 0), (2, None, None, "", 0), (3, 7, 1, "", 0), (4, 1, 1, "", 0), (None, 1, 1, "", 0), (6, 1, 1, "", 0), (6, 2, 1, "", 0)], schema)
    right = spark.createDataFrame([(1, 5, 2, "", 1), (2, 9, 0, "", 1), (3, 7, 1, "", 1), (5, 1, 1, "", 1), (None, 2, 1, "", 1), (6, 2, 1, "", 0), (6, 1, 1, "", 0)], schema)
    fields = {"p": F.when(F.col("p") != 9, F.col("p")), "s": F.coalesce("s", F.lit(0))}
    d = lambda a, b: sorted(((r.k, r.diff) for r in diff_copies(a, b, ["k"], fields, "only_l", "only_r").collect()), key=str)
    assert d(left, right) == sorted([(1, "s"), (4, "only_l"), (5, "only_r"), (None, "p")], key=str)
    empty = left.limit(0)
    assert d(left, left) == [] and d(empty, empty) == [] and {x for _, x in d(left, empty)} == {"only_l"} and {x for _, x in d(empty, right)} == {"only_r"}


def test_diff_of_texts(spark):
    a = spark.createDataFrame([(1, "x", 1.5), (2, "", None)], "k int, t string, f double")
    b = spark.createDataFrame([(1, "y", 1.5), (2, None, None)], "k int, t string, f double")
    got = diff_copies(a, b, ["k"], {"t": F.col("t"), "f": F.col("f")}, "l", "r")
    assert sorted((r.k, r.diff) for r in got.collect()) == [(1, "t"), (2, "t")]


@pytest.mark.parametrize("block", [64, 2, 1])
def test_snapshots_in_blocks_against_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    rnd = random.Random(block)
    snaps = {p: {n: {k: rnd.randrange(3) for k in range(12) if rnd.random() < 0.8} for n in sorted(rnd.sample(range(40), 9))} for p in "xy"}
    rows = [(p, n, k, v) for p, s in snaps.items() for n, r in s.items() for k, v in r.items() for _ in range(rnd.choice((1, 1, 3)))]
    want = set()
    for p, s in snaps.items():
        for a, b in zip(list(s), list(s)[1:]):
            want |= {(p, b, k, "added") for k in s[b].keys() - s[a].keys()} | {(p, b, k, "removed") for k in s[a].keys() - s[b].keys()}
            want |= {(p, b, k, "changed") for k in s[a].keys() & s[b].keys() if s[a][k] != s[b][k]}
    got = snapshot_changes(spark.createDataFrame(rows, "d string, n int, k int, v bigint"), ["d"], "n", ["k"], {"v": F.col("v")}).collect()
    assert len(got) == len(want) and {(r.d, r.n, r.k, r.change) for r in got} == want


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_snapshots(spark, broadcast_rows):
    schema = "d string, n int, k string, v bigint, change string, fields int"
    rows = [("x", 1, "a", 1, "", 0), ("x", 1, "b", 1, "", 0), ("x", 3, "a", 1, "", 0), ("x", 3, "a", 1, "", 1), ("x", 3, "c", None, "", 0), ("x", 4, "a", 2, "", 0), ("x", 4, "c", 0, "", 0), ("y", 9, "a", 5, "", 0), ("x", None, "q", 5, "", 0)]
    df = spark.createDataFrame(rows, schema)
    got = snapshot_changes(df, ["d"], "n", ["k"], {"v": F.coalesce("v", F.lit(0))}, broadcast_rows).collect()
    assert sorted((r.d, r.n, r.k, r.change, tuple(r.fields)) for r in got) == [("x", 3, "b", "removed", ()), ("x", 3, "c", "added", ()), ("x", 4, "a", "changed", ("v",))]
    assert snapshot_changes(df.limit(0), ["d"], "n", ["k"], {"v": F.col("v")}).count() == 0
