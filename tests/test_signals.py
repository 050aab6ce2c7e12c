"""Windows, signals, regressions, as-of joins and metrics against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.metrics import curve_metrics, describe
from tidemark.functions.research import predictive_table, regression
from tidemark.functions.signals import bucket_ofi, event_signals
from tidemark.functions.windows import numbered
from tidemark.operators.asof import asof_join
from tidemark.operators.backtest import Curve, FlowSignal
from tidemark.operators.depth import features_from_depth, seeds, walk
from tidemark.operators import orders
from tidemark.operators.orders import closing_levels, level_changes, lifecycle, message_features, queue_positions
from tidemark.operators.replay import MODES, explain_row, replay, replay_stats, validate
from tidemark.schema import NO_ASK, NO_BID

FEATURES = "symbol string, trade_date string, seq bigint, ts_ns bigint, mid double, ofi_e bigint, bid_qty int, ask_qty int, trade_qty int"
S = 1_000_000_000


def features(spark, n, seed=0, symbols=("A", "B")):
    rnd = random.Random(seed)
    rows = [(s, "d", i * 3, i * S // 2, None if rnd.random() < 0.05 else 10 + rnd.randrange(20) / 100, rnd.randrange(-50, 50), rnd.randrange(10), rnd.randrange(10), rnd.randrange(5)) for s in symbols for i in range(n)]
    return rows, spark.createDataFrame(rows, FEATURES).repartition(6)


def test_numbering_in_blocks(spark):
    rows, df = features(spark, 50)
    for block in (7, 1000):
        got = numbered(df, ["symbol"], "seq", block).collect()
        assert all(r.pos == r.seq // 3 for r in got) and len(got) == 100


def test_numbering_moves_its_input_once(spark):
    _, df = features(spark, 50, symbols=("A", None))
    got = numbered(df.distinct(), ["symbol", "trade_date"], "seq", 7)
    assert got.columns == [*df.columns, "pos"]
    assert sorted((r.symbol or "", r.pos) for r in got.collect() if r.pos == r.seq // 3) == [(s, i) for s in ("", "A") for i in range(50)]
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [5, 13, 1000])
def test_event_signals_in_blocks(spark, block):
    rows, df = features(spark, 60, 3, ("A",))
    got = {r.seq: r for r in event_signals(df, [4], [3], [(3, 6)], block=block).collect()}
    assert len(got) == 60
    signal = FlowSignal(3, 6)
    for i, r in enumerate(rows):
        signal.take(r[5], i + 1)
        x = got[r[2]]
        assert x.z_3_6 == pytest.approx(signal.z, abs=1e-9)
        assert x.ofi_w4 == (sum(y[5] for y in rows[i - 3 : i + 1]) if i >= 3 else None)
        ahead = rows[i + 3][4] if i + 3 < 60 else None
        assert x.fwd_3 == (pytest.approx((ahead - r[4]) * 100) if ahead is not None and r[4] is not None else None)


def test_buckets_span_gaps(spark):
    rows = [("A", "d", 0, 0, 1.0, 5, 2, 4, 1), ("A", "d", 1, S, 1.1, 7, 4, 4, 1), ("A", "d", 2, 25 * S, 1.3, 1, 1, 1, 0), ("A", "d", 3, 26 * S, None, 99, 9, 9, 9), ("A", "d", 4, 41 * S, 1.2, 2, 1, 1, 0)]
    got = [tuple(r) for r in bucket_ofi(spark.createDataFrame(rows, FEATURES), 10 * S).orderBy("bucket").collect()]
    assert [(r[2], r[3], r[6]) for r in got] == [(20 * S, 1, 1), (40 * S, 2, 1)]
    assert got[0][8] == pytest.approx(20) and got[0][9] == pytest.approx(-10) and got[1][9] is None


def test_hac_equals_the_dense_sandwich(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = 0.4 * x + rng.normal(size=300) + 0.3 * np.roll(rng.normal(size=300), 1)
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, t int, x double, y double")
    r = regression(df, "x", "y", ["g"], "t").first()
    X = np.column_stack([np.ones(300), x])
    beta = np.linalg.solve(X.T @ X, X.T @ y)
    u = X * (y - X @ beta)[:, None]
    meat = u.T @ u
    for k in range(1, 6):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / 6) * (g + g.T)
    bread = np.linalg.inv(X.T @ X)
    assert r.slope == pytest.approx(beta[1]) and r.intercept == pytest.approx(beta[0])
    assert r.t_hac == pytest.approx(beta[1] / np.sqrt((bread @ meat @ bread)[1, 1]))


def test_regression_without_spread(spark):
    df = spark.createDataFrame([("g", 1, 1.0, 2.0), ("g", 2, 1.0, 3.0), ("g", 3, None, 3.0)], "g string, t int, x double, y double")
    r = regression(df, "x", "y", ["g"], "t").first()
    assert r.n == 2 and r.slope is None and r.t_hac is None
    assert regression(df.limit(0), "x", "y", ["g"], "t").count() == 0


def test_predictive_table_has_every_pair(spark):
    _, df = features(spark, 80)
    got = predictive_table(df, [2, 5], [1, 3])
    assert got.count() == 2 * 3 * 2 and got.where("n > 0 AND corr IS NULL").count() == 0


def test_predictive_table_without_variation(spark):
    quotes = {"still mid": lambda i: (1.0, i % 7), "still book": lambda i: (1 + i * i % 11 / 100, 5)}
    rows = [(s, "d", i, i, at(i)[0], i * i % 5, at(i)[1], 10, 0) for s, at in quotes.items() for i in range(30)]
    got = {(r.symbol, r.signal, r.horizon_events): r for r in predictive_table(spark.createDataFrame(rows, FEATURES), [2], [1, 3]).collect()}
    assert len(got) == 2 * 2 * 2
    for s in quotes:
        d = [r for r in rows if r[0] == s]
        for h in (1, 3):
            signals = {"ofi_w2": [None, *[a[5] + b[5] for a, b in zip(d, d[1:])]], "queue_imbalance": [(r[6] - 10) / (r[6] + 10) for r in d]}
            ahead = [(b[4] - a[4]) * 100 for a, b in zip(d, d[h:])]
            for signal, xs in signals.items():
                x, y = zip(*[(a, b) for a, b in zip(xs, ahead) if a is not None])
                r = got[s, signal, h]
                assert r.n == len(x) > 1
                assert r["corr"] == (pytest.approx(np.corrcoef(x, y)[0, 1]) if len(set(x)) > 1 and len(set(y)) > 1 else None)


def test_asof_ties_and_missing(spark):
    r = spark.createDataFrame([("A", 10, 1, 1.0), ("A", 10, 2, 2.0), ("A", 20, 3, None), ("A", None, 4, 9.0), (None, 1, 5, 8.0), ("A", 95, 6, 3.0)], "k string, t bigint, o bigint, v double")
    l = spark.createDataFrame([("A", 9), ("A", 10), ("A", 30), ("A", 99), ("B", 50), (None, 50), ("A", None)], "k string, at bigint")
    for bucket in (3, 50, 1000):
        got = {(x.k, x.at): x.m for x in asof_join(l, r, ["k"], "at", "t", "o", "v", bucket, "m").collect()}
        assert got == {("A", 9): None, ("A", 10): 2.0, ("A", 30): 2.0, ("A", 99): 3.0, ("B", 50): None, (None, 50): None, ("A", None): None}


@pytest.mark.parametrize("block", [3, 1000])
def test_curve_metrics(spark, block):
    rnd = random.Random(2)
    curves = {"a": [rnd.gauss(0, 5) for _ in range(40)], "b": [-3.0, -1.0], "c": [-4.0, 2.0, 1.0]}
    rows = [(k, i * 7, i, e) for k, c in curves.items() for i, e in enumerate(c)] + [("a", 0, 0, curves["a"][0]), ("a", None, 99, 1.0)]
    got = {r.run: r for r in curve_metrics(spark.createDataFrame(rows, "run string, t bigint, id bigint, e double"), ["run"], "t", "id", "e", 10.0, block).collect()}
    for k, c in curves.items():
        assert got[k].n_samples == len(c) and got[k].total_pnl == c[-1]
        curve = Curve()
        for e in c:
            curve.add(e, 1)
        assert got[k].max_drawdown == pytest.approx(curve.fall) and got[k].sharpe == pytest.approx(curve.sharpe(10.0))


DEPTH = "symbol string, trade_date string, seq bigint, ts_ns bigint, " + ", ".join(f"{s}_{w}_{j} {'bigint' if w == 'px' else 'int'}" for j in (1, 2) for s in ("ask", "bid") for w in ("px", "sz"))


def test_depth_features_and_walk(spark):
    rows = [("A", "d", 0, 1, 1100, 10, 1000, 20, 1200, 5, None, None), ("A", "d", 1, 2, 1100, 15, 1000, 20, NO_ASK, 0, 900, 7), ("A", "d", 2, 3, None, None, 1000, 25, None, 0, NO_BID, 0), ("A", "d", 2, 3, None, None, 1000, 25, None, 0, NO_BID, 0)]
    df = spark.createDataFrame(rows, DEPTH)
    got = features_from_depth(df).orderBy("seq").collect()
    assert [(r.best_bid, r.best_ask, r.bid_qty, r.ask_qty, r.ofi_e) for r in got] == [(1000, 1100, 20, 10, 0), (1000, 1100, 20, 15, -5), (1000, NO_ASK, 25, 0, 0)]
    assert [r.mid for r in got] == [pytest.approx(0.105), pytest.approx(0.105), None]
    w = {r.seq: r for r in walk(df, 2, 1, 12).distinct().collect()}
    assert (w[0].filled, w[0].cost, w[0].last_px) == (12, 10 * 1100 + 2 * 1200, 1200) and (w[2].filled, w[2].rest, w[2].last_px) == (0, 12, None)
    limited = {r.seq: r.filled for r in walk(df, 2, 1, 12, F.lit(1100)).distinct().collect()}
    assert limited == {0: 10, 1: 12, 2: 0}
    assert sorted((r.side, r.px, r.sz) for r in seeds(df, 2).collect()) == [(-1, 1100, 10), (-1, 1200, 5), (1, 1000, 20)]


FEED = "symbol string, trade_date string, seq bigint, ts_ns bigint, type tinyint, order_id bigint, size int, price bigint, direction tinyint"


def random_feed(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for s in ("A", "B"):
        for i in range(n):
            side = rnd.choice((1, -1))
            rows.append((s, "d", i, i * 10, rnd.choice((1, 1, 1, 2, 3, 4, 5, 6, 7)), rnd.randrange(60), rnd.randrange(0, 30), 10_000 - side * 100 * rnd.randrange(1, 6), side))
    return rows, spark.createDataFrame([r for r in rows if not (r[4] in (1, 2, 3, 4) and r[5] == 0)], FEED).repartition(4)


@pytest.mark.parametrize("page", [37, 16384])
def test_sets_equal_the_scan(spark, page):
    _, feed = random_feed(spark)
    scan = {(r.symbol, r.seq): (r.best_bid, r.bid_qty, r.best_ask, r.ask_qty, [(x.px, x.sz) for x in r.asks if x.sz], [(x.px, x.sz) for x in r.bids if x.sz]) for r in replay(feed, depth_k=9).collect()}
    changes = sorted(level_changes(feed, page).collect(), key=lambda r: r.seq)
    levels: dict = {}
    by_seq: dict = {}
    for r in changes:
        by_seq.setdefault((r.symbol, r.seq), []).append(r)
    for key in sorted(scan):
        for r in by_seq.get(key, []):
            levels[r.symbol, r.side, r.px] = r.qty
        live = {side: sorted(((p, q) for (s, d, p), q in levels.items() if s == key[0] and d == side and q > 0), key=lambda x: -side * x[0]) for side in (1, -1)}
        assert scan[key][4] == live[-1] and scan[key][5] == live[1]
    end = max(k for k in scan if k[0] == "A")
    closing = [(r.side, r.px, r.qty) for r in closing_levels(feed, page).where("symbol = 'A'").orderBy("side", "level").collect()]
    assert closing == [(-1, p, q) for p, q in scan[end][4]] + [(1, p, q) for p, q in scan[end][5]]
    rest = {(r.symbol, r.order_id): r.remaining for r in lifecycle(feed, page).where("remaining > 0").collect()}
    assert rest == {(r.symbol, r.order_id): r.remaining for r in queue_positions(feed, page).collect()}


@pytest.mark.parametrize("stretch,page", [(7, 5), (50, 64), (65_536, 64)])
def test_features_in_sets_equal_the_scan(spark, monkeypatch, stretch, page):
    monkeypatch.setattr(orders, "STRETCH", stretch)
    _, feed = random_feed(spark, 200, 5)
    feed = feed.withColumn("ts_ns", F.when(F.col("seq") % 9 > 1, F.col("ts_ns"))).where("seq % 11 <> 3").unionByName(feed.where("symbol = 'A' AND seq < 2").withColumn("symbol", F.lit("C")))
    scan = replay(feed)
    got = message_features(feed, page).select(*scan.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scan.collect()))
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert message_features(feed.limit(0), page).count() == 0


def test_describe(spark):
    rnd = random.Random(3)
    data = {"a": [rnd.choice((0.0, -1.5, 2.0, 1e9, -1e-9, 7.25)) for _ in range(101)], "b": [5.0], "c": [rnd.gauss(0, 100) for _ in range(500)], "d": []}
    rows = [(k, x) for k, v in data.items() for x in [*v, None]]
    got = {r.k: r for r in describe(spark.createDataFrame(rows, "k string, x double").repartition(7), ["k"], "x").collect()}
    for k, v in data.items():
        assert got[k].n == len(v)
        if v:
            s = sorted(v)
            for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
                at = q * (len(s) - 1)
                low, high = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
                assert got[k][name] == pytest.approx(low + (high - low) * (at - int(at)))
            assert (got[k].min, got[k].max) == (s[0], s[-1])
        else:
            assert got[k].q50 is None and got[k].mean is None


def test_replay_modes_and_counters(spark):
    _, feed = random_feed(spark, 120)
    recorded = replay(feed, mode="priority_purge", depth_k=2)
    wide = recorded.select("symbol", "trade_date", "seq", "ts_ns", *[F.col(f"{s}s")[j - 1]["px" if w == "px" else "sz"].cast("bigint" if w == "px" else "int").alias(f"{s}_{w}_{j}") for j in (1, 2) for s in ("ask", "bid") for w in ("px", "sz")])
    v = {(r["mode"], r.symbol): r for r in validate(feed, wide, 2).collect()}
    assert len(v) == 6 and all(v[MODES[2], s].n_exact == v[MODES[2], s].n_rows > 100 for s in "AB")
    st = replay_stats(feed, wide, 2, "snapshot_resync", 1, True).collect()
    assert all(r.messages == r.resync_rows == (feed.where(F.col("symbol") == r.symbol).count() - 1) for r in st)
    with pytest.raises(ValueError):
        replay(feed, mode="other")
    seq = wide.where("symbol = 'A' AND ask_sz_1 > 0").orderBy(F.desc("seq")).first().seq
    rows = explain_row(feed, wide, "A", "d", seq, levels=2).collect()
    assert rows and all((r.rebuilt_px, r.rebuilt_sz, r.seq) == (r.recorded_px, r.recorded_sz, seq) for r in rows)
