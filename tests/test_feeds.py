"""CSV pairs to Parquet and back; time parsing; live features equal the batch replay."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main, spec_of
from tidemark.functions.signals import SESSION
from tidemark.operators.backtest import Backtest, OfiStrategy, RunSpec
from tidemark.operators.book import Message
from tidemark.operators.replay import replay
from tidemark.sources import feeds
from tidemark.streaming.live import live_buckets, live_features, live_fills


def test_times(spark):
    df = spark.createDataFrame([("34200.017459617",), ("34200.1",), ("34201",), ("0.0000000019",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(feeds.parse_time(F.col("t"))).collect()] == [34200017459617, 34200100000000, 34201000000000, 1, None, None]


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for s in ("ABC", "X.Y"):
        (raw / f"{s}_2031-01-06_34200000_57600000_message_2.csv").write_text("34200.5,1,7,100,1000,1\n34200.5,1,8,50,1100,-1\n34201,4,7,30,1000,1\n")
        (raw / f"{s}_2031-01-06_34200000_57600000_orderbook_2.csv").write_text("9999999999,0,1000,100,9999999999,0,-9999999999,0\n1100,50,1000,100,9999999999,0,-9999999999,0\n1100,50,1000,70,9999999999,0,-9999999999,0\n")
    (raw / "LONE_2031-01-06_34200000_57600000_message_2.csv").write_text("1,1,1,1,1,1\n")
    (raw / "EMPTY_2031-01-07_34200000_57600000_message_2.csv").write_text("")
    (raw / "EMPTY_2031-01-07_34200000_57600000_orderbook_2.csv").write_text("")
    (raw / "notes.csv").write_text("a,b\n")
    return tmp_path


def test_conversion(spark, folder):
    days = feeds.find_days(spark, str(folder / "raw"))
    assert sorted(r.symbol for r in days.collect()) == ["ABC", "X.Y"]
    with pytest.raises(FileNotFoundError):
        feeds.find_day(spark, str(folder / "raw"), "LONE", "2031-01-06", 2)
    out = str(folder / "out")
    feeds.convert(days, out, 2)
    m = feeds.load_messages(spark, out, 2)
    assert [tuple(r) for r in m.where("symbol = 'ABC'").select("seq", "ts_ns", "type", "order_id", "size", "price", "direction").orderBy("seq").collect()] == [
        (0, 34200500000000, 1, 7, 100, 1000, 1), (1, 34200500000000, 1, 8, 50, 1100, -1), (2, 34201000000000, 4, 7, 30, 1000, 1),
    ]
    assert sorted((r.side, r.px, r.sz) for r in feeds.load_seeds(spark, out, 2).where("symbol = 'ABC'").collect()) == [(1, 1000, 100)]
    feeds.convert(feeds.find_day(spark, str(folder / "raw"), "ABC", "2031-01-06", 2), out, 2)  # exists: kept
    assert feeds.load_messages(spark, out, 2).count() == 6
    got = replay(m, feeds.load_depth(spark, out, 2), 2, "snapshot_resync", 1, 0, True).where("symbol = 'X.Y'").orderBy("seq").collect()
    assert [(r.best_bid, r.bid_qty, r.best_ask, r.ofi_e, r.trade_qty) for r in got] == [(1000, 100, 9999999999, 0, 0), (1000, 100, 1100, 0, 0), (1000, 70, 1100, -30, 30)]
    feeds.save(m, str(folder / "m.csv"))
    assert spark.read.option("header", True).csv(str(folder / "m.csv")).count() == 6


def test_conversion_of_a_folder_that_grows(spark, folder):
    raw, out = folder / "raw", str(folder / "grown")
    stored = lambda what: sorted((r.symbol, r.trade_date, r["count"]) for r in what(spark, out, 2).groupBy("symbol", "trade_date").count().collect())
    sizes = lambda: {(r.symbol, r.trade_date): r.n for r in feeds.load_messages(spark, out, 2).groupBy("symbol", "trade_date").agg(F.sum("size").alias("n")).collect()}
    feeds.convert(feeds.find_days(spark, str(raw)), out, 2)
    (raw / "ABC_2031-01-07_34200000_57600000_message_2.csv").write_text("34200.5,1,7,11,1000,1\n")
    (raw / "ABC_2031-01-07_34200000_57600000_orderbook_2.csv").write_text("9999999999,0,1000,11,9999999999,0,-9999999999,0\n")
    (raw / "ABC_2031-01-08_34200000_57600000_message_1.csv").write_text("34200.5,1,7,13,1000,1\n")
    (raw / "ABC_2031-01-08_34200000_57600000_orderbook_1.csv").write_text("9999999999,0,1000,13\n")
    (raw / "X.Y_2031-01-06_34200000_57600000_message_2.csv").write_text("34200.5,1,7,5,1000,1\n34200.5,1,8,50,1100,-1\n34201,4,7,30,1000,1\n")
    days = [("ABC", "2031-01-06", 3), ("ABC", "2031-01-07", 1), ("X.Y", "2031-01-06", 3)]
    for _ in range(2):
        feeds.convert(feeds.find_days(spark, str(raw)), out, 2)  # the new day comes, once; what is stored stays
        assert stored(feeds.load_messages) == stored(feeds.load_depth) == days
        assert sizes() == {("ABC", "2031-01-06"): 180, ("ABC", "2031-01-07"): 11, ("X.Y", "2031-01-06"): 180}
    feeds.convert(feeds.find_day(spark, str(raw), "X.Y", "2031-01-06", 2), out, 2, force=True)
    assert stored(feeds.load_messages) == stored(feeds.load_depth) == days
    assert sizes() == {("ABC", "2031-01-06"): 180, ("ABC", "2031-01-07"): 11, ("X.Y", "2031-01-06"): 85}


def test_live_equals_batch(spark, tmp_path):
    rows = [(s, "2031-01-06", i, 1_000_000_000 * i, 1 if i % 3 else 4, i // 3, 10 + i, 1000 + 100 * (i % 2), 1 if i % 2 == 0 else -1) for s in ("A", "B") for i in range(30)]
    schema = "symbol string, trade_date string, seq bigint, ts_ns bigint, type int, order_id bigint, size bigint, price bigint, direction int"
    src = str(tmp_path / "src")
    for part in (rows[:20] + rows[30:45], rows[20:30] + rows[45:] + rows[:5]):  # the second batch repeats old rows
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    q = live_features(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = replay(spark.createDataFrame(rows, schema))
    cols = [*SESSION, "seq", "best_bid", "bid_qty", "best_ask", "ask_qty", "ofi_e", "trade_qty", "trade_side"]
    live = spark.table("live")
    assert live.count() == 60 and live.select(cols).exceptAll(batch.select(cols)).count() == 0
    feats = str(tmp_path / "feats")
    live.write.parquet(feats)
    b = live_buckets(spark.readStream.schema(live.schema).parquet(feats)).writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    b.awaitTermination(120)
    done = spark.table("buckets").collect()
    assert all(r.n_events == 10 for r in done)


def test_command_line(spark, folder, capsys):
    main(["store", str(folder / "raw"), str(folder / "data"), "--levels", "2"])
    main(["check", str(folder / "data"), "--levels", "2", "--to", str(folder / "v.csv")])
    v = spark.read.option("header", True).csv(str(folder / "v.csv")).collect()
    assert len(v) == 6 and all(r.n_exact == r.n_rows == "3" for r in v if r["mode"] == "snapshot_resync")
    (folder / "specs.json").write_text('[{"entry_z": 3, "passive_entry": false}]')
    main(["simulate", str(folder / "data"), "--levels", "2", "--symbols", "ABC", "--spec", "latency_us=0", "--spec", "label=slow latency_us=900", "--specs", str(folder / "specs.json")])
    out = capsys.readouterr().out
    assert "total_pnl" in out and all(x in out for x in ("latency_us=0.0", "slow", "entry_z=3.0 passive_entry=False"))
    with pytest.raises(ValueError, match="no such field"):
        spec_of({"nothing": "1"})


def test_live_fills_equal_a_run(spark, tmp_path):
    rows, spec = [], RunSpec(start_index=0, start_ts=0, end_ts=10**12, window_events=2, zscore_window=4, entry_z=0.5, passive_entry=False, cooldown_ms=0, latency_us=0, max_hold_s=5)
    for i in range(120):
        side = 1 if (i // 7) % 2 else -1
        rows.append(("A", "2031-01-06", i, i * 10**9, 1, i + 1, 10 + i % 5, 1000 - 100 * side * (1 + i % 3), side))
    schema = "symbol string, trade_date string, seq bigint, ts_ns bigint, type int, order_id bigint, size bigint, price bigint, direction int"
    src = str(tmp_path / "src")
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    q = live_fills(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), spec).writeStream.format("memory").queryName("fills").option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination(120)
    run = Backtest(spec, OfiStrategy(spec))
    for _, _, _, ts, kind, order_id, size, price, side in rows:
        run.message(Message(ts, kind, order_id, size, price, side))
    got = sorted((r.ts, r.order_id, r.price, r.qty) for r in spark.table("fills").collect())
    assert got == sorted((f.ts, f.order_id, f.price, f.qty) for f in run.fills) and len(got) > 2


def test_an_idle_session_is_finished_and_forgotten(spark, tmp_path):
    spec = RunSpec(start_index=0, start_ts=0, end_ts=10**15, window_events=2, zscore_window=4, entry_z=0.1, passive_entry=False, cooldown_ms=0, latency_us=0, max_hold_s=10**6, exit_z=-100)
    rows = [("A", "d", 0, 1, 1, 1, 500, 10_000, 1), ("A", "d", 1, 2, 1, 2, 500, 10_100, -1)] + [("A", "d", i, 1000 * i, 1, 10 + i, 10 + 7 * i, 10_000, 1) for i in range(2, 12)]
    schema = "symbol string, trade_date string, seq bigint, ts_ns bigint, type int, order_id bigint, size int, price bigint, direction int"
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    q = live_fills(spark.readStream.schema(schema).parquet(folder), spec, idle_ms=1500).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and (not (got := spark.table("idle").collect()) or sum(f.side * f.qty for f in got)):
            time.sleep(1)
    finally:
        q.stop()
    assert got and sum(f.side * f.qty for f in got) == 0  # bought while messages came, sold when none did
