"""The data-processing queries p1, p2, p4, p5, p6 with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import diff_copies, snapshot_changes
from ..operators.changefeed import apply_feed
from ..operators.grid import regular_grid
from ..operators.lifecycle import operations
from ..operators.orphans import ForeignKey, orphan_cascade, stale_references
from ..plans.scratch import table
from ..schema import NO_ASK, NO_BID, depth_columns, real_price, real_size

MINUTE = 60_000_000_000
ORDER = ["symbol", "trade_date", "order_id"]


def minute_grid(spark: SparkSession, d: str) -> DataFrame:
    usable = real_price("best_bid").isNotNull() & real_price("best_ask").isNotNull()
    return regular_grid(
        table(spark, d, "features"), table(spark, d, "sessions"), ["symbol", "trade_date"], "ts_ns", "seq",
        ["best_bid", "best_ask"], ["ofi_e"], usable, "open_ns", "close_ns", MINUTE,
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return minute_grid(spark, d).where("n_readings = 0").select("symbol", "trade_date", "period_ns")


def p1_series(spark: SparkSession, d: str) -> DataFrame:
    return minute_grid(spark, d).select(
        "symbol", "trade_date", "period_ns", "n_readings", "cover_ns", F.round("best_bid_twa", 2).alias("bid_twa"),
        F.round("best_ask_twa", 2).alias("ask_twa"), "ofi_e_sum", "status",
    )


def _bounds(spark: SparkSession, d: str) -> tuple[int, int]:
    """The greatest seq and the greatest size of all messages, 0 without any."""
    last, largest = table(spark, d, "messages").agg(F.max("seq"), F.max("size")).first()
    return last or 0, largest or 0


def _stale(spark: SparkSession, d: str) -> DataFrame:
    return stale_references(operations(table(spark, d, "messages")), ORDER, "seq")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _stale(spark, d).select("symbol", "trade_date", "seq")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _stale(spark, d).groupBy("symbol", "trade_date", "kind").agg(F.count(F.lit(1)).alias("n"))


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """Orphans in the graph sessions <- fills <- equity_samples, per table and date: sessions with features only are the parents."""
    featured = table(spark, d, "features").select("symbol", "trade_date").distinct()
    tables = {"features": featured, "fills": table(spark, d, "fills"), "equity_samples": table(spark, d, "equity_samples")}
    fks = [
        ForeignKey("fills", ("symbol", "trade_date"), "features", ("symbol", "trade_date")),
        ForeignKey("equity_samples", ("run_id",), "fills", ("run_id",)),
    ]
    found = orphan_cascade(tables, {"features": ["symbol"], "fills": ["fill_id", "trade_date"], "equity_samples": ["sample_id", "run_id"]}, fks)
    dates = table(spark, d, "fills").groupBy("run_id").agg(F.min("trade_date").alias("period"))  # a run belongs to one date
    samples = found["equity_samples"].join(dates, "run_id", "left")
    one = found["fills"].groupBy(F.lit("fills").alias("table_name"), F.col("trade_date").alias("period"), "kind")
    two = samples.groupBy(F.lit("equity_samples").alias("table_name"), F.coalesce("period", F.lit("unknown")).alias("period"), "kind")
    return one.agg(F.count(F.lit(1)).alias("n")).unionByName(two.agg(F.count(F.lit(1)).alias("n")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fields = {c: real_price(c) if "_px_" in c else real_size(c) for c in depth_columns(3)}
    return diff_copies(table(spark, d, "depth_primary"), table(spark, d, "depth_replica"), ["symbol", "trade_date", "seq"], fields, "only_primary", "only_replica")


SNAP_FIELDS = ("ask_px", "ask_sz", "bid_px", "bid_sz")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    fields = {c: real_price(c) if c.endswith("px") else real_size(c) for c in SNAP_FIELDS}
    return snapshot_changes(table(spark, d, "depth_snaps"), ["trade_date"], "snap_no", ["symbol", "lvl"], fields)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("symbol", "trade_date", "snap_no", "lvl", "change")


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("symbol", "trade_date", "snap_no", "lvl", F.explode("fields").alias("field"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return apply_feed(operations(table(spark, d, "messages")), ORDER, "seq", *_bounds(spark, d))


def p6_resumed(spark: SparkSession, d: str) -> DataFrame:
    """``p6_found`` in two goes: what rests after seq 199 is the base to which the rest of the feed is applied, both in trees of several levels."""
    ops, bounds = operations(table(spark, d, "messages")), _bounds(spark, d)
    base = apply_feed(ops.where("seq < 200"), ORDER, "seq", *bounds, chunk=64, fan_in=4)
    return apply_feed(ops.where("seq >= 200"), ORDER, "seq", *bounds, base, chunk=64, fan_in=4)


QUERIES = {f.__name__: f for f in (p1_found, p1_series, p2_found, p2_report, p2_tables, p4_found, p5_found, p5_fields, p6_found, p6_resumed)}

_USABLE = f"""SELECT DISTINCT symbol, trade_date, ts_ns, seq, best_bid, best_ask, ofi_e FROM features
  WHERE ts_ns IS NOT NULL AND best_bid NOT IN ({NO_ASK}, {NO_BID}) AND best_ask NOT IN ({NO_ASK}, {NO_BID})"""
_CELLS = f"""SELECT symbol, trade_date, open_ns, close_ns, unnest(range(open_ns, close_ns, {MINUTE})) AS period_ns FROM sessions
  SEMI JOIN features USING (symbol, trade_date)"""
_CHAIN = """m AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, seq ORDER BY recv_ts DESC NULLS LAST, type DESC, order_id DESC, size DESC) AS rn
  FROM messages WHERE seq IS NOT NULL),
r AS (SELECT symbol, trade_date, order_id, seq, type AS t, greatest(coalesce(size, 0), 0)::BIGINT AS q,
  row_number() OVER (PARTITION BY symbol, trade_date, order_id ORDER BY seq) AS k
  FROM m WHERE rn = 1 AND type BETWEEN 1 AND 4 AND order_id <> 0),
w AS (SELECT symbol, trade_date, order_id, k, seq, t <> 1 AS orphan, false AS prev, CASE WHEN t = 1 THEN q ELSE 0 END AS state FROM r WHERE k = 1
  UNION ALL
  SELECT r.symbol, r.trade_date, r.order_id, r.k, r.seq, w.state = 0 AND r.t <> 1, w.orphan,
    CASE WHEN r.t = 1 THEN CASE WHEN w.state > 0 THEN w.state ELSE r.q END WHEN r.t = 3 THEN 0 ELSE greatest(w.state - r.q, 0) END
  FROM w JOIN r ON r.symbol = w.symbol AND r.trade_date = w.trade_date AND r.order_id = w.order_id AND r.k = w.k + 1)"""


def _real(c: str, of: str = "") -> str:
    return f"nullif(nullif({of}{c}, {NO_ASK}), {NO_BID})" if "px" in c else f"coalesce({of}{c}, 0)"


def _p4() -> str:
    cols = depth_columns(3)
    side = lambda t: f"SELECT DISTINCT symbol, trade_date, seq, {', '.join(f'{_real(c)} AS {c}' for c in cols)} FROM {t}"
    fields = " UNION ALL ".join(f"SELECT symbol, trade_date, seq, '{c}' AS diff FROM a JOIN b USING (symbol, trade_date, seq) WHERE a.{c} IS DISTINCT FROM b.{c}" for c in cols)
    return f"""WITH a AS ({side("depth_primary")}), b AS ({side("depth_replica")}) {fields}
UNION ALL SELECT symbol, trade_date, seq, 'only_primary' FROM a ANTI JOIN b USING (symbol, trade_date, seq)
UNION ALL SELECT symbol, trade_date, seq, 'only_replica' FROM b ANTI JOIN a USING (symbol, trade_date, seq)"""


_SNAPS = f"""s AS (SELECT DISTINCT symbol, trade_date, snap_no, lvl, {', '.join(f'{_real(c)} AS {c}' for c in SNAP_FIELDS)} FROM depth_snaps),
n AS (SELECT trade_date, snap_no, lag(snap_no) OVER (PARTITION BY trade_date ORDER BY snap_no) AS prev FROM (SELECT DISTINCT trade_date, snap_no FROM s)),
a AS (SELECT s.* FROM s JOIN n USING (trade_date, snap_no) WHERE prev IS NOT NULL),
b AS (SELECT s.* REPLACE (n.snap_no AS snap_no) FROM s JOIN n ON s.trade_date = n.trade_date AND s.snap_no = n.prev)"""
_AB = "a JOIN b USING (symbol, trade_date, snap_no, lvl)"

ORACLES = {
    "p1_found": f"""WITH r AS ({_USABLE}), c AS ({_CELLS})
SELECT symbol, trade_date, period_ns FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.symbol = c.symbol AND r.trade_date = c.trade_date AND r.ts_ns // {MINUTE} * {MINUTE} = c.period_ns)""",
    "p1_series": f"""WITH r AS ({_USABLE}), c AS ({_CELLS}),
i AS (SELECT *, lead(ts_ns) OVER (PARTITION BY symbol, trade_date ORDER BY ts_ns, seq, best_bid, best_ask, ofi_e NULLS FIRST) AS nxt FROM r),
j AS (SELECT c.symbol, c.trade_date, period_ns, best_bid, best_ask, ofi_e, ts_ns >= period_ns AS inside,
    CASE WHEN ts_ns IS NOT NULL THEN greatest(least(coalesce(nxt, close_ns), close_ns, period_ns + {MINUTE}) - greatest(ts_ns, period_ns), 0) END AS held
  FROM c LEFT JOIN i ON i.symbol = c.symbol AND i.trade_date = c.trade_date AND ts_ns < period_ns + {MINUTE} AND (nxt IS NULL OR nxt >= period_ns))
SELECT symbol, trade_date, period_ns, count(*) FILTER (inside) AS n_readings, coalesce(sum(held), 0)::BIGINT AS cover_ns,
  CASE WHEN sum(held) > 0 THEN round(sum(best_bid::DOUBLE * held) / sum(held), 2) END AS bid_twa,
  CASE WHEN sum(held) > 0 THEN round(sum(best_ask::DOUBLE * held) / sum(held), 2) END AS ask_twa,
  coalesce(sum(ofi_e) FILTER (inside), 0)::BIGINT AS ofi_e_sum,
  CASE WHEN count(*) FILTER (inside) > 0 THEN 'observed' WHEN sum(held) > 0 THEN 'filled' ELSE 'empty' END AS status
FROM j GROUP BY symbol, trade_date, period_ns""",
    "p2_found": f"WITH RECURSIVE {_CHAIN} SELECT symbol, trade_date, seq FROM w WHERE orphan",
    "p2_report": f"""WITH RECURSIVE {_CHAIN} SELECT symbol, trade_date, CASE WHEN prev THEN 'inherited' ELSE 'direct' END AS kind, count(*) AS n
FROM w WHERE orphan GROUP BY ALL""",
    "p2_tables": """WITH f AS (SELECT DISTINCT fill_id, trade_date FROM fills ANTI JOIN features USING (symbol, trade_date)),
e AS (SELECT sample_id, coalesce(period, 'unknown') AS period, CASE WHEN run_id NOT IN (SELECT run_id FROM fills) THEN 'direct' ELSE 'inherited' END AS kind FROM
  (SELECT DISTINCT sample_id, run_id FROM equity_samples) LEFT JOIN (SELECT run_id, min(trade_date) AS period FROM fills GROUP BY run_id) USING (run_id) WHERE run_id NOT IN (SELECT run_id FROM fills) OR run_id IN (SELECT run_id FROM fills ANTI JOIN features USING (symbol, trade_date)))
SELECT 'fills' AS table_name, trade_date AS period, 'direct' AS kind, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT 'equity_samples', period, kind, count(*) FROM e GROUP BY ALL""",
    "p4_found": _p4(),
    "p5_found": f"""WITH {_SNAPS}
SELECT symbol, trade_date, snap_no, lvl, 'changed' AS change FROM {_AB} WHERE {" OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in SNAP_FIELDS)}
UNION ALL SELECT symbol, trade_date, snap_no, lvl, 'added' FROM a ANTI JOIN b USING (symbol, trade_date, snap_no, lvl)
UNION ALL SELECT symbol, trade_date, snap_no, lvl, 'removed' FROM b ANTI JOIN a USING (symbol, trade_date, snap_no, lvl)""",
    "p5_fields": f"WITH {_SNAPS} " + " UNION ALL ".join(f"SELECT symbol, trade_date, snap_no, lvl, '{c}' AS field FROM {_AB} WHERE a.{c} IS DISTINCT FROM b.{c}" for c in SNAP_FIELDS),
    "p6_found": f"""WITH RECURSIVE {_CHAIN},
z AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, order_id ORDER BY k DESC) AS last FROM w)
SELECT symbol, trade_date, order_id, state AS size_left FROM z WHERE last = 1 AND state > 0""",
}
ORACLES["p6_resumed"] = ORACLES["p6_found"]
