"""Queries of the engine's own operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import research
from ..functions.metrics import curve_metrics, describe, fee, fill_totals
from ..functions.signals import SESSION, bucket_ofi, clean_features, event_signals, mid_price, queue_imbalance, spread_ticks
from ..operators import backtest as bt
from ..operators import depth as dp
from ..operators import orders
from ..operators import replay as rp
from ..operators.asof import asof_join
from ..operators.lifecycle import operations
from ..operators.markouts import adverse_selection, markouts
from ..operators.orphans import stale_references
from ..plans.scratch import table
from ..schema import NO_ASK, NO_BID
from . import book_sql

QUERIES: dict = {}
ORACLES: dict = {}
ROUND = 6


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return rp.feed(table(spark, d, "messages"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return clean_features(table(spark, d, "features"))


def _depth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "depth_primary")


_FEED = """f AS (SELECT symbol, trade_date, seq, ts_ns, coalesce(type, 0)::INT AS type, coalesce(order_id, 0) AS order_id, coalesce(size, 0) AS size, coalesce(price, 0) AS price, coalesce(direction, 0) AS direction
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, seq ORDER BY recv_ts DESC NULLS LAST, type DESC NULLS LAST, order_id DESC NULLS LAST, size DESC NULLS LAST,
    price DESC NULLS LAST, direction DESC NULLS LAST, ts_ns DESC NULLS LAST) AS rn FROM messages WHERE seq IS NOT NULL) WHERE rn = 1)"""
_LIFE = f"""{_FEED},
r AS (SELECT *, greatest(size, 0)::BIGINT AS q, CASE WHEN direction >= 0 THEN 1 ELSE -1 END AS s, row_number() OVER (PARTITION BY symbol, trade_date, order_id ORDER BY seq) AS k
  FROM f WHERE type BETWEEN 1 AND 4 AND order_id <> 0 AND NOT (type = 1 AND (size <= 0 OR price <= 0))),
w AS (SELECT symbol, trade_date, order_id, k, seq, type, CASE WHEN type = 1 THEN q ELSE 0 END AS rest, CASE WHEN type = 1 THEN price ELSE 0 END AS px, CASE WHEN type = 1 THEN s ELSE 0 END AS side,
    CASE WHEN type = 1 THEN seq ELSE 0 END AS born, 0::BIGINT AS taken, type = 1 AS opened, false AS dup, type <> 1 AS unknown FROM r WHERE k = 1
  UNION ALL
  SELECT r.symbol, r.trade_date, r.order_id, r.k, r.seq, r.type,
    CASE WHEN r.type = 1 THEN CASE WHEN w.rest > 0 THEN w.rest ELSE r.q END WHEN r.type = 3 THEN 0 ELSE greatest(w.rest - r.q, 0) END,
    CASE WHEN r.type = 1 AND w.rest = 0 THEN r.price ELSE w.px END, CASE WHEN r.type = 1 AND w.rest = 0 THEN r.s ELSE w.side END, CASE WHEN r.type = 1 AND w.rest = 0 THEN r.seq ELSE w.born END,
    CASE WHEN r.type = 1 THEN 0 WHEN r.type = 3 THEN w.rest ELSE least(w.rest, r.q) END, r.type = 1 AND w.rest = 0, r.type = 1 AND w.rest > 0, r.type <> 1 AND w.rest = 0
  FROM w JOIN r ON r.symbol = w.symbol AND r.trade_date = w.trade_date AND r.order_id = w.order_id AND r.k = w.k + 1),
e AS (SELECT *, CASE WHEN opened THEN rest ELSE -taken END AS delta FROM w WHERE opened OR taken > 0),
v AS (SELECT symbol, trade_date, side, px, seq, delta, (sum(delta) OVER (PARTITION BY symbol, trade_date, side, px ORDER BY seq))::BIGINT AS qty,
  lead(seq) OVER (PARTITION BY symbol, trade_date, side, px ORDER BY seq) AS nxt FROM e),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, order_id ORDER BY k DESC) AS last FROM w) WHERE last = 1 AND rest > 0)"""
_FEATURES = """d AS (SELECT DISTINCT symbol, trade_date, seq, ts_ns, type, best_bid, best_ask, bid_qty, ask_qty, coalesce(ofi_e, 0) AS ofi_e, trade_qty, trade_side, mid, spread_ticks
  FROM features WHERE ts_ns IS NOT NULL AND seq IS NOT NULL)"""


# --- decoding and histograms
@query(f"""WITH {_FEED} SELECT symbol, trade_date, seq, CASE WHEN direction >= 0 THEN 1 ELSE -1 END AS side,
  NOT (type = 1 AND (size <= 0 OR price <= 0)) AND type BETWEEN 1 AND 7 AS valid, CASE WHEN type IN (4, 5) THEN size ELSE 0 END AS trade_qty,
  CASE WHEN type IN (4, 5) THEN CASE WHEN direction >= 0 THEN 1 ELSE -1 END ELSE 0 END AS trade_side FROM f""")
def messages_typed(spark: SparkSession, d: str) -> DataFrame:
    side, trade = F.when(F.col("direction") >= 0, 1).otherwise(-1), F.col("type").isin(4, 5)
    valid = ~((F.col("type") == 1) & ((F.col("size") <= 0) | (F.col("price") <= 0))) & F.col("type").between(1, 7)
    return _feed(spark, d).select(*SESSION, "seq", side.alias("side"), valid.alias("valid"), F.when(trade, F.col("size")).otherwise(0).alias("trade_qty"), F.when(trade, side).otherwise(0).alias("trade_side"))


@query("SELECT symbol, type, count(*) AS n FROM messages GROUP BY ALL")
def msg_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").groupBy("symbol", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT symbol, " + ", ".join(f"count(*) FILTER (type = {i}) AS n_{i}" for i in range(1, 8)) + " FROM messages GROUP BY symbol")
def msg_type_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "messages").groupBy("symbol").pivot("type", list(range(1, 8))).count()
    return p.select("symbol", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"n_{i}") for i in range(1, 8)])


@query(f"""WITH {_FEED} SELECT symbol, trade_date, type, CASE WHEN direction >= 0 THEN 1 ELSE -1 END AS side, count(*) AS n_trades, sum(size)::BIGINT AS qty, sum(size * price)::BIGINT AS notional
FROM f WHERE type IN (4, 5) GROUP BY ALL""")
def trade_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _feed(spark, d).where("type IN (4, 5)")
    return t.groupBy(*SESSION, "type", F.when(F.col("direction") >= 0, 1).otherwise(-1).alias("side")).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("size").alias("qty"), F.sum(F.col("size") * F.col("price")).alias("notional")
    )


_DESCRIBED = ("spread_ticks", "bid_qty", "ask_qty", "ofi_e")


@query(f"WITH {_FEATURES} " + " UNION ALL ".join(f"""SELECT symbol, '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
  round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM d GROUP BY symbol""" for c in _DESCRIBED))
def describe_features(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in _DESCRIBED])
    long = _features(spark, d).select("symbol", F.explode(cells).alias("c")).select("symbol", "c.*")
    return describe(long, ["symbol", "name"], "x").select("symbol", "name", "n", *[F.round(c, ROUND).alias(c) for c in ("mean", "std")], "min", *[F.round(c, ROUND).alias(c) for c in ("q25", "q50", "q75")], "max")


# --- orders and levels, in sets
@query(f"""WITH RECURSIVE {_LIFE} SELECT symbol, trade_date, order_id, count(*) FILTER (opened) AS adds, count(*) FILTER (dup) AS dup, coalesce(sum(taken) FILTER (type IN (2, 3)), 0)::BIGINT AS cancelled,
  coalesce(sum(taken) FILTER (type = 4), 0)::BIGINT AS executed, count(*) FILTER (unknown) AS unknown, arg_max(rest, k) AS remaining FROM w GROUP BY symbol, trade_date, order_id""")
def order_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return orders.lifecycle(_feed(spark, d))


@query(f"WITH RECURSIVE {_LIFE} SELECT symbol, trade_date, side, px, seq, delta, qty FROM v")
def level_running_qty(spark: SparkSession, d: str) -> DataFrame:
    return orders.level_changes(_feed(spark, d))


@query(f"""WITH RECURSIVE {_LIFE} SELECT symbol, trade_date, side, px, sum(rest)::BIGINT AS qty, count(*) AS n_orders,
  (row_number() OVER (PARTITION BY symbol, trade_date, side ORDER BY px * side DESC))::INT AS level FROM z GROUP BY symbol, trade_date, side, px""")
def closing_depth(spark: SparkSession, d: str) -> DataFrame:
    return orders.closing_levels(_feed(spark, d))


@query(f"""WITH RECURSIVE {_LIFE} SELECT symbol, trade_date, order_id, side, px, rest AS remaining,
  coalesce(sum(rest) OVER (PARTITION BY symbol, trade_date, side, px ORDER BY born ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS queue_ahead FROM z""")
def queue_ahead(spark: SparkSession, d: str) -> DataFrame:
    return orders.queue_positions(_feed(spark, d))


@query(f"""WITH RECURSIVE {_LIFE} SELECT symbol, trade_date, type, count(*) FILTER (unknown) AS n_unknown, count(*) AS n, round(count(*) FILTER (unknown) / count(*), 6) AS rate
FROM w WHERE type <> 1 GROUP BY symbol, trade_date, type""")
def unknown_id_rate(spark: SparkSession, d: str) -> DataFrame:
    refs = _feed(spark, d).where("type IN (2, 3, 4) AND order_id <> 0").select(*SESSION, "seq", "type")
    stale = stale_references(operations(table(spark, d, "messages")), [*SESSION, "order_id"], "seq").select(*SESSION, "seq", F.lit(1).alias("stale"))
    n = F.count("stale")
    return refs.join(stale, [*SESSION, "seq"], "left").groupBy(*SESSION, "type").agg(n.alias("n_unknown"), F.count(F.lit(1)).alias("n"), F.round(n / F.count(F.lit(1)), ROUND).alias("rate"))


# --- replays
_SIDE = lambda s, best: f"(SELECT f.symbol, f.trade_date, f.seq, arg_{best}(v.qty, v.px) AS q, {best}(v.px) AS p FROM f JOIN v ON v.symbol = f.symbol AND v.trade_date = f.trade_date AND v.side = {s} AND v.seq <= f.seq AND (v.nxt IS NULL OR v.nxt > f.seq) AND v.qty > 0 GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_LIFE}, l AS (SELECT f.*, coalesce(b.p, {NO_BID}) AS pb, coalesce(b.q, 0) AS qb, coalesce(a.p, {NO_ASK}) AS pa, coalesce(a.q, 0) AS qa
  FROM f LEFT JOIN {_SIDE(1, "max")} b USING (symbol, trade_date, seq) LEFT JOIN {_SIDE(-1, "min")} a USING (symbol, trade_date, seq)),
o AS (SELECT *, lag(pb, 1, {NO_BID}) OVER u AS pb0, lag(qb, 1, 0) OVER u AS qb0, lag(pa, 1, {NO_ASK}) OVER u AS pa0, lag(qa, 1, 0) OVER u AS qa0 FROM l WINDOW u AS (PARTITION BY symbol, trade_date ORDER BY seq))
SELECT symbol, trade_date, seq, type::INT AS type, pb AS best_bid, qb AS bid_qty, pa AS best_ask, qa AS ask_qty,
  (CASE WHEN pb = {NO_BID} OR pb0 = {NO_BID} OR pa = {NO_ASK} OR pa0 = {NO_ASK} THEN 0 ELSE CASE WHEN pb >= pb0 THEN qb ELSE 0 END - CASE WHEN pb <= pb0 THEN qb0 ELSE 0 END
    - CASE WHEN pa <= pa0 THEN qa ELSE 0 END + CASE WHEN pa >= pa0 THEN qa0 ELSE 0 END END)::BIGINT AS ofi_e,
  (CASE WHEN type IN (4, 5) THEN size ELSE 0 END)::BIGINT AS trade_qty, (CASE WHEN type NOT IN (4, 5) THEN 0 WHEN direction >= 0 THEN 1 ELSE -1 END)::BIGINT AS trade_side FROM o""")
def replay_message_only(spark: SparkSession, d: str) -> DataFrame:
    return rp.replay(_feed(spark, d)).drop("ts_ns")


@query(ORACLES["replay_message_only"])
def replay_in_sets(spark: SparkSession, d: str) -> DataFrame:
    """``replay_message_only`` without a scan of sessions: for sessions that are too long for a task."""
    return orders.message_features(_feed(spark, d)).drop("ts_ns")


_SIGN = "CASE WHEN m.direction >= 0 THEN 1 ELSE -1 END"
_TOP = lambda s, order: f"list_sort(list_distinct([o.p FOR o IN book IF o.s = {s}]), '{order}')"
_SUM = lambda s, j, x: f"coalesce(list_sum([o.q FOR o IN book IF o.s = {s} AND o.p = {x}[{j}]]), 0)::BIGINT"


# a book is a list of orders, carried from message to message
_PURGED = f"""{_FEED}, m AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY seq) AS k FROM f),
b AS (SELECT DISTINCT symbol, trade_date, 0::BIGINT AS k, []::STRUCT(id BIGINT, s INT, p BIGINT, q BIGINT)[] AS book FROM f
  UNION ALL
  SELECT symbol, trade_date, k, CASE
      WHEN type = 1 AND size > 0 AND price > 0 THEN CASE WHEN order_id IN [o.id FOR o IN kept] THEN kept ELSE list_append(kept, {{'id': order_id, 's': side, 'p': price, 'q': size::BIGINT}}) END
      WHEN type IN (2, 4) THEN [{{'id': o.id, 's': o.s, 'p': o.p, 'q': CASE WHEN o.id = order_id THEN o.q - size ELSE o.q END}} FOR o IN kept IF o.id <> order_id OR o.q > size]
      WHEN type = 3 THEN [o FOR o IN kept IF o.id <> order_id] ELSE kept END
  FROM (SELECT m.*, {_SIGN} AS side, CASE
      WHEN m.type = 1 AND m.size > 0 AND m.price > 0 THEN [o FOR o IN b.book IF o.s = {_SIGN} OR (o.p - m.price) * ({_SIGN}) > 0]
      WHEN m.type = 4 OR m.type = 5 AND m.price > 0 THEN [o FOR o IN b.book IF o.s <> {_SIGN} OR (o.p - m.price) * ({_SIGN}) <= 0] ELSE b.book END AS kept
    FROM b JOIN m ON m.symbol = b.symbol AND m.trade_date = b.trade_date AND m.k = b.k + 1)),
t AS (SELECT symbol, trade_date, k, book, {_TOP(1, "DESC")} AS bp, {_TOP(-1, "ASC")} AS ap FROM b WHERE k > 0),
l AS (SELECT m.symbol, m.trade_date, m.seq, m.type, m.size, m.direction, {", ".join(f"coalesce(bp[{j}], {NO_BID}) AS bid_px_{j}, {_SUM(1, j, 'bp')} AS bid_sz_{j}, coalesce(ap[{j}], {NO_ASK}) AS ask_px_{j}, {_SUM(-1, j, 'ap')} AS ask_sz_{j}" for j in (1, 2, 3))}
  FROM t JOIN m USING (symbol, trade_date, k)),
o AS (SELECT *, bid_px_1 AS pb, bid_sz_1 AS qb, ask_px_1 AS pa, ask_sz_1 AS qa, lag(bid_px_1, 1, {NO_BID}) OVER u AS pb0, lag(bid_sz_1, 1, 0) OVER u AS qb0, lag(ask_px_1, 1, {NO_ASK}) OVER u AS pa0, lag(ask_sz_1, 1, 0) OVER u AS qa0
  FROM l WINDOW u AS (PARTITION BY symbol, trade_date ORDER BY seq))"""
_FLOW = f"""(CASE WHEN pb = {NO_BID} OR pb0 = {NO_BID} OR pa = {NO_ASK} OR pa0 = {NO_ASK} THEN 0 ELSE CASE WHEN pb >= pb0 THEN qb ELSE 0 END - CASE WHEN pb <= pb0 THEN qb0 ELSE 0 END
    - CASE WHEN pa <= pa0 THEN qa ELSE 0 END + CASE WHEN pa >= pa0 THEN qa0 ELSE 0 END END)::BIGINT AS ofi_e"""


@query(f"WITH RECURSIVE {_PURGED} SELECT symbol, trade_date, seq, type::INT AS type, {_FLOW}, {', '.join(f'{s}_{w}_{j}' for j in (1, 2, 3) for s in ('ask', 'bid') for w in ('px', 'sz'))} FROM o")
def replay_priority_purge(spark: SparkSession, d: str) -> DataFrame:
    r = rp.replay_wide(_feed(spark, d), None, 3, "priority_purge", 0, 3, False)
    return r.select(*SESSION, "seq", "type", "ofi_e", *dp.depth_columns(3))


@query(book_sql.stats_sql(_FEED))
def replay_resync_stats(spark: SparkSession, d: str) -> DataFrame:
    return rp.replay_stats(_feed(spark, d), _depth(spark, d), 3, "snapshot_resync", 1, True)


@query(book_sql.validate_sql(_FEED, list(rp.MODES)))
def validate_modes(spark: SparkSession, d: str) -> DataFrame:
    return rp.validate(_feed(spark, d), _depth(spark, d))


# --- depth
_LONG = " UNION ALL ".join(f"SELECT symbol, trade_date, seq, {n} AS side, {j} AS level, {s}_px_{j} AS px, {s}_sz_{j} AS sz FROM depth_primary WHERE {s}_px_{j} NOT IN ({NO_ASK}, {NO_BID}) AND {s}_sz_{j} > 0" for s, n in (("ask", -1), ("bid", 1)) for j in (1, 2, 3))


@query(f"SELECT * FROM ({_LONG})")
def depth_levels(spark: SparkSession, d: str) -> DataFrame:
    return dp.long_levels(_depth(spark, d), 3)


@query(f"""SELECT DISTINCT symbol, trade_date, side, px, sz FROM ({_LONG}) l SEMI JOIN (SELECT symbol, trade_date, min(seq) AS seq FROM depth_primary GROUP BY ALL) USING (symbol, trade_date, seq)""")
def seed_levels(spark: SparkSession, d: str) -> DataFrame:
    return dp.seeds(_depth(spark, d), 3)


_BID, _ASK = (f"nullif(nullif({s}_px_1, {NO_ASK}), {NO_BID})" for s in ("bid", "ask"))


@query(f"""WITH l AS (SELECT DISTINCT symbol, trade_date, seq, ts_ns, {_BID} AS pb, {_ASK} AS pa, CASE WHEN {_BID} IS NULL THEN 0 ELSE coalesce(bid_sz_1, 0) END AS qb, CASE WHEN {_ASK} IS NULL THEN 0 ELSE coalesce(ask_sz_1, 0) END AS qa FROM depth_primary),
o AS (SELECT *, lag(pb) OVER u AS pb0, lag(qb) OVER u AS qb0, lag(pa) OVER u AS pa0, lag(qa) OVER u AS qa0 FROM l WINDOW u AS (PARTITION BY symbol, trade_date ORDER BY seq, ts_ns))
SELECT symbol, trade_date, seq, coalesce(ts_ns, -1) AS ts_ns, coalesce(pb, {NO_BID}) AS best_bid, coalesce(pa, {NO_ASK}) AS best_ask, qb AS bid_qty, qa AS ask_qty,
  (CASE WHEN pb IS NULL OR pb0 IS NULL OR pa IS NULL OR pa0 IS NULL THEN 0 ELSE CASE WHEN pb >= pb0 THEN qb ELSE 0 END - CASE WHEN pb <= pb0 THEN qb0 ELSE 0 END
    - CASE WHEN pa <= pa0 THEN qa ELSE 0 END + CASE WHEN pa >= pa0 THEN qa0 ELSE 0 END END)::BIGINT AS ofi_e,
  round((pb + pa) / 2.0 / 10000.0, 6) AS mid, (pa - pb) / 100.0 AS spread_ticks FROM o""")
def depth_features(spark: SparkSession, d: str) -> DataFrame:
    return dp.features_from_depth(_depth(spark, d)).withColumns({"mid": F.round("mid", ROUND), "ts_ns": F.coalesce("ts_ns", F.lit(-1).cast("bigint"))})


def _walk_sql(side: str, qty: int) -> str:
    book = "ask" if side == "buy" else "bid"
    size = lambda j: f"(CASE WHEN {book}_px_{j} NOT IN ({NO_ASK}, {NO_BID}) AND {book}_sz_{j} > 0 THEN {book}_sz_{j} ELSE 0 END)"
    taken = {j: f"least({size(j)}, greatest({qty} - {' - '.join(['0', *[size(i) for i in range(1, j)]])}, 0))" for j in (1, 2, 3)}
    return f"SELECT symbol, trade_date, seq, '{side}' AS order_side, ({' + '.join(taken.values())})::BIGINT AS filled, ({' + '.join(f'coalesce({t} * {book}_px_{j}, 0)' for j, t in taken.items())})::BIGINT AS cost FROM depth_primary"


@query(_walk_sql("buy", 3000) + " UNION ALL " + _walk_sql("sell", 3000))
def depth_walk_cost(spark: SparkSession, d: str) -> DataFrame:
    one = lambda side, name: dp.walk(_depth(spark, d), 3, side, 3000).select(*SESSION, "seq", F.lit(name).alias("order_side"), "filled", "cost")
    return one(1, "buy").unionByName(one(-1, "sell"))


_N = lambda c, t: f"coalesce(nullif(nullif({t}.{c}, {NO_ASK}), {NO_BID}), 0)"
_OK = {j: " AND ".join(f"{_N(f'{s}_{w}_{j}', 'a')} = {_N(f'{s}_{w}_{j}', 'b')}" for s in ("ask", "bid") for w in ("px", "sz")) for j in (1, 2, 3)}


@query(f"""SELECT symbol, trade_date, count(*) AS n_rows, count(*) FILTER ({" AND ".join(_OK.values())}) AS n_exact, count(*) FILTER ({_OK[1]}) AS n_l1_exact,
  coalesce(min(seq) FILTER (NOT ({" AND ".join(_OK.values())})), -1) AS first_mismatch, {", ".join(f"count(*) FILTER (NOT ({s})) AS mismatch_{j}" for j, s in _OK.items())}
FROM (SELECT DISTINCT * EXCLUDE (ts_ns) FROM depth_primary) a JOIN (SELECT DISTINCT * EXCLUDE (ts_ns) FROM depth_replica) b USING (symbol, trade_date, seq) GROUP BY symbol, trade_date""")
def validate_depth(spark: SparkSession, d: str) -> DataFrame:
    return dp.compare_levels(_depth(spark, d), table(spark, d, "depth_replica"), 3).withColumn("first_mismatch", F.coalesce("first_mismatch", F.lit(-1).cast("bigint")))


# --- signals
@query(f"""WITH {_FEATURES} SELECT symbol, trade_date, seq, round((best_bid + best_ask) / 2.0 / 10000.0, 6) AS mid_calc, (best_ask - best_bid) / 100.0 AS spread_calc,
  round(CASE WHEN bid_qty + ask_qty > 0 THEN (bid_qty - ask_qty) / (bid_qty + ask_qty) END, 6) AS imbalance
FROM (SELECT * REPLACE (nullif(nullif(best_bid, {NO_ASK}), {NO_BID}) AS best_bid, nullif(nullif(best_ask, {NO_ASK}), {NO_BID}) AS best_ask) FROM d)""")
def mid_spread_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select(*SESSION, "seq", F.round(mid_price(), ROUND).alias("mid_calc"), spread_ticks().alias("spread_calc"), F.round(queue_imbalance(), ROUND).alias("imbalance"))


def _buckets(ns: int | str, keys: str = "symbol, trade_date", source: str = "d") -> str:
    return f"""g AS (SELECT {keys}, ts_ns // ({ns}) * ({ns}) AS bucket, sum(ofi_e)::BIGINT AS ofi, arg_max(mid, seq) AS mid_end, (avg(bid_qty) + avg(ask_qty)) / 2 AS depth, count(*) AS n_events, sum(trade_qty)::BIGINT AS trade_qty
  FROM {source} WHERE mid IS NOT NULL GROUP BY ALL),
h AS (SELECT *, (mid_end - lag(mid_end) OVER (PARTITION BY {keys} ORDER BY bucket)) * 100 AS dmid_ticks FROM g),
b AS (SELECT *, lead(dmid_ticks) OVER (PARTITION BY {keys} ORDER BY bucket) AS dmid_next_ticks FROM h)"""


_BUCKET_OUT = "SELECT symbol, trade_date, bucket, ofi, round(mid_end, 6) AS mid_end, round(depth, 6) AS depth, n_events, trade_qty, round(dmid_ticks, 6) AS dmid_ticks, round(dmid_next_ticks, 6) AS dmid_next_ticks FROM b WHERE dmid_ticks IS NOT NULL"


def _bucketed(spark: SparkSession, d: str, ns: int) -> DataFrame:
    b = bucket_ofi(_features(spark, d), ns)
    return b.withColumns({c: F.round(c, ROUND) for c in ("mid_end", "depth", "dmid_ticks", "dmid_next_ticks")})


@query(f"WITH {_FEATURES}, {_buckets(60_000_000_000)} {_BUCKET_OUT}")
def bucket_ofi_60s(spark: SparkSession, d: str) -> DataFrame:
    return _bucketed(spark, d, 60_000_000_000)


@query(f"WITH {_FEATURES}, {_buckets(10_000_000_000)} {_BUCKET_OUT}")
def bucket_ofi_10s(spark: SparkSession, d: str) -> DataFrame:
    return _bucketed(spark, d, 10_000_000_000)


_W = lambda n: f"OVER (PARTITION BY symbol, trade_date ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_POS = "row_number() OVER (PARTITION BY symbol, trade_date ORDER BY seq)"
_LEAD = lambda h: f"(lead(mid, {h}) OVER (PARTITION BY symbol, trade_date ORDER BY seq) - mid) * 100"


@query(f"WITH {_FEATURES} SELECT symbol, trade_date, seq, (sum(ofi_e) {_W(50)})::BIGINT AS ofi_w50 FROM d QUALIFY {_POS} >= 50")
def rolling_ofi_50(spark: SparkSession, d: str) -> DataFrame:
    return event_signals(_features(spark, d), rolling=[50]).where("ofi_w50 IS NOT NULL").select(*SESSION, "seq", "ofi_w50")


@query(f"WITH {_FEATURES} SELECT symbol, trade_date, seq, round({_LEAD(10)}, 6) AS fwd_10 FROM d")
def forward_mid_10(spark: SparkSession, d: str) -> DataFrame:
    return event_signals(_features(spark, d), forward=[10]).select(*SESSION, "seq", F.round("fwd_10", ROUND).alias("fwd_10"))


@query(f"""WITH {_FEATURES}, x AS (SELECT *, {_POS} AS pos, (sum(ofi_e) {_W(20)})::DOUBLE AS w FROM d),
y AS (SELECT *, sum(w) {_W(100)} / 100 AS m, sum(w * w) {_W(100)} / 100 AS s FROM x)
SELECT symbol, trade_date, seq, round(CASE WHEN pos >= 100 AND s - m * m >= 1e-12 THEN (w - m) / sqrt(s - m * m) ELSE 0 END, 6) AS z FROM y""")
def ofi_zscore(spark: SparkSession, d: str) -> DataFrame:
    return event_signals(_features(spark, d), zscores=[(20, 100)]).select(*SESSION, "seq", F.round("z_20_100", ROUND).alias("z"))


# --- research
def _regression_sql(keys: str, extra: str = "") -> str:
    on = keys.replace(" ", "").split(",")
    using = ", ".join(on)
    lags = ", ".join(f"u * lag(u, {k}) OVER (PARTITION BY {keys} ORDER BY bucket) AS c{k}" for k in range(1, 6))
    s = "sum(u * u)" + "".join(f" + 2.0 * (1 - {k} / 6.0) * coalesce(sum(c{k}), 0)" for k in range(1, 6))
    return f"""p AS (SELECT {keys}, bucket, ofi::DOUBLE AS x, dmid_ticks AS y, depth FROM b WHERE dmid_ticks IS NOT NULL),
m AS (SELECT {keys}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(depth) AS mean_depth FROM p GROUP BY ALL),
c AS (SELECT *, x - mx AS dx, y - my AS dy FROM p JOIN m USING ({using})),
t AS (SELECT {keys}, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, sum(dy * dy) AS syy FROM c GROUP BY ALL),
k AS (SELECT c.*, sxx, syy, CASE WHEN sxx <> 0 THEN sxy / sxx END AS slope, dx * (dy - (CASE WHEN sxx <> 0 THEN sxy / sxx END) * dx) AS u, dy - (CASE WHEN sxx <> 0 THEN sxy / sxx END) * dx AS e FROM c JOIN t USING ({using})),
q AS (SELECT *, {lags} FROM k),
z AS (SELECT {keys}, n, mx, my, sxx, syy, slope, mean_depth, {s} AS s, sum(e * e) AS see FROM q GROUP BY ALL)
SELECT {keys}, n, round(slope, 9) AS slope, round(my - slope * mx, 6) AS intercept, round(CASE WHEN syy <> 0 THEN 1 - see / syy END, 6) AS r2, round(mean_depth, 6) AS mean_depth, round(slope * mean_depth, 6) AS slope_x_depth{extra} FROM z WHERE n >= 10"""


_T = ", round(CASE WHEN s > 0 AND sxx <> 0 THEN slope / (sqrt(s) / sxx) END, 4) AS t_hac, round(CASE WHEN see > 0 AND sxx <> 0 THEN slope / sqrt(see / n / sxx) END, 4) AS t_ols"


@query(f"WITH {_FEATURES}, {_buckets(60_000_000_000)}, {_regression_sql('symbol, trade_date', _T)}")
def ofi_regression(spark: SparkSession, d: str) -> DataFrame:
    r = research.ofi_regression(_features(spark, d), 60).where("n >= 10")
    places = {"slope": 9, "intercept": 6, "r2": 6, "mean_depth": 6, "slope_x_depth": 6, "t_hac": 4, "t_ols": 4}
    return r.select(*SESSION, "n", *[F.round(c, k).alias(c) for c, k in places.items()])


@query(f"""WITH {_FEATURES}, dd AS (SELECT d.*, bucket_s FROM d, (SELECT unnest([1, 5, 10, 30, 60]::BIGINT[]) AS bucket_s)),
{_buckets("bucket_s::BIGINT * 1000000000", "symbol, trade_date, bucket_s", "dd")}, {_regression_sql("symbol, trade_date, bucket_s")}""")
def bucket_sweep(spark: SparkSession, d: str) -> DataFrame:
    r = research.bucket_sweep(_features(spark, d)).where("n >= 10")
    places = {"slope": 9, "intercept": 6, "r2": 6, "mean_depth": 6, "slope_x_depth": 6}
    return r.select(*SESSION, "bucket_s", "n", *[F.round(c, k).alias(c) for c, k in places.items()])


_CORR = [(a, h) for a in ("ofi_w20", "ofi_w50", "ofi_w100", "queue_imbalance") for h in (10, 50, 200)]


@query(f"""WITH {_FEATURES}, s AS (SELECT symbol, trade_date, {", ".join(f"CASE WHEN {_POS} >= {w} THEN (sum(ofi_e) {_W(w)})::DOUBLE END AS ofi_w{w}" for w in (20, 50, 100))},
  CASE WHEN bid_qty + ask_qty > 0 THEN (bid_qty - ask_qty) / (bid_qty + ask_qty) END AS queue_imbalance, {", ".join(f"{_LEAD(h)} AS fwd_{h}" for h in (10, 50, 200))} FROM d)
""" + " UNION ALL ".join(f"""SELECT symbol, trade_date, '{a}' AS signal, {h} AS horizon_events, count(*) FILTER ({a} IS NOT NULL AND fwd_{h} IS NOT NULL) AS n,
  round(CASE WHEN max({a}) FILTER (fwd_{h} IS NOT NULL) > min({a}) FILTER (fwd_{h} IS NOT NULL) AND max(fwd_{h}) FILTER ({a} IS NOT NULL) > min(fwd_{h}) FILTER ({a} IS NOT NULL) THEN corr({a}, fwd_{h}) END, 4) + 0.0 AS corr
FROM s GROUP BY symbol, trade_date""" for a, h in _CORR))
def predictive_corr(spark: SparkSession, d: str) -> DataFrame:
    return research.predictive_table(_features(spark, d)).withColumn("corr", F.round("corr", 4))


# --- as-of, mark-outs, portfolios
_MIDS = "q AS (SELECT symbol, trade_date, ts_ns, arg_max(mid, seq) AS mid FROM d WHERE mid IS NOT NULL GROUP BY ALL), f AS (SELECT DISTINCT fill_id, run_id, symbol, trade_date, ts, side, price, passive FROM fills WHERE ts IS NOT NULL)"
_AT = lambda ns: f"SELECT f.*, q.mid FROM (SELECT *, ts + {ns} AS at FROM f) f ASOF LEFT JOIN q ON q.symbol = f.symbol AND q.trade_date = f.trade_date AND f.at >= q.ts_ns"


@query(f"WITH {_FEATURES}, {_MIDS} SELECT fill_id, round(mid, 6) AS mid FROM ({_AT(0)})")
def asof_fill_mid(spark: SparkSession, d: str) -> DataFrame:
    slim = table(spark, d, "fills").where("ts IS NOT NULL").select("fill_id", *SESSION, "ts").distinct()
    return asof_join(slim, _features(spark, d), SESSION, "ts", "ts_ns", "seq", "mid", 60_000_000_000, "m").select("fill_id", F.round("m", ROUND).alias("mid"))


_H = {"0_1": 100_000_000, "1": 1_000_000_000, "5": 5_000_000_000, "30": 30_000_000_000}


@query(f"""WITH {_FEATURES}, {_MIDS}, {", ".join(f"a{k} AS ({_AT(ns)})" for k, ns in {"z": 0, **_H}.items())}
SELECT CASE WHEN f.passive = 1 THEN 'passive (entries)' ELSE 'aggressive (exits)' END AS kind, round(avg((az.mid - f.price / 10000.0) * 100 * f.side), 3) + 0.0 AS vs_mid_ticks,
  {", ".join(f"round(avg((a{k}.mid - az.mid) * 100 * f.side), 3) + 0.0 AS markout_{k}s" for k in _H)}, count(*) AS n_fills
FROM f JOIN az USING (fill_id) {" ".join(f"JOIN a{k} USING (fill_id)" for k in _H)} GROUP BY 1""")
def fill_markouts(spark: SparkSession, d: str) -> DataFrame:
    return markouts(table(spark, d, "fills"), _features(spark, d))


@query(f"""WITH {_FEATURES}, {_MIDS}, az AS ({_AT(0)}), a1 AS ({_AT(1_000_000_000)})
SELECT f.run_id, round(avg((a1.mid - az.mid) * 100 * f.side), 6) + 0.0 AS adverse_ticks, count(*) AS n_fills FROM f JOIN az USING (fill_id) JOIN a1 USING (fill_id) GROUP BY f.run_id""")
def adverse_selection_1s(spark: SparkSession, d: str) -> DataFrame:
    return adverse_selection(table(spark, d, "fills"), _features(spark, d)).withColumn("adverse_ticks", F.round("adverse_ticks", ROUND))


@query("SELECT DISTINCT fill_id, round((CASE WHEN passive = 1 THEN -0.0020 ELSE 0.0030 END)::DOUBLE * qty, 6) AS fee_due, round(price / 10000.0, 4) AS price_usd FROM fills")
def fee_schedule(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fills").distinct()
    return f.select("fill_id", F.round(fee(F.col("passive") == 1, F.col("qty"), F.col("price")), ROUND).alias("fee_due"), F.round(F.col("price") / 10000.0, 4).alias("price_usd")).distinct()


@query("""SELECT run_id, sum(side * qty)::BIGINT AS position, round((sum(-side * qty * price) * 100 - sum(micro)) / 1000000, 4) AS cash, round(sum(micro) / 1000000, 4) AS fees, sum(qty)::BIGINT AS volume,
  count(*) AS n_fills, count(*) FILTER (passive = 1) AS n_passive, count(*) FILTER (passive = 0) AS n_aggressive FROM (SELECT DISTINCT *, round(coalesce(fee, 0) * 1000000)::BIGINT AS micro FROM fills) GROUP BY run_id""")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return fill_totals(table(spark, d, "fills"), ["run_id"]).withColumns({c: F.round(c, 4) for c in ("cash", "fees")})


@query("""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, fill_id) AS k FROM (SELECT DISTINCT run_id, fill_id, ts, side, price / 10000.0 AS px, qty, coalesce(fee, 0) AS fee FROM fills WHERE ts IS NOT NULL)),
w AS (SELECT run_id, k, fill_id, ts, (side * qty)::BIGINT AS pos, 0.0::DOUBLE AS realized, px::DOUBLE AS cost FROM f WHERE k = 1
  UNION ALL SELECT f.run_id, f.k, f.fill_id, f.ts, w.pos + f.side * f.qty,
    CASE WHEN w.pos * f.side < 0 THEN w.realized + least(f.qty, abs(w.pos)) * (f.px - w.cost) * -f.side ELSE w.realized END,
    CASE WHEN w.pos * f.side >= 0 THEN (w.cost * abs(w.pos) + f.px * f.qty) / (abs(w.pos) + f.qty) WHEN f.qty > abs(w.pos) THEN f.px WHEN f.qty = abs(w.pos) THEN 0 ELSE w.cost END
  FROM w JOIN f ON f.run_id = w.run_id AND f.k = w.k + 1)
SELECT run_id, fill_id, ts, pos AS position, floor(realized * 1000 + 0.5)::BIGINT AS realized_milli, floor(cost * 10000 + 0.5)::BIGINT AS avg_cost_units FROM w""")
def portfolio_ledger(spark: SparkSession, d: str) -> DataFrame:
    """In whole thousandths and price units, rounded by one floor, so that both engines round alike."""
    whole = lambda c, n: F.floor(F.col(c) * n + 0.5).cast("bigint")
    return bt.ledger(table(spark, d, "fills")).select("run_id", "fill_id", "ts", "position", whole("realized", 1000).alias("realized_milli"), whole("avg_cost", 10_000).alias("avg_cost_units"))


@query("""WITH s AS (SELECT DISTINCT run_id, sample_ts AS t, sample_id AS o, equity AS e FROM equity_samples WHERE sample_ts IS NOT NULL AND equity IS NOT NULL),
p AS (SELECT *, e - lag(e) OVER u AS chg, greatest(0, max(e) OVER (u ROWS UNBOUNDED PRECEDING)) - e AS fall FROM s WINDOW u AS (PARTITION BY run_id ORDER BY t, o))
SELECT run_id, count(*) AS n_samples, round(arg_max(e, (t, o)), 6) AS total_pnl, round(max(fall), 6) AS max_drawdown,
  round(CASE WHEN count(*) >= 3 AND stddev_samp(chg) > 0 THEN avg(chg) / stddev_samp(chg) * sqrt(23400 * 252.0) ELSE 0 END, 4) AS sharpe FROM p GROUP BY run_id""")
def equity_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = curve_metrics(table(spark, d, "equity_samples"), ["run_id"], "sample_ts", "sample_id", "equity", 23_400)
    return m.select("run_id", "n_samples", F.round("total_pnl", ROUND).alias("total_pnl"), F.round("max_drawdown", ROUND).alias("max_drawdown"), F.round("sharpe", 4).alias("sharpe"))


@query(f"""WITH {_FEATURES}, q AS (SELECT symbol, trade_date, ts_ns, arg_max(mid, seq) AS mid FROM d WHERE mid IS NOT NULL GROUP BY ALL),
g AS (SELECT symbol, trade_date, unnest(range(open_ns, close_ns + 1, 300000000000)) AS at FROM sessions)
SELECT g.symbol, g.trade_date, g.at AS sample_ts, round(q.mid, 6) AS mid FROM g ASOF LEFT JOIN q ON q.symbol = g.symbol AND q.trade_date = g.trade_date AND g.at >= q.ts_ns""")
def mid_sample_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = table(spark, d, "sessions").select(*SESSION, F.explode(dp.sample_grid(F.col("open_ns"), F.col("close_ns"), 300_000_000_000)).alias("sample_ts"))
    return asof_join(grid, _features(spark, d), SESSION, "sample_ts", "ts_ns", "seq", "mid", 60_000_000_000, "m").select(*SESSION, "sample_ts", F.round("m", ROUND).alias("mid"))


# --- backtests
_SHADOW = f"""{_LIFE},
g AS (SELECT f.*, row_number() OVER (PARTITION BY f.symbol, f.trade_date ORDER BY f.seq) AS n, CASE WHEN f.direction >= 0 THEN 1 ELSE -1 END AS s FROM f),
h AS (SELECT g.*, coalesce(v.qty, 0) AS shown FROM g LEFT JOIN v ON v.symbol = g.symbol AND v.trade_date = g.trade_date AND v.side = g.s AND v.px = g.price AND v.seq < g.seq AND (v.nxt IS NULL OR v.nxt >= g.seq)),
y AS (SELECT g.symbol, g.trade_date, g.seq, g.n, g.n AS pos, g.s AS side, g.price AS px, g.size::BIGINT AS want, v.qty AS ahead, 0::BIGINT AS filled, 0::BIGINT AS fills, a AS assumption
    FROM g JOIN v ON v.symbol = g.symbol AND v.trade_date = g.trade_date AND v.seq = g.seq AND v.delta > 0, (SELECT unnest(['Pessimistic', 'ProRata', 'Optimistic']) AS a) WHERE g.type = 1
  UNION ALL
  SELECT symbol, trade_date, seq, n, pos + 1, side, px, want, ahead - eaten, filled + least(hit, want - filled), fills + CASE WHEN least(hit, want - filled) > 0 THEN 1 ELSE 0 END, assumption FROM (
    SELECT *, CASE WHEN done THEN 0 WHEN type = 4 AND same AND price = px THEN least(size, ahead)
          WHEN type IN (2, 3) AND same AND price = px AND ahead > 0 THEN CASE assumption WHEN 'Optimistic' THEN least(size, ahead)
            WHEN 'ProRata' THEN CASE WHEN shown > 0 THEN least(floor(size * (ahead / shown) + 0.5)::BIGINT, ahead) ELSE 0 END ELSE 0 END ELSE 0 END AS eaten,
        CASE WHEN done THEN 0 WHEN type IN (4, 5) AND same THEN CASE WHEN (px - price) * side > 0 THEN size WHEN price <> px THEN 0 WHEN type = 5 THEN CASE WHEN ahead = 0 THEN size ELSE 0 END ELSE size - least(size, ahead) END
          WHEN type = 1 AND NOT same AND (price - px) * side <= 0 THEN size ELSE 0 END AS hit
    FROM (SELECT y.*, h.type, h.size, h.price, h.shown, h.s = y.side AS same, y.filled = y.want AS done FROM y JOIN h ON h.symbol = y.symbol AND h.trade_date = y.trade_date AND h.n = y.pos + 1 WHERE y.pos - y.n < 32)))"""


@query(f"WITH RECURSIVE {_SHADOW} SELECT symbol, trade_date, seq, assumption, arg_max(filled, pos) AS filled, arg_max(fills, pos) AS n_fills, arg_max(ahead, pos) AS queue_left FROM y GROUP BY symbol, trade_date, seq, assumption")
def shadow_fills(spark: SparkSession, d: str) -> DataFrame:
    """The fill model on an order behind every order of history."""
    return bt.shadow_orders(_feed(spark, d))


class Planned(bt.Strategy):
    """Orders at fixed times, whatever happens: each half hour one at our own best price, every fourth one at the market. Only in a two-sided book."""

    TIMES = [34_200_000_000_000 + i * 1_800_000_000_000 for i in range(1, 14)]

    def on_start(self, ctx: bt.Backtest) -> None:
        self.next = 0
        for t in self.TIMES:
            ctx.schedule_timer(t)

    def on_market(self, ctx: bt.Backtest, m, ofi_e: int) -> None: ...

    def on_timer(self, ctx: bt.Backtest, now: int) -> None:
        i, self.next = self.next, self.next + 1
        if ctx.book.two_sided():
            side = 1 if i % 2 else -1
            if i % 4 == 0:
                ctx.submit_market(side, 400)
            else:
                ctx.submit_limit(side, ctx.book.best_price(side), 150)


_PLAN = bt.RunSpec(label="planned", start_index=0, price_priority_purge=False, max_position=10**9, start_ts=34_200 * 10**9, end_ts=10**17, latency_us=250_000, flatten=False)
_HELD = "v.symbol = {0}.symbol AND v.trade_date = {0}.trade_date AND v.seq <= {0}.{1} AND (v.nxt IS NULL OR v.nxt > {0}.{1}) AND v.qty > 0"
_PLANNED = f"""{_LIFE},
g AS (SELECT f.*, row_number() OVER u AS n, coalesce(max(ts_ns) OVER (u ROWS UNBOUNDED PRECEDING), 0) AS clock, CASE WHEN direction >= 0 THEN 1 ELSE -1 END AS s FROM f WINDOW u AS (PARTITION BY symbol, trade_date ORDER BY seq)),
h AS (SELECT g.*, coalesce(v.qty, 0) AS shown FROM g LEFT JOIN v ON v.symbol = g.symbol AND v.trade_date = g.trade_date AND v.side = g.s AND v.px = g.price AND v.seq < g.seq AND (v.nxt IS NULL OR v.nxt >= g.seq)),
p AS (SELECT symbol, trade_date, i, t, CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END AS side, i % 4 = 0 AS market, CASE WHEN i % 4 = 0 THEN 400 ELSE 150 END AS want, max(seq) FILTER (clock <= t) AS sent, max(seq) FILTER (clock <= t + 250000000) AS met, max(n) FILTER (clock <= t + 250000000) AS pos
  FROM g, (SELECT i, {Planned.TIMES[0]} + i * 1800000000000 AS t FROM range(13) r(i)) GROUP BY symbol, trade_date, i, t HAVING max(clock) > t),
q AS (SELECT p.symbol, p.trade_date, p.i, max(v.px) FILTER (v.side = 1) AS bid, min(v.px) FILTER (v.side = -1) AS ask FROM p JOIN v ON {_HELD.format('p', 'sent')} GROUP BY ALL),
r0 AS (SELECT p.*, CASE WHEN market THEN side * {NO_ASK} WHEN side = 1 THEN bid ELSE ask END AS px, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY i) AS order_id FROM p JOIN q USING (symbol, trade_date, i) WHERE bid IS NOT NULL AND ask IS NOT NULL),
lv AS (SELECT r0.*, v.px AS lpx, least(v.qty, want - coalesce(sum(v.qty) OVER (PARTITION BY r0.symbol, r0.trade_date, r0.i ORDER BY v.px * r0.side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS got
  FROM r0 JOIN v ON {_HELD.format('r0', 'met')} AND v.side = -r0.side AND (v.px - r0.px) * r0.side <= 0),
tk AS (SELECT * FROM lv WHERE got > 0),
y AS (SELECT r0.symbol, r0.trade_date, r0.order_id, r0.side, r0.px, r0.pos, r0.want - coalesce(a.taken, 0) AS rest, coalesce(v.qty, 0) AS ahead, 0::BIGINT AS fill, 0::BIGINT AS clock
    FROM r0 LEFT JOIN (SELECT symbol, trade_date, i, sum(got)::BIGINT AS taken FROM tk GROUP BY ALL) a USING (symbol, trade_date, i) LEFT JOIN v ON {_HELD.format('r0', 'met')} AND v.side = r0.side AND v.px = r0.px WHERE NOT market
  UNION ALL
  SELECT symbol, trade_date, order_id, side, px, pos + 1, rest - least(hit, rest), ahead - eaten, least(hit, rest), clock FROM (
    SELECT *, CASE WHEN type = 4 AND same AND price = px THEN least(size, ahead)
          WHEN type IN (2, 3) AND same AND price = px AND ahead > 0 AND shown > 0 THEN least(floor(size * (ahead / shown) + 0.5)::BIGINT, ahead) ELSE 0 END AS eaten,
        CASE WHEN type IN (4, 5) AND same THEN CASE WHEN (px - price) * side > 0 THEN size WHEN price <> px THEN 0 WHEN type = 5 THEN CASE WHEN ahead = 0 THEN size ELSE 0 END ELSE size - least(size, ahead) END
          WHEN type = 1 AND NOT same AND (price - px) * side <= 0 THEN size ELSE 0 END AS hit
    FROM (SELECT y.symbol, y.trade_date, y.order_id, y.side, y.px, y.pos, y.rest, y.ahead, h.type, h.size, h.price, h.shown, h.clock, h.s = y.side AS same FROM y JOIN h ON h.symbol = y.symbol AND h.trade_date = y.trade_date AND h.n = y.pos + 1 WHERE y.rest > 0)))"""


@query(f"""WITH RECURSIVE {_PLANNED} SELECT symbol, trade_date, order_id, t + 250000000 AS ts, side, lpx AS price, got::BIGINT AS qty, false AS passive, round(got * 0.003::DOUBLE, 6) AS fee FROM tk
UNION ALL SELECT symbol, trade_date, order_id, clock, side, px, fill, true, round(fill * -0.002::DOUBLE, 6) FROM y WHERE fill > 0""")
def planned_fills(spark: SparkSession, d: str) -> DataFrame:
    """The event loop on its own: timers, latency, arrival, queues and fees of planned orders; what they hold at the end is kept."""
    f = bt.backtest(_feed(spark, d), [_PLAN], output="fills", make=lambda spec: Planned())
    return f.select(*SESSION, "order_id", "ts", "side", "price", "qty", "passive", F.round("fee", ROUND).alias("fee"))


_BASE = bt.RunSpec(window_events=20, zscore_window=100, entry_z=1.5, max_hold_s=600, order_ttl_s=60)


_PAIR = [_BASE, bt.replace(_BASE, passive_entry=False)]
_LATENCIES, _ENTRIES = (0, 50, 500, 5000, 50000), (2, 2.5, 3, 4)


def _swept(name: str, values) -> list[bt.RunSpec]:
    return [bt.replace(_BASE, **{name: v, "label": f"{name}={v}"}) for v in values]


def _rounded(m: DataFrame) -> DataFrame:
    places = dict.fromkeys(("total_pnl", "gross_pnl", "realized_pnl", "fees", "max_drawdown", "fill_rate", "pnl_per_share"), ROUND) | {"sharpe": 4}
    return m.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in places.items()})


@query(book_sql.metrics_sql(_FEED, _PAIR))
def backtest_ofi(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bt.backtest(_feed(spark, d), _PAIR, _depth(spark, d)))


@query(book_sql.fills_sql(_FEED, [_BASE]))
def backtest_fills(spark: SparkSession, d: str) -> DataFrame:
    return bt.backtest(_feed(spark, d), [_BASE], _depth(spark, d), output="fills").withColumn("fee", F.round("fee", ROUND))


@query(book_sql.equity_sql(_FEED, [_BASE]))
def backtest_equity(spark: SparkSession, d: str) -> DataFrame:
    return bt.backtest(_feed(spark, d), [_BASE], _depth(spark, d), output="equity").withColumns({"equity": F.round("equity", ROUND) + F.lit(0.0), "mid": F.round("mid", ROUND)})


@query(book_sql.metrics_sql(_FEED, _swept("latency_us", _LATENCIES), "latency_us"))
def latency_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bt.latency_sweep(_feed(spark, d), _LATENCIES, base=_BASE, depth=_depth(spark, d)))


@query(book_sql.metrics_sql(_FEED, _swept("cancel_assumption", (bt.PESSIMISTIC, bt.PRO_RATA, bt.OPTIMISTIC)), "cancel_assumption"))
def cancel_assumption_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bt.cancel_assumption_sweep(_feed(spark, d), base=_BASE, depth=_depth(spark, d)))


@query(book_sql.metrics_sql(_FEED, _swept("entry_z", _ENTRIES), "entry_z"))
def entry_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bt.entry_threshold_sweep(_feed(spark, d), _ENTRIES, base=_BASE, depth=_depth(spark, d)))
