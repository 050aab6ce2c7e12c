"""Message-only reconstruction in sets: orders, level quantities and the closing book, without a scan of whole sessions.

An order's remaining quantity depends on its own messages alone, so each order is folded on its own, and level
quantities are running sums of the signed changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import SESSION, ofi_term
from ..schema import NO_ASK, NO_BID
from .lifecycle import CLOSE, OPEN, REDUCE
from .paged import PAGE, paged_fold
from .patches import Patches

ORDERS = Patches({"px": "bigint", "side": "int", "born": "bigint"})
COUNTS = "struct<adds:bigint,dup:bigint,cancelled:bigint,executed:bigint,unknown:bigint>"
RESULT = f"struct<state:{ORDERS.state},counts:{COUNTS},events:array<struct<seq:bigint,side:int,px:bigint,delta:bigint>>>"


def _read(items: Column, state: Column) -> Column:
    """Walk one order's messages of a page from its state before: what rests, where and since when; counts and the changes of level quantity."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("adds", "dup", "cancelled", "executed", "unknown")])
    start = F.struct(state.alias("state"), zero.alias("counts"), F.array().alias("events")).cast(RESULT)
    one = lambda cond: F.when(cond, 1).otherwise(0)

    def step(acc: Column, m: Column) -> Column:
        a, c = acc["state"], acc["counts"]
        rests, add = a["size"] > 0, m["type"] == 1
        taken = F.when(rests & ~add, F.when(m["type"] == 3, a["size"]).otherwise(F.least(m["qty"], a["size"]))).otherwise(F.lit(0).cast("bigint"))
        opened = add & ~rests
        delta = F.when(opened, m["qty"]).otherwise(-taken)
        new = {k: m[k] for k in ORDERS.fields}
        after = F.struct((a["size"] + delta).alias("size"), *[F.when(opened, v).otherwise(a[k]).alias(k) for k, v in new.items()]).cast(ORDERS.state)
        counts = F.struct(
            (c["adds"] + one(opened)).alias("adds"), (c["dup"] + one(add & rests)).alias("dup"), (c["cancelled"] + F.when(m["type"].isin(2, 3), taken).otherwise(0)).alias("cancelled"),
            (c["executed"] + F.when(m["type"] == 4, taken).otherwise(0)).alias("executed"), (c["unknown"] + one(~add & ~rests)).alias("unknown"),
        )
        event = F.array(F.struct(m["at"].alias("seq"), after["side"].alias("side"), after["px"].alias("px"), delta.alias("delta")))
        return F.struct(after.alias("state"), counts.alias("counts"), F.when(delta != 0, F.concat(acc["events"], event)).otherwise(acc["events"]).alias("events")).cast(RESULT)

    return F.aggregate(items, start, step)


def folded(feed: DataFrame, page: int = PAGE) -> DataFrame:
    """Per order and page of a ``feed`` the result of its messages: ``r`` with state, counts and events.

    Rules of a book: an add while the order rests changes nothing, an add without size or price is ignored, a reduction takes
    at most what is left, a delete takes all. Messages of an order that doesn't rest are counted as unknown.
    """
    rows = feed.where("type BETWEEN 1 AND 4 AND order_id <> 0 AND NOT (type = 1 AND (size <= 0 OR price <= 0))")
    ops = rows.select(
        *SESSION, "order_id", "seq", "type", F.when(F.col("type") == 1, OPEN).when(F.col("type") == 3, CLOSE).otherwise(REDUCE).alias("op"), F.greatest(F.col("size").cast("bigint"), F.lit(0)).alias("qty"),
        F.col("price").alias("px"), F.when(F.col("direction") >= 0, 1).otherwise(-1).alias("side"), F.col("seq").alias("born"),
    )
    return paged_fold(ops, [*SESSION, "order_id"], "seq", ORDERS, [F.col("type")], _read, page)


def _closing(feed: DataFrame, page: int) -> DataFrame:
    """The orders that rest at the end: session, order_id, rest, px, side, born."""
    f = folded(feed, page).groupBy(*SESSION, "order_id").agg(F.max_by("r.state", "page").alias("s")).select(*SESSION, "order_id", F.col("s.size").alias("rest"), "s.px", "s.side", "s.born")
    return f.where("rest > 0")


def lifecycle(feed: DataFrame, page: int = PAGE) -> DataFrame:
    """Per order: adds, duplicate adds (dup), cancelled and executed quantity, unknown references, remaining quantity."""
    counts = [F.sum(f"r.counts.{c}").alias(c) for c in ("adds", "dup", "cancelled", "executed", "unknown")]
    return folded(feed, page).groupBy(*SESSION, "order_id").agg(*counts, F.max_by("r.state.size", "page").alias("remaining"))


def level_changes(feed: DataFrame, page: int = PAGE) -> DataFrame:
    """Every change of a level: session, seq, side, px, delta and ``qty``, the level's quantity after it.

    The running sum goes in two steps: inside ranges of seq, and over one total per range.
    """
    e = folded(feed, page).select(*SESSION, F.explode("r.events").alias("e")).select(*SESSION, "e.*").withColumn("part", F.expr("seq div 65536"))
    key = [*SESSION, "side", "px"]
    inside = Window.partitionBy(*key, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = e.groupBy(*key, "part").agg(F.sum("delta").alias("t")).withColumn("off", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    return e.withColumn("run", F.sum("delta").over(inside)).join(totals, [*key, "part"]).select(*key, "seq", "delta", (F.col("run") + F.col("off")).alias("qty"))


def closing_levels(feed: DataFrame, page: int = PAGE) -> DataFrame:
    """The book at the end of each session: session, side, px, qty, n_orders and ``level``, from 1 for the best."""
    left = _closing(feed, page).groupBy(*SESSION, "side", "px").agg(F.sum("rest").alias("qty"), F.count(F.lit(1)).alias("n_orders"))
    rank = Window.partitionBy(*SESSION, "side").orderBy(F.desc(F.col("px") * F.col("side")))
    return left.withColumn("level", F.row_number().over(rank))


def queue_positions(feed: DataFrame, page: int = PAGE) -> DataFrame:
    """Each order that rests at the end with what stands before it in its level: session, order_id, side, px, remaining, queue_ahead."""
    level = Window.partitionBy(*SESSION, "side", "px").orderBy("born").rowsBetween(Window.unboundedPreceding, -1)
    return _closing(feed, page).select(*SESSION, "order_id", "side", "px", F.col("rest").alias("remaining"), F.coalesce(F.sum("rest").over(level), F.lit(0)).alias("queue_ahead"))


STRETCH = 65_536  # order numbers whose rows look back at one another in one task


def _cover(start: str, end: str, height: int) -> Column:
    """The nodes (level, place) of a tree of fan-out 4 over the order numbers that make up [start, end) exactly."""

    def at(k: Column) -> Column:
        step, l, r = F.pow(F.lit(4), k).cast("bigint"), F.col(start), F.col(end)
        l, r = F.floor((l + step - 1) / step).cast("bigint"), F.floor(r / step).cast("bigint")
        up = F.least(r, F.floor((l + 3) / 4).cast("bigint") * 4)
        down = F.greatest(up, F.floor(r / 4).cast("bigint") * 4)
        run = lambda a, b: F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda n: F.struct(k.alias("k"), n.alias("node")))).otherwise(F.array().cast("array<struct<k:int,node:bigint>>"))
        return F.when(l < r, F.concat(run(l, up), run(down, r))).otherwise(F.array().cast("array<struct<k:int,node:bigint>>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height)), at))


def touches(feed: DataFrame, points: DataFrame, page: int = PAGE) -> DataFrame:
    """``points`` (session, seq and other columns) with the best bid and ask and their quantities after the message of that order number; an empty side has a spelled-out price.

    Every stretch in which a level shows a quantity is an interval of order numbers. It is put into the few nodes of a tree that make it up, a point asks
    the nodes above it, one on each level, and the best price among them is the touch. So no session is gone through in one task.
    """
    last = feed.agg(F.max("seq")).first()[0] or 0
    height = 0
    while 4**height <= last + 1:
        height += 1
    level = Window.partitionBy(*SESSION, "side", "px").orderBy("seq")
    shown = level_changes(feed, page).withColumn("until", F.coalesce(F.lead("seq").over(level), F.lit(4**height))).where("qty > 0")
    best = lambda side: F.max(F.when(F.col("side") == side, F.struct((F.col("px") * side).alias("rank"), "qty")))
    nodes = (
        shown.select(*SESSION, "side", "px", "qty", F.explode(_cover("seq", "until", height)).alias("n"))
        .groupBy(*SESSION, "n.k", "n.node").agg(best(1).alias("bid"), best(-1).alias("ask"))
    )
    asked = points.select(*SESSION, "seq").distinct().where("seq >= 0").select(*SESSION, "seq", F.explode(F.sequence(F.lit(0), F.lit(height))).alias("k")).withColumn("node", F.floor(F.col("seq") / F.pow(F.lit(4), F.col("k"))).cast("bigint"))
    top = asked.join(nodes, [*SESSION, "k", "node"]).groupBy(*SESSION, "seq").agg(F.max("bid").alias("bid"), F.max("ask").alias("ask"))
    found = points.join(top, [*SESSION, "seq"], "left")
    return found.select(
        *points.columns, F.coalesce(F.col("bid.rank"), F.lit(NO_BID)).alias("best_bid"), F.coalesce(F.col("bid.qty"), F.lit(0).cast("bigint")).alias("bid_qty"),
        F.coalesce(-F.col("ask.rank"), F.lit(NO_ASK)).alias("best_ask"), F.coalesce(F.col("ask.qty"), F.lit(0).cast("bigint")).alias("ask_qty"),
    )


def message_features(feed: DataFrame, page: int = PAGE) -> DataFrame:
    """The message-only replay in sets: per message seq, ts_ns, type, touch, ofi_e, trade_qty and trade_side, as ``replay`` gives them.

    A row looks back at the one before it within stretches of ``STRETCH`` order numbers; the state at the beginning of a stretch is one more point of the tree.
    """
    cols = ["seq", "ts_ns", "type", "size", "direction"]
    rows = feed.select(*SESSION, *cols, F.expr(f"seq div {STRETCH}").alias("part"), F.lit(True).alias("own"))
    begins = rows.select(*SESSION, "part").distinct().select(*SESSION, (F.col("part") * STRETCH - 1).alias("seq"), *[F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in cols[1:]], "part", F.lit(False).alias("own"))
    seen = touches(feed, rows.unionByName(begins), page)
    w = Window.partitionBy(*SESSION, "part").orderBy("seq")
    real = {"pb": ("best_bid", NO_BID), "pa": ("best_ask", NO_ASK)}
    price = {k: F.when(F.col(c) != none, F.col(c)) for k, (c, none) in real.items()}
    now = seen.withColumns(price)
    before = {f"{c}0": F.lag(c).over(w) for c in ("pb", "bid_qty", "pa", "ask_qty")}
    trade = F.col("type").isin(4, 5)
    # ts_ns: a message without a time happens at that of the one before
    clock = F.coalesce(F.last("ts_ns", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"), F.lit(0).cast("bigint"))
    totals = rows.groupBy(*SESSION, "part").agg(F.max_by("ts_ns", F.when(F.col("ts_ns").isNotNull(), F.col("seq"))).alias("t"))
    over = Window.partitionBy(*SESSION).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*SESSION, "part", F.last("t", ignorenulls=True).over(over).alias("carried"))
    flow = ofi_term(*[F.col(c) for c in ("pb", "bid_qty", "pa", "ask_qty", "pb0", "bid_qty0", "pa0", "ask_qty0")])
    out = now.join(totals, [*SESSION, "part"]).withColumns({**before, "clock": clock}).where("own")
    return out.select(
        *SESSION, "seq", F.col("clock").alias("ts_ns"), F.col("type").cast("int").alias("type"), "best_bid", "bid_qty", "best_ask", "ask_qty", flow.alias("ofi_e"),
        F.when(trade, F.col("size")).otherwise(0).cast("bigint").alias("trade_qty"), F.when(trade, F.when(F.col("direction") >= 0, 1).otherwise(-1)).otherwise(0).cast("bigint").alias("trade_side"),
    )
