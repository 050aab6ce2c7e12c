"""Depth tables: wide, nested and long forms, seeds, top levels, walking the book, comparing copies level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import SESSION, mid_price, ofi_term, spread_ticks
from ..functions.windows import BLOCK, haloed, numbered
from ..schema import NO_ASK, NO_BID, depth_columns, real_price


def nested(depth: DataFrame, levels: int, keys: Sequence[str] = (*SESSION, "seq")) -> DataFrame:
    """keys with ``asks`` and ``bids``: arrays of (px, sz), best first, of ``levels`` entries, as they are spelled."""
    side = lambda s: F.array(*[F.struct(F.col(f"{s}_px_{j}").alias("px"), F.col(f"{s}_sz_{j}").alias("sz")) for j in range(1, levels + 1)])
    return depth.select(*keys, side("ask").alias("asks"), side("bid").alias("bids"))


def real_levels(levels: Column) -> Column:
    """Only the entries of a nested side that hold something: size above 0 and no spelling of an empty price."""
    return F.filter(levels, lambda x: (x["sz"] > 0) & ~x["px"].isin(NO_ASK, NO_BID))


def long_levels(depth: DataFrame, levels: int, keys: Sequence[str] = (*SESSION, "seq")) -> DataFrame:
    """A row per real level: keys, side (1 bid, -1 ask), level (from 1 in the order of the columns), px, sz."""
    n = nested(depth, levels, keys)
    part = lambda c, side: n.select(*keys, F.lit(side).alias("side"), F.posexplode(c).alias("i", "x")).select(*keys, "side", (F.col("i") + 1).alias("level"), F.col("x.px").alias("px"), F.col("x.sz").alias("sz"))
    return part("asks", -1).unionByName(part("bids", 1)).where(~F.col("px").isin(NO_ASK, NO_BID) & (F.col("sz") > 0))


def seeds(depth: DataFrame, levels: int, session: Sequence[str] = SESSION) -> DataFrame:
    """The real levels of each session's first row (least seq): session, side, px, sz. The start of a replay."""
    first = depth.where("seq IS NOT NULL").groupBy(*session).agg(F.min_by(F.struct(*depth_columns(levels)), "seq").alias("r")).select(*session, "r.*")
    return long_levels(first, levels, session).select(*session, "side", "px", "sz")


def features_from_depth(depth: DataFrame, session: Sequence[str] = SESSION, block: int = BLOCK) -> DataFrame:
    """Level-1 features of a depth stream: what a replay that is put right by every snapshot gives, without a replay.

    session, seq, ts_ns, best_bid, best_ask (spelled NO_BID / NO_ASK if empty), bid_qty, ask_qty, ofi_e, mid, spread_ticks. The first row's ofi_e is 0.
    Exact repeats are merged; rows with a NULL seq are left out.
    """
    bid, ask = real_price("bid_px_1"), real_price("ask_px_1")
    l1 = (
        depth.where("seq IS NOT NULL")
        .select(
            *session, "seq", "ts_ns", bid.alias("pb"), ask.alias("pa"),
            F.when(bid.isNotNull(), F.coalesce("bid_sz_1", F.lit(0))).otherwise(0).alias("qb"), F.when(ask.isNotNull(), F.coalesce("ask_sz_1", F.lit(0))).otherwise(0).alias("qa"),
        )
        .distinct()
    )
    rows, w, own = haloed(numbered(l1, session, "seq", block, tie="ts_ns"), session, 1, 0, block)
    for c in ("pb", "qb", "pa", "qa"):
        rows = rows.withColumn(f"{c}0", F.lag(c).over(w))
    term = ofi_term(*[F.col(c) for c in ("pb", "qb", "pa", "qa", "pb0", "qb0", "pa0", "qa0")])
    out = rows.where(own).select(
        *session, "seq", "ts_ns", F.coalesce("pb", F.lit(NO_BID)).alias("best_bid"), F.coalesce("pa", F.lit(NO_ASK)).alias("best_ask"),
        F.col("qb").alias("bid_qty"), F.col("qa").alias("ask_qty"), term.alias("ofi_e"),
    )
    return out.withColumns({"mid": mid_price(), "spread_ticks": spread_ticks()})


def walk(depth: DataFrame, levels: int, side: int, qty: int, limit: Column | None = None, keys: Sequence[str] = (*SESSION, "seq")) -> DataFrame:
    """An order of ``qty`` against each row's visible depth: keys, filled, cost (price x quantity, price units), last_px, rest.

    side 1 buys from the asks, -1 sells into the bids, best first while the price is within ``limit``. Independent orders, one per row.
    """
    book = F.col("asks" if side > 0 else "bids")
    within = real_levels(book) if limit is None else F.filter(real_levels(book), lambda x: (x["px"] <= limit) if side > 0 else (x["px"] >= limit))
    start = F.struct(F.lit(qty).cast("bigint").alias("rest"), F.lit(0).cast("bigint").alias("cost"), F.lit(None).cast("bigint").alias("last"))

    def take(acc: Column, x: Column) -> Column:
        n = F.least(acc["rest"], x["sz"].cast("bigint"))
        return F.struct((acc["rest"] - n).alias("rest"), (acc["cost"] + n * x["px"]).alias("cost"), F.when(n > 0, x["px"]).otherwise(acc["last"]).alias("last"))

    n = nested(depth, levels, keys)
    extra = n if limit is None else depth.select(*keys, *depth_columns(levels), limit.alias("__limit")).transform(lambda d: nested(d, levels, [*keys, "__limit"]))
    r = extra.withColumn("r", F.aggregate(within, start, take))
    return r.select(*keys, (F.lit(qty) - F.col("r.rest")).alias("filled"), F.col("r.cost").alias("cost"), F.col("r.last").alias("last_px"), F.col("r.rest").alias("rest"))


def compare_levels(left: DataFrame, right: DataFrame, levels: int, session: Sequence[str] = SESSION) -> DataFrame:
    """Per session over the rows that both have: n_rows, n_exact, n_l1_exact, first_mismatch (seq) and mismatch_1 .. mismatch_k. Repeats count once."""
    cols = depth_columns(levels)
    a = left.select(*session, "seq", *cols).distinct()
    b = right.select(*session, "seq", *[F.col(c).alias(f"r_{c}") for c in cols]).distinct()
    both = a.join(b, [*session, "seq"])
    ok = {}
    for j in range(1, levels + 1):
        same = F.lit(True)
        for c in (f"ask_px_{j}", f"bid_px_{j}"):
            same = same & real_price(c).eqNullSafe(real_price(f"r_{c}"))
        for c in (f"ask_sz_{j}", f"bid_sz_{j}"):
            same = same & (F.coalesce(c, F.lit(0)) == F.coalesce(f"r_{c}", F.lit(0)))
        ok[j] = same
    exact = F.lit(True)
    for s in ok.values():
        exact = exact & s
    return both.groupBy(*session).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(exact).alias("n_exact"), F.count_if(ok[1]).alias("n_l1_exact"), F.min(F.when(~exact, F.col("seq"))).alias("first_mismatch"),
        *[F.count_if(~s).alias(f"mismatch_{j}") for j, s in ok.items()],
    )


def sample_grid(start: Column, end: Column, step: int) -> Column:
    """Sample times start, start + step, ... up to end inclusive."""
    return F.sequence(start, end, F.lit(step).cast("bigint"))


