"""Order-flow signals over per-event features.

Features: ``keys`` (a session), ``seq`` (order inside it), ``ts_ns``, ``best_bid``, ``best_ask``, ``bid_qty``, ``ask_qty``, ``ofi_e``,
``trade_qty``, ``mid``. Absent sides give NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PRICE_SCALE, TICK, real_price
from .windows import BLOCK, haloed, numbered

SESSION = ("symbol", "trade_date")
TICKS_PER_UNIT = PRICE_SCALE // TICK


def mid_price(bid: str = "best_bid", ask: str = "best_ask") -> Column:
    """(bid + ask) / 2 in currency; NULL while a side is empty."""
    return (real_price(bid) + real_price(ask)) / F.lit(2.0) / F.lit(float(PRICE_SCALE))


def spread_ticks(bid: str = "best_bid", ask: str = "best_ask") -> Column:
    return (real_price(ask) - real_price(bid)) / F.lit(float(TICK))


def queue_imbalance(bid_qty: str = "bid_qty", ask_qty: str = "ask_qty") -> Column:
    """(Qb - Qa) / (Qb + Qa) at the touch; NULL if nothing is there."""
    total = F.col(bid_qty) + F.col(ask_qty)
    return F.when(total > 0, (F.col(bid_qty) - F.col(ask_qty)) / total)


def ofi_term(pb: Column, qb: Column, pa: Column, qa: Column, pb0: Column, qb0: Column, pa0: Column, qa0: Column) -> Column:
    """Order-flow imbalance of one event: queue gained at the bid less queue gained at the ask, before (0) to after.

    0 unless both sides exist before and after (an absent price is NULL).
    """
    q = lambda cond, n: F.when(cond, n.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    value = q(pb >= pb0, qb) - q(pb <= pb0, qb0) - q(pa <= pa0, qa) + q(pa >= pa0, qa0)
    return F.when(pb.isNotNull() & pb0.isNotNull() & pa.isNotNull() & pa0.isNotNull(), value).otherwise(F.lit(0).cast("bigint"))


def clean_features(features: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Exact repeats merged, rows without a time or a place left out, a NULL ofi_e as 0."""
    cols = [*keys, "seq", "ts_ns", "type", "best_bid", "best_ask", "bid_qty", "ask_qty", "ofi_e", "trade_qty", "trade_side", "mid", "spread_ticks"]
    return features.select(*cols).where("ts_ns IS NOT NULL AND seq IS NOT NULL").distinct().withColumn("ofi_e", F.coalesce("ofi_e", F.lit(0).cast("bigint")))


def bucket_ofi(features: DataFrame, bucket_ns: int, keys: Sequence[str] = SESSION) -> DataFrame:
    """Per bucket with a mid: ofi, mid_end, depth, n_events, trade_qty, dmid_ticks, dmid_next_ticks.

    dmid_ticks: change of mid_end from the bucket *present* before; the first bucket of a session is left out.
    dmid_next_ticks: the next present bucket's change, NULL in the last. Empty buckets are absent.
    """
    b = (
        features.where("mid IS NOT NULL")
        .groupBy(*keys, F.expr(f"ts_ns div {bucket_ns} * {bucket_ns}").alias("bucket"))
        .agg(
            F.sum("ofi_e").alias("ofi"), F.max_by("mid", "seq").alias("mid_end"), ((F.avg("bid_qty") + F.avg("ask_qty")) / 2).alias("depth"),
            F.count(F.lit(1)).alias("n_events"), F.sum("trade_qty").alias("trade_qty"),
        )
    )
    w = Window.partitionBy(*keys).orderBy("bucket")  # buckets: as many as the session's span holds
    change = (F.col("mid_end") - F.lag("mid_end").over(w)) * TICKS_PER_UNIT
    moved = b.withColumn("dmid_ticks", change)
    return moved.withColumn("dmid_next_ticks", F.lead("dmid_ticks").over(w)).where("dmid_ticks IS NOT NULL")


def event_signals(
    features: DataFrame, rolling: Iterable[int] = (), forward: Iterable[int] = (), zscores: Iterable[tuple[int, int]] = (), keys: Sequence[str] = SESSION, block: int = BLOCK
) -> DataFrame:
    """The features with ``pos`` and, in event time, ``ofi_w{W}``, ``fwd_{H}`` and ``z_{We}_{Wz}``.

    ofi_wW: sum of ofi_e over the last W events, NULL in the first W - 1. fwd_H: change of the mid H events ahead in ticks.
    z: the windowed OFI (partial sums at the start) less its mean, over its population deviation, of the last Wz events; 0 until max(We, Wz) events have
    passed and where the variance is below 1e-12.
    """
    rolling, forward, zscores = list(rolling), list(forward), list(zscores)
    back = max([0, *rolling, *[a + b for a, b in zscores]])
    ahead = max([0, *forward])
    rows, w, own = haloed(numbered(features, keys, "seq", block), keys, back, ahead, block)
    last = lambda n: w.rowsBetween(1 - n, 0)
    for n in rolling:
        rows = rows.withColumn(f"ofi_w{n}", F.when(F.col("pos") >= n - 1, F.sum("ofi_e").over(last(n))))
    for h in forward:
        rows = rows.withColumn(f"fwd_{h}", (F.lead("mid", h).over(w) - F.col("mid")) * TICKS_PER_UNIT)
    for we, wz in zscores:
        we, wz = max(1, we), max(2, wz)
        x = F.col("__w")
        rows = rows.withColumn("__w", F.sum("ofi_e").over(last(we)).cast("double"))
        mean = F.sum(x).over(last(wz)) / wz
        rows = rows.withColumn("__m", mean).withColumn("__v", F.sum(x * x).over(last(wz)) / wz - F.col("__m") * F.col("__m"))
        warm = F.col("pos") + 1 >= max(we, wz)
        rows = rows.withColumn(f"z_{we}_{wz}", F.when(warm & (F.col("__v") >= 1e-12), (x - F.col("__m")) / F.sqrt("__v")).otherwise(0.0)).drop("__w", "__m", "__v")
    return rows.where(own).drop("__block")
