"""What the mid does after a fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signals import SESSION, TICKS_PER_UNIT
from ..schema import NS_PER_SEC, PRICE_SCALE
from .asof import asof_join

MINUTE = 60 * NS_PER_SEC


def _mids(fills: DataFrame, features: DataFrame, horizons_ns: Sequence[int]) -> DataFrame:
    """fill_id, run_id, symbol, trade_date, side, price, passive, m0 (mid at the fill) and m1, m2 .. at the horizons after it."""
    slim = fills.where("ts IS NOT NULL").select("fill_id", "run_id", *SESSION, "ts", "side", "price", "passive").distinct()
    probes = slim.withColumn("h", F.explode(F.array(*[F.lit(h).cast("bigint") for h in (0, *horizons_ns)]))).withColumn("at", F.col("ts") + F.col("h"))
    found = asof_join(probes, features, SESSION, "at", "ts_ns", "seq", "mid", MINUTE, "m")
    return found.groupBy("fill_id", "run_id", *SESSION, "ts", "side", "price", "passive").agg(*[F.max(F.when(F.col("h") == h, F.col("m"))).alias(f"m{i}") for i, h in enumerate((0, *horizons_ns))])


def markouts(fills: DataFrame, features: DataFrame, horizons_s: Sequence[float] = (0.1, 1.0, 5.0, 30.0)) -> DataFrame:
    """Per kind of fill: mean vs_mid_ticks (price against the mid at the fill, + is better), mean markout_{h}s (mid move after it, + is for us), n_fills.

    The mid is the last one at or before a time. A fill before the first mid has none and counts in n_fills only. Means are rounded to 3 places.
    """
    m = _mids(fills, features, [int(h * NS_PER_SEC) for h in horizons_s])
    vs = (F.col("m0") - F.col("price") / PRICE_SCALE) * TICKS_PER_UNIT * F.col("side")
    moves = [((F.col(f"m{i}") - F.col("m0")) * TICKS_PER_UNIT * F.col("side")) for i in range(1, len(horizons_s) + 1)]
    kind = F.when(F.col("passive") == 1, "passive (entries)").otherwise("aggressive (exits)").alias("kind")
    return m.groupBy(kind).agg(F.round(F.avg(vs), 3).alias("vs_mid_ticks"), *[F.round(F.avg(x), 3).alias(f"markout_{h:g}s".replace(".", "_")) for x, h in zip(moves, horizons_s)], F.count(F.lit(1)).alias("n_fills"))


def adverse_selection(fills: DataFrame, features: DataFrame, horizon_s: float = 1.0) -> DataFrame:
    """Per run the mean signed mid move in ticks ``horizon_s`` after its fills: below 0 they were picked off. NULL if no fill has a mid."""
    m = _mids(fills, features, [int(horizon_s * NS_PER_SEC)])
    return m.groupBy("run_id").agg(F.avg((F.col("m1") - F.col("m0")) * TICKS_PER_UNIT * F.col("side")).alias("adverse_ticks"), F.count(F.lit(1)).alias("n_fills"))


def for_display(fills: DataFrame, ts: str = "ts") -> DataFrame:
    """The fills with ``price_usd`` and ``time`` (a timestamp of microseconds after midnight of 1970-01-01; the nanoseconds stay in ``ts``)."""
    return fills.withColumns({"price_usd": F.col("price") / PRICE_SCALE, "time": F.timestamp_micros(F.expr(f"{ts} div 1000"))})
