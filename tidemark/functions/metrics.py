"""Statistics of equity curves and fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PRICE_SCALE
from .windows import BLOCK, haloed, numbered


def fee(passive: Column, qty: Column, price: Column, maker: float = -0.0020, taker: float = 0.0030, bps: float = 0.0) -> Column:
    """Maker or taker fee per share, plus a commission on the notional."""
    return F.when(passive, F.lit(maker)).otherwise(F.lit(taker)) * qty + F.lit(bps * 1e-4) * qty * price / PRICE_SCALE


def curve_metrics(samples: DataFrame, run: Sequence[str], ts: str, tie: str, equity: str, samples_per_day: float, block: int = BLOCK) -> DataFrame:
    """Per run: n_samples, total_pnl (the last equity), max_drawdown and sharpe.

    The drawdown's peak starts at 0. Sharpe: mean over sample deviation of the changes, times the root of ``samples_per_day`` x 252;
    0 with fewer than 3 samples or no variance. Exact repeats count once; samples with a NULL time or equity are left out; ``tie`` orders samples of one time.
    A long curve is cut into blocks: the greatest drawdown is within a block, or from the peak of the blocks before to a block's least value.
    """
    run = list(run)
    slim = samples.where(F.col(ts).isNotNull() & F.col(equity).isNotNull()).select(*run, F.col(ts).alias("t"), F.col(tie).alias("o"), F.col(equity).alias("e")).distinct()
    rows, w, own = haloed(numbered(slim, run, "t", 60 * 1_000_000_000, tie="o"), run, 1, 0, block)
    up_to = Window.partitionBy(*run, "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("d", F.col("e") - F.lag("e").over(w)).where(own).withColumn("peak", F.max("e").over(up_to))
    before = Window.partitionBy(*run).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    falls = (
        inner.groupBy(*run, "__block").agg(F.max("e").alias("top"), F.min("e").alias("low"), F.max(F.col("peak") - F.col("e")).alias("fall"))
        .withColumn("peak", F.greatest(F.coalesce(F.max("top").over(before), F.lit(0.0)), F.lit(0.0)))
        .groupBy(*run).agg(F.max(F.greatest(F.col("fall"), F.col("peak") - F.col("low"))).alias("max_drawdown"))
    )
    d = F.stddev_samp("d")
    ratio = F.when((F.count(F.lit(1)) >= 3) & (d > 0), F.avg("d") / d * float(samples_per_day * 252) ** 0.5).otherwise(0.0)
    totals = inner.groupBy(*run).agg(F.count(F.lit(1)).alias("n_samples"), F.max_by("e", "pos").alias("total_pnl"), ratio.alias("sharpe"))
    return totals.join(falls, run).select(*run, "n_samples", "total_pnl", "max_drawdown", "sharpe")


def fill_totals(fills: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per run: position, cash (gross of nothing: prices and fees), fees, volume, n_fills, n_passive, n_aggressive. Exact repeats count once, a NULL fee as 0.

    Money is summed in whole millionths, so the order of the rows doesn't matter.
    """
    micro = F.round(F.coalesce("fee", F.lit(0.0)) * 1_000_000).cast("bigint")
    paid = F.sum(-F.col("side").cast("bigint") * F.col("qty") * F.col("price")) * (1_000_000 // PRICE_SCALE)
    return (
        fills.distinct().groupBy(*run)
        .agg(
            F.sum(F.col("side") * F.col("qty")).alias("position"), ((paid - F.sum(micro)) / 1_000_000).alias("cash"), (F.sum(micro) / 1_000_000).alias("fees"),
            F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_fills"), F.count_if(F.col("passive") == 1).alias("n_passive"), F.count_if(F.col("passive") == 0).alias("n_aggressive"),
        )
    )


def describe(rows: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """keys, n, mean, std, min, q25, q50, q75 and max of a column of doubles, exactly; NULLs are left out, a key without values has n 0.

    Equal values are counted first. Quantiles interpolate between ranks; ranks are running counts inside buckets of near values, over one total per bucket, so that no key's
    values come to one task.
    """
    keys = list(keys)
    scale = F.floor(F.log2(F.abs("v")) * 16) + 20_000  # above 0 for every double
    bucket = F.when(F.col("v") > 0, scale).when(F.col("v") < 0, -scale).otherwise(0)
    counts = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("b", bucket)
    over = Window.partitionBy(*keys).orderBy("b")
    totals = counts.groupBy(*keys, "b").agg(F.sum("c").alias("t")).withColumns(
        {"off": F.coalesce(F.sum("t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("t").over(Window.partitionBy(*keys))}
    )
    inside = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("run", F.sum("c").over(inside)).join(totals, [*keys, "b"]).withColumn("end", F.col("off") + F.col("run"))
    at = lambda r: F.max(F.when((F.col("end") - F.col("c") <= r) & (r < F.col("end")), F.col("v")))

    def quantile(p: float) -> Column:
        place = (F.col("all") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    quantiles = ranked.groupBy(*keys).agg(quantile(0.25).alias("q25"), quantile(0.5).alias("q50"), quantile(0.75).alias("q75"))
    figures = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return figures.join(quantiles, keys, "left").select(*keys, "n", "mean", "std", "min", "q25", "q50", "q75", "max")
