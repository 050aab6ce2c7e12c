"""Regressions and correlations of order flow with price changes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signals import SESSION, bucket_ofi, event_signals, queue_imbalance

SECOND = 1_000_000_000


def regression(points: DataFrame, x: str, y: str, by: Sequence[str], order: str, lags: int = 5) -> DataFrame:
    """Per group of ``by``: n, slope, intercept, r2, ``t_hac`` (Newey-West with ``lags`` lags over ``order``) and ``t_ols``.

    t_ols divides by the residuals' population variance. NULLs in x or y are left out; a statistic whose
    denominator is 0 is NULL. Groups are series of buckets.
    """
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    means = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    centred = p.join(means, list(by)).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    sums = centred.groupBy(*by).agg(F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.sum(F.col("dx") * F.col("dy")).alias("sxy"), F.sum(F.col("dy") * F.col("dy")).alias("syy"))
    w = Window.partitionBy(*by).orderBy(order)
    e = F.col("dy") - F.col("slope") * F.col("dx")
    scored = centred.join(sums.withColumn("slope", _over(F.col("sxy"), F.col("sxx"))), list(by)).withColumn("e", e).withColumn("u", F.col("dx") * F.col("e"))
    for k in range(1, lags + 1):
        scored = scored.withColumn(f"c{k}", F.col("u") * F.lag("u", k).over(w))
    weighted = F.sum(F.col("u") * F.col("u"))
    for k in range(1, lags + 1):
        weighted = weighted + F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) * (2.0 * (1 - k / (lags + 1)))
    out = scored.groupBy(*by, "n", "mx", "my", "sxx", "syy", "slope").agg(weighted.alias("s"), F.sum(F.col("e") * F.col("e")).alias("see"))
    hac = _over(F.sqrt(F.when(F.col("s") > 0, F.col("s"))), F.col("sxx"))
    ols = F.sqrt(_over(F.col("see") / F.col("n"), F.col("sxx")))
    return out.select(
        *by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), (F.lit(1.0) - _over(F.col("see"), F.col("syy"))).alias("r2"),
        _over(F.col("slope"), hac).alias("t_hac"), _over(F.col("slope"), ols).alias("t_ols"),
    )


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over a group, NULL where x or y doesn't vary. ``F.corr`` divides by zero there whatever stands around it: aggregates are computed before conditions."""
    varied = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varied, _over(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def ofi_regression(features: DataFrame, bucket_s: float = 10.0, keys: Sequence[str] = SESSION, lags: int = 5) -> DataFrame:
    """dmid = a + b * OFI per session over buckets, with mean depth and slope x depth."""
    b = bucket_ofi(features, int(bucket_s * SECOND), keys)
    depth = b.groupBy(*keys).agg(F.avg("depth").alias("mean_depth"))
    return regression(b, "ofi", "dmid_ticks", keys, "bucket", lags).join(depth, list(keys)).withColumn("slope_x_depth", F.col("slope") * F.col("mean_depth"))


def bucket_sweep(features: DataFrame, buckets_s: Iterable[int] = (1, 5, 10, 30, 60), keys: Sequence[str] = SESSION) -> DataFrame:
    """The regression for several bucket lengths in one pass: the events are multiplied by the lengths and grouped once."""
    many = features.withColumn("bucket_s", F.explode(F.array(*[F.lit(int(b)).cast("bigint") for b in buckets_s])))
    wide = [*keys, "bucket_s"]
    b = (
        many.where("mid IS NOT NULL")
        .groupBy(*wide, F.expr(f"ts_ns div (bucket_s * {SECOND}) * (bucket_s * {SECOND})").alias("bucket"))
        .agg(F.sum("ofi_e").alias("ofi"), F.max_by("mid", "seq").alias("mid_end"), ((F.avg("bid_qty") + F.avg("ask_qty")) / 2).alias("depth"))
        .withColumn("dmid_ticks", (F.col("mid_end") - F.lag("mid_end").over(Window.partitionBy(*wide).orderBy("bucket"))) * 100)
        .where("dmid_ticks IS NOT NULL")
    )
    depth = b.groupBy(*wide).agg(F.avg("depth").alias("mean_depth"))
    return regression(b, "ofi", "dmid_ticks", wide, "bucket").join(depth, wide).withColumn("slope_x_depth", F.col("slope") * F.col("mean_depth"))


def predictive_table(features: DataFrame, windows: Iterable[int] = (20, 50, 100), horizons: Iterable[int] = (10, 50, 200), keys: Sequence[str] = SESSION) -> DataFrame:
    """Correlation of each signal now with the mid change ahead: keys, signal, horizon_events, corr, n (pairs without NULL)."""
    windows, horizons = list(windows), list(horizons)
    s = event_signals(features, rolling=windows, forward=horizons, keys=keys).withColumn("queue_imbalance", queue_imbalance())
    signals = [*[f"ofi_w{w}" for w in windows], "queue_imbalance"]
    cells = [(a, h) for a in signals for h in horizons]
    aggs = []
    for i, (a, h) in enumerate(cells):
        both = F.col(a).isNotNull() & F.col(f"fwd_{h}").isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(f"fwd_{h}"))
        aggs += [_correlation(x, y).alias(f"c{i}"), F.count_if(both).alias(f"n{i}")]
    wide = s.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("signal"), F.lit(h).alias("horizon_events"), F.col(f"c{i}").alias("corr"), F.col(f"n{i}").alias("n")) for i, (a, h) in enumerate(cells)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
