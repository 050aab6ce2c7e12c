"""Backward as-of join: the last right row at or before a left row's time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, right_order: str, value: str, bucket: int, name: str) -> DataFrame:
    """left with ``name``: ``value`` of the right row with the greatest time at or before ``left_ts``, of equal times the greatest ``right_order``.

    NULL where there is none. Right rows with a NULL time or value don't count; left rows with a NULL time or key get NULL.
    Both sides are cut into time buckets. Inside a bucket the last right row is found by a window over the union of both; what a
    bucket inherits comes from one summary row per bucket, so that no task orders a whole entity.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    cut = F.expr(f"__t div {bucket}")
    whole = F.col(right_ts).isNotNull() & F.col(value).isNotNull()
    for c in by:
        whole = whole & F.col(c).isNotNull()
    r = (
        right.where(whole)
        .select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(right_ts).cast("bigint").alias("__t"), F.col(right_order).alias("__o"), F.col(value).alias("__v"))
        .withColumn("__b", cut)
    )
    l = left.withColumns({k: F.col(c) for c, k in zip(by, keys)}).withColumn("__t", F.col(left_ts).cast("bigint")).withColumn("__b", cut)
    pack = F.struct(*left.columns)
    both = (
        l.select(*keys, "__b", "__t", F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__o"].dataType).alias("__o"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), pack.alias("__row"))
        .unionByName(r.select(*keys, "__b", "__t", F.lit(0).alias("__side"), "__o", "__v", F.lit(None).cast(l.select(pack.alias("p")).schema["p"].dataType).alias("__row")))
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", "__o")
    near = both.withColumn("__here", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1")
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = r.groupBy(*keys, "__b").agg(F.max(F.struct("__t", "__o", "__v")).alias("__end")).select(*keys, "__b", F.col("__end.__v").alias("__end"), F.lit(0).alias("__ask"))
    asks = l.where("__t IS NOT NULL").select(*keys, "__b").distinct().select(*keys, "__b", F.lit(None).cast(r.schema["__v"].dataType).alias("__end"), F.lit(1).alias("__ask"))
    carried = (
        ends.unionByName(asks).groupBy(*keys, "__b").agg(F.max("__end").alias("__end"), F.max("__ask").alias("__ask"))
        .withColumn("__before", F.last("__end", ignorenulls=True).over(before)).where("__ask = 1").select(*keys, "__b", "__before")
    )
    return near.join(carried, [*keys, "__b"], "left").select("__row.*", F.coalesce("__here", "__before").alias(name))
