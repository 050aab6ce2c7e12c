"""Constants and schemas of order-flow data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
PRICE_SCALE = 10_000
TICK = 100
NS_PER_SEC = 1_000_000_000
NO_ASK = 9_999_999_999
NO_BID = -9_999_999_999
BUY, SELL = 1, -1
NEW_LIMIT, PARTIAL_CANCEL, DELETE, EXEC_VISIBLE, EXEC_HIDDEN, CROSS, HALT = 1, 2, 3, 4, 5, 6, 7

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("type", T.ByteType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("price", T.LongType()),
        T.StructField("direction", T.ByteType()),
    ]
)


def depth_columns(levels: int) -> list[str]:
    """Names of the wide depth columns, level by level."""
    return [f"{side}_{what}_{j}" for j in range(1, levels + 1) for side in ("ask", "bid") for what in ("px", "sz")]


def depth_schema(levels: int) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType() if "_px_" in c else T.IntegerType()) for c in depth_columns(levels)])


def real_price(name: str) -> Column:
    """A price with both spellings of an empty side as NULL."""
    return F.when(~F.col(name).isin(NO_ASK, NO_BID), F.col(name))


def real_size(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))
