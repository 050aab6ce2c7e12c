"""Orders as keyed records under a feed of open / reduce / close operations.

``operations`` brings order messages into that shape; ``changefeed`` and ``orphans`` build on it.
State of a key: its remaining quantity, 0 while it doesn't rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, REDUCE, CLOSE = 1, 2, 3


def latest_versions(messages: DataFrame) -> DataFrame:
    """One row per (symbol, trade_date, seq): the version with the greatest recv_ts.

    Equal recv_ts: the greatest content (type, order_id, size) holds; a NULL recv_ts is before any other.
    Rows with a NULL seq have no place in the order and are left out. Repeats are merged before the shuffle.
    """
    return (
        messages.where("seq IS NOT NULL")
        .groupBy("symbol", "trade_date", "seq")
        .agg(F.max(F.struct("recv_ts", "type", "order_id", "size")).alias("m"))
        .select("symbol", "trade_date", "seq", "m.type", "m.order_id", "m.size")
    )


def operations(messages: DataFrame) -> DataFrame:
    """symbol, trade_date, order_id, seq, op, qty: type 1 opens, 2 and 4 reduce, 3 closes.

    Messages without an order (order_id NULL or 0) and other types are no operations. A NULL or
    negative size counts as 0: such an open rests nothing, such a reduction takes nothing off.
    """
    size = F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0))
    return (
        latest_versions(messages)
        .where("type BETWEEN 1 AND 4 AND order_id <> 0")
        .select(
            "symbol",
            "trade_date",
            "order_id",
            "seq",
            F.when(F.col("type") == 1, OPEN).when(F.col("type") == 3, CLOSE).otherwise(REDUCE).cast("tinyint").alias("op"),
            size.alias("qty"),
        )
    )
