"""Row windows over long ordered series, in blocks.

A window over a whole series is one task. Here a series is numbered in two levels and cut into blocks of ``block``
rows; each block also gets the rows next to it that a frame can reach (a halo), so that any frame of a bounded
number of rows is exact inside its block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 200_000


def numbered(df: DataFrame, keys: Sequence[str], order: str, block: int = BLOCK, name: str = "pos", tie: str | None = None) -> DataFrame:
    """``name``: the 0-based place of each row in its series by ``order`` (BIGINT, not NULL), then by ``tie``."""
    # keys and part in one struct, which is never NULL: both uses of df are placed alike, so that it is moved once, and the join needs no placement of its own
    place = F.struct(*keys, F.expr(f"{order} div {block}").alias("__part"))
    cut = df.select(place.alias("__place"), *[c for c in df.columns if c not in keys])
    before = Window.partitionBy(*[F.col("__place")[k] for k in keys]).orderBy(F.col("__place")["__part"]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("__place").agg(F.count(F.lit(1)).alias("__n")).withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__place").orderBy(order, *([tie] if tie else []))
    return (
        cut.withColumn("__rn", F.row_number().over(inside)).join(sizes, "__place")
        .withColumn(name, (F.col("__off") + F.col("__rn") - 1).cast("bigint"))
        .select(*[F.col("__place")[c].alias(c) if c in keys else c for c in df.columns], name)
    )


def haloed(df: DataFrame, keys: Sequence[str], before: int, after: int, block: int = BLOCK, pos: str = "pos") -> tuple[DataFrame, WindowSpec, Column]:
    """The rows with copies for the halos, the window to use (``keys`` and block, by ``pos``) and the condition that marks a row's own copy.

    Filter by the condition after the window functions. Frames may reach ``before`` rows back and ``after`` rows on.
    """
    home = F.expr(f"{pos} div {block}")
    first, last = F.expr(f"greatest({pos} - {after}, 0) div {block}"), F.expr(f"({pos} + {before}) div {block}")
    copies = df.withColumn("__block", F.explode(F.sequence(first, last)))
    return copies, Window.partitionBy(*keys, "__block").orderBy(pos), F.col("__block") == home
