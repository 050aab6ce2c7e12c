"""Applying a stream of inserts, updates and deletes, by composing patches.

The ordered operations on a key are a function from its state before to its state after; ``patches`` has
such functions as values that compose. So the feed is cut into ranges of
``seq``, also inside one hot key; each range folds to one patch, patches of neighbouring ranges
are composed in a tree, and the last one is applied to the base. No task holds more than
``chunk`` operations or ``fan_in`` patches of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patches import Patches

PLAIN = Patches()
PATCH = PLAIN.type


def apply_feed(
    ops: DataFrame, keys: Sequence[str], order: str, last: int, largest: int, base: DataFrame | None = None, state: str = "size_left", chunk: int = 4096, fan_in: int = 256
) -> DataFrame:
    """The state of every key that exists after all operations: keys and ``state`` (BIGINT, above 0).

    ops: keys, ``order`` (BIGINT, unique inside a key), ``op``, ``qty``. last: a bound on ``order``, from which the height of
    the tree follows (1 where every range is the first). largest: a bound on the quantities of opens and the base's states.
    base: keys and ``state`` before the feed, one row per key; without it nothing exists before. Base
    records that no operation names stay as they are. NULL key parts are values of their own.
    An empty feed gives the base; operations that meet no existing record have no effect, opens apart.
    """
    keys = list(keys)
    level = (
        ops.withColumn("part", F.expr(f"{order} div {chunk}"))
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "op", "qty"))).alias("xs"))
    )
    step, parts = (lambda f, x: PLAIN.then(f, x, largest)), max(last, 0) // chunk + 1
    while parts > 1:
        patched = F.aggregate("xs", PLAIN.identity(), step, lambda f: PLAIN.thin(f, largest))
        level = (
            level.select(*keys, F.expr(f"part div {fan_in}").alias("up"), F.struct(F.col("part").alias("at"), patched.alias("patch")).alias("x"))
            .groupBy(*keys, F.col("up").alias("part"))
            .agg(F.sort_array(F.collect_list("x")).alias("xs"))
        )
        step, parts = (lambda f, x: PLAIN.compose(f, x["patch"], largest)), (parts - 1) // fan_in + 1
    exists = lambda s: s > 0
    if base is None:  # in the aggregate's last step and an explode, so that it is evaluated once
        done = F.aggregate("xs", PLAIN.identity(), step, lambda f: F.filter(F.array(PLAIN.apply(f, PLAIN.absent())["size"]), exists))
        return level.select(*keys, F.explode(done).alias(state))
    patched = F.aggregate("xs", PLAIN.identity(), step, lambda f: PLAIN.thin(f, largest))
    both = level.select(*keys, patched.alias("patch"), F.lit(0).cast("bigint").alias("__old")).unionByName(
        base.select(*keys, F.lit(None).cast(PATCH).alias("patch"), F.col(state).cast("bigint").alias("__old"))
    )
    merged = both.groupBy(*keys).agg(F.max("__old").alias("__old"), F.first("patch", ignorenulls=True).alias("patch"))
    after = F.coalesce(PLAIN.apply(F.col("patch"), F.struct(F.col("__old").alias("size")))["size"], F.col("__old"))
    return merged.select(*keys, F.explode(F.filter(F.array(after), exists)).alias(state))
