"""Differences between copies and between snapshots, by signed cells.

Rows are unpivoted to (key, field, value) cells with a sign, + for one side and - for the other, and
a presence marker per key; what doesn't cancel in its group differs. Exact repeats are merged first, on the map side of
the exchange that brings them together, so that a key of very many copies is one row per map task. Rows are then placed by key once, still wide.
Where both sides hold the same rows of a key, all its cells cancel, and the key is let go as a whole; only what is left is unpivoted.
None of this needs a further exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import maybe_broadcast

MARK = -1  # field number of the presence marker
BLOCK = 64  # snapshots of a period whose comparisons are placed together


def _sides(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Equal rows of both signs as one, with ``__plus`` and ``__minus``: whether a side holds it."""
    has = lambda sign: F.max(F.when(F.col("__sign") == sign, 1).otherwise(0))
    return df.groupBy(*by).agg(has(1).alias("__plus"), has(-1).alias("__minus"))


def uncancelled(placed: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys whose cells don't cancel: keys, ``side`` (1 only on the plus side, -1 only on the minus side, 0 both), ``fields``.

    placed: keys and fields as of ``_sides``, the fields all of one type or castable to string, already placed by the keys or some of them. A cell (key,
    field, value) cancels if it occurs on both sides, however often; so repeats don't count. NULL equals NULL, in
    keys and values. ``fields``: the sorted names of the differing fields, empty where ``side`` isn't 0.
    """
    kinds = {t for c, t in placed.select(*fields).dtypes}
    whole = kinds <= {"tinyint", "smallint", "int", "bigint"}
    cell = lambda i, v: F.struct(F.lit(i).alias("field"), v.alias("value"))
    value = lambda c: F.col(c).cast("bigint" if whole else "string")
    marks = F.array(cell(MARK, F.lit(None).cast("bigint" if whole else "string")), *[cell(i, value(c)) for i, c in enumerate(fields)])
    open_ = placed.withColumn("__both", F.min(F.least("__plus", "__minus")).over(Window.partitionBy(*keys))).where("__both = 0")
    cells = (
        open_.select(*keys, "__plus", "__minus", F.explode(marks).alias("__cell"))
        .groupBy(*keys, F.col("__cell.field").alias("__field"), F.col("__cell.value").alias("__value"))
        .agg((F.max("__plus") - F.max("__minus")).alias("__net"))
        .where("__net <> 0")
    )
    side = F.coalesce(F.max(F.when(F.col("__field") == MARK, F.col("__net"))), F.lit(0))
    names = F.array(*[F.lit(c) for c in fields])
    return (
        cells.groupBy(*keys)
        .agg(side.alias("side"), F.sort_array(F.collect_set(F.when(F.col("__field") != MARK, F.col("__field")))).alias("at"))
        .select(*keys, "side", F.when(F.col("side") == 0, F.transform("at", lambda i: F.get(names, i))).otherwise(F.array().cast("array<string>")).alias("fields"))
    )


def diff_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Mapping[str, Column], only_left: str, only_right: str) -> DataFrame:
    """keys and ``diff``: a row per key that one copy lacks, else one per differing field.

    fields: name to the expression that is compared, in which spellings of one value are made equal.
    A key with several different rows in a copy agrees in a field if both copies hold the same set of values.
    Empty copies are fine; columns other than keys and fields aren't compared.
    """
    part = lambda df, sign: df.select(*keys, F.lit(sign).alias("__sign"), *[e.alias(c) for c, e in fields.items()])
    merged = _sides(part(left, 1).unionByName(part(right, -1)), [*keys, *fields])
    found = uncancelled(merged.repartition(*[F.col(c) for c in keys]), keys, list(fields))
    label = F.when(F.col("side") > 0, F.array(F.lit(only_left))).when(F.col("side") < 0, F.array(F.lit(only_right))).otherwise(F.col("fields"))
    return found.select(*keys, F.explode(label).alias("diff"))


def snapshot_changes(snaps: DataFrame, period: Sequence[str], number: str, keys: Sequence[str], fields: Mapping[str, Column], broadcast_rows: int = 50_000) -> DataFrame:
    """What changed from each full snapshot to the next: period, keys, ``number``, ``change``, ``fields``.

    Snapshots are the rows of equal (period, number); each is compared with the one of the greatest lower
    number present in its period, the first of a period with none. Each row counts + in its own snapshot's
    comparison and - in the next one's. change: added, removed or changed; fields: the differing fields of a changed record.
    Repeated deliveries are one. Rows with a NULL number are in no snapshot. The list of snapshots is broadcast only
    if it has at most ``broadcast_rows`` rows.

    Snapshots are numbered in their period, and a record's rows are placed by blocks of ``BLOCK`` numbers, so that a record of very many snapshots
    is many tasks' work. A row is sent once, and twice only at the end of a block; the two signs are given to it after that.
    """
    names = [f"__f{i}" for i in range(len(fields))]
    rows = snaps.where(F.col(number).isNotNull()).select(*period, F.col(number), *keys, *[e.alias(f) for e, f in zip(fields.values(), names)]).distinct()
    inside = Window.partitionBy(*period).orderBy(number)
    listing = (
        snaps.where(F.col(number).isNotNull()).select(*period, F.col(number)).distinct()
        .withColumn("__next", F.lead(number).over(inside)).withColumn("__at", F.row_number().over(inside))
        .select(*[F.col(c).alias(f"__p_{c}") for c in (*period, number)], "__next", "__at")
    )
    same = F.lit(True)
    for c in (*period, number):
        same = same & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    own, nxt = F.expr(f"__at div {BLOCK}"), F.expr(f"(__at + 1) div {BLOCK}")
    place = [*period, *keys, "__block"]
    placed = (
        rows.join(maybe_broadcast(listing, broadcast_rows), same)
        .withColumn("__block", F.explode(F.when(F.col("__next").isNotNull() & (own != nxt), F.array(own, nxt)).otherwise(F.array(own))))
        .select(*place, F.col(number).alias("__own"), "__next", "__at", *names)
        .repartition(*[F.col(c) for c in place])
    )
    twice = F.array(
        F.struct(F.when((F.col("__at") > 1) & (own == F.col("__block")), F.col("__own")).alias("cmp"), F.lit(1).alias("s")),
        F.struct(F.when(nxt == F.col("__block"), F.col("__next")).alias("cmp"), F.lit(-1).alias("s")),
    )
    signed = placed.withColumn("__x", F.explode(twice)).where("__x.cmp IS NOT NULL").select(*place, F.col("__x.cmp").alias("__cmp"), F.col("__x.s").alias("__sign"), *names)
    found = uncancelled(_sides(signed, [*place, "__cmp", *names]), [*place, "__cmp"], names)
    change = F.when(F.col("side") > 0, "added").when(F.col("side") < 0, "removed").otherwise("changed")
    real = F.array(*[F.lit(c) for c in fields])
    return found.select(
        *period, *keys, F.col("__cmp").alias(number), change.alias("change"),
        F.transform("fields", lambda f: F.get(real, F.substring(f, 4, 9).cast("int"))).alias("fields"),
    )
