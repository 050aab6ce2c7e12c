"""Irregular readings onto a regular grid, by validity intervals.

A reading holds from its own time until the next usable reading of its series: a step
function. Each validity interval is cut at the grid lines, so a cell's time-weighted
average is the sum of value x held time over the time covered.

Nothing orders a whole series in one task. Readings are ordered inside short slices of
time (``slices`` per cell); a slice is then one summary row, and only these summaries,
whose number per series depends on the span of time and not on the readings, are ordered
per series to carry a value over slice edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regular_grid(
    readings: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: str,
    values: Sequence[str],
    sums: Sequence[str],
    usable: Column,
    start: str,
    end: str,
    period: int,
    max_hold: int | None = None,
    slices: int = 60,
) -> DataFrame:
    """A row for every grid cell ``[period_ns, period_ns + period)`` of every span.

    readings: ``keys``, ``ts`` (integer time), ``order`` (tie-break inside one ``ts``: the greatest
    holds), ``values`` (step functions) and ``sums`` (quantities to add up). spans: ``keys``,
    ``start``, ``end``, one row per series; cells are the multiples of ``period`` in
    ``[start, end)``. A span without any reading row has no cells.

    Output: keys, ``period_ns``, ``n_readings`` (usable readings inside the cell), ``cover_ns``,
    ``coverage`` (covered share of the cell), ``<value>_twa`` (NULL where nothing covers the cell),
    ``<sum>_sum`` (over all usable readings, 0 if none) and ``status``: ``observed``, ``filled`` (covered
    only by a reading from before) or ``empty``.

    Defined cases: readings with a NULL time or for which ``usable`` isn't true don't count; exact
    repeats of a reading count once; a NULL in a summed column adds 0; NULL keys match no span;
    ``max_hold`` ends a validity that long after its reading. Other columns are ignored, whatever their names.
    """
    width = period // slices if period % slices == 0 else period
    k = [f"__k{i}" for i in range(len(keys))]
    v = [f"__v{i}" for i in range(len(values))]
    s = [f"__s{i}" for i in range(len(sums))]
    rows = (
        readings.where(usable & F.col(ts).isNotNull())
        .select(
            *[F.col(c).alias(n) for c, n in zip(keys, k)],
            F.col(ts).cast("bigint").alias("__t"),
            F.col(order).alias("__o"),
            *[F.col(c).cast("double").alias(n) for c, n in zip(values, v)],
            *[F.col(c).cast("bigint").alias(n) for c, n in zip(sums, s)],
        )
        .distinct()
        .withColumn("__slice", _floor_div("__t", width))
    )
    in_slice = Window.partitionBy(*k, "__slice").orderBy("__t", "__o", *v, *s)
    held = F.lead("__t").over(in_slice) - F.col("__t")
    if max_hold is not None:
        held = F.when(held.isNotNull(), F.least(held, F.lit(max_hold)))
    last = F.struct("__t", "__o", *v, *s)
    sliced = (
        rows.withColumn("__held", held)
        .groupBy(*k, "__slice")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.min("__t").alias("__first"),
            F.max(last).alias("__last"),
            F.coalesce(F.sum("__held"), F.lit(0)).alias("__cover"),
            *[F.coalesce(F.sum(F.col(c) * F.col("__held")), F.lit(0.0)).alias(f"{c}w") for c in v],
            *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}t") for c in s],
        )
    )
    per_series = Window.partitionBy(*k).orderBy("__slice")
    span = spans.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(start).cast("bigint").alias("__from"), F.col(end).cast("bigint").alias("__to"))
    until = F.least(F.col("__next"), F.col("__to"), *([F.col("__last.__t") + max_hold] if max_hold is not None else []))
    sums_of = [*[(f"{c}w", "double") for c in v], *[(f"{c}t", "bigint") for c in s]]
    kind = f"struct<__cell:bigint,__n:bigint,__cover:bigint{''.join(f',{c}:{t}' for c, t in sums_of)}>"

    def stretch(cell: Column) -> Column:
        """What the slice's last reading covers of a later cell."""
        part = F.least(F.col("__b"), (cell + 1) * period) - F.greatest(F.col("__a"), cell * period)
        return F.struct(cell, F.lit(0), part, *[F.col(f"__last.{c}") * part for c in v], *[F.lit(0) for _ in s]).cast(kind)

    # Inside a slice: belongs to one cell. From a slice's last reading on: to the next slice's first, over any number of cells.
    inside = F.struct(_floor_div("__slice", period // width), "__n", "__cover", *[c for c, _ in sums_of]).cast(kind)
    after = F.transform(F.sequence(_floor_div("__a", period), _floor_div(F.col("__b") - 1, period)), stretch)
    pieces = (
        sliced.withColumn("__next", F.lead("__first").over(per_series))
        .join(span, k)
        .withColumn("__a", F.greatest("__last.__t", F.col("__from")))
        .withColumn("__b", until)
        .select(*k, F.explode(F.concat(F.array(inside), F.when(F.col("__b") > F.col("__a"), after).otherwise(F.array().cast(f"array<{kind}>")))).alias("__x"))
        .select(*k, "__x.*")
    )
    filled = (
        pieces.groupBy(*k, "__cell")
        .agg(*[F.sum(c).alias(c) for c in ("__n", "__cover", *[c for c, _ in sums_of])])
    )
    first = -_floor_div(-F.col("__from"), period)
    present = readings.select(*[F.col(c).alias(n) for c, n in zip(keys, k)]).distinct()
    cells = (
        span.join(present, k, "left_semi")
        .withColumn("__n_cells", _floor_div(F.col("__to") - 1, period) - first + 1)
        .where("__n_cells > 0")
        .withColumn("__cell", F.explode(F.sequence(first, _floor_div(F.col("__to") - 1, period))))
        .select(*k, "__cell")
    )
    covered = F.coalesce("__cover", F.lit(0))
    n = F.coalesce("__n", F.lit(0))
    return cells.join(filled, [*k, "__cell"], "left").select(
        *[F.col(a).alias(b) for a, b in zip(k, keys)],
        (F.col("__cell") * period).alias("period_ns"),
        n.alias("n_readings"),
        covered.alias("cover_ns"),
        (covered / F.lit(float(period))).alias("coverage"),
        *[F.when(covered > 0, F.col(f"{c}w") / covered).alias(f"{name}_twa") for c, name in zip(v, values)],
        *[F.coalesce(f"{c}t", F.lit(0)).alias(f"{name}_sum") for c, name in zip(s, sums)],
        F.when(n > 0, "observed").when(covered > 0, "filled").otherwise("empty").alias("status"),
    )


def _floor_div(x: str | Column, by: int) -> Column:
    """Exact integer floor division: a BIGINT doesn't fit a double."""
    x = F.col(x) if isinstance(x, str) else x
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("bigint")), F.lit(by).cast("bigint"))
