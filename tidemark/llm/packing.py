"""Filling containers of several permitted capacities, by variable-capacity best fit.

Items of one size are interchangeable, so the packing is decided on the histogram of sizes, which has no more rows
than the largest capacity, and is then applied to the items in parallel. The largest size left opens a container:
for every capacity that holds it, the room left is filled best fit, each time with the largest size that fits;
the capacity with the least unused share is taken, downsized to the smallest that holds its contents. Such a
filling is repeated as a *pattern* as often as the counts allow, so that there are at most twice as many patterns as sizes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import ship


@dataclass(frozen=True)
class Pattern:
    capacity: int
    times: int
    contents: tuple[tuple[int, int], ...]  # (size, how many in each container)


def plan(histogram: dict[int, int], capacities: list[int]) -> list[Pattern]:
    """Patterns that use up the histogram (size above 0: count). No size may exceed the largest capacity."""
    caps = sorted(set(capacities))
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    sizes = sorted(left)
    patterns = []

    def fill(room: int, size: int) -> tuple[int, dict[int, int]]:
        inside = {size: 1}
        room -= size
        while room > 0 and (i := bisect_right(sizes, room)):
            while i and (free := left[sizes[i - 1]] - inside.get(sizes[i - 1], 0)) <= 0:
                i -= 1
            if not i:
                break
            x = sizes[i - 1]
            n = min(free, room // x)
            inside[x] = inside.get(x, 0) + n
            room -= n * x
        return room, inside

    while sizes:
        size = sizes[-1]
        best = None
        for cap in caps[bisect_left(caps, size) :]:
            room, inside = fill(cap, size)
            used = cap - room
            final = caps[bisect_left(caps, used)]
            cost = ((final - used) / final, -used)
            if best is None or cost < best[0]:
                best = (cost, final, inside)
        _, cap, inside = best
        times = min(left[s] // n for s, n in inside.items())
        patterns.append(Pattern(cap, times, tuple(sorted(inside.items()))))
        for s, n in inside.items():
            left[s] -= n * times
            if not left[s]:
                del sizes[bisect_left(sizes, s)]
    return patterns


def pack(sizes: DataFrame, item: str, size: str, specs: DataFrame, spec_id: str, capacity: str, rows_per_bucket: int = 500_000) -> DataFrame:
    """A row per piece of an item: item, ``piece_no``, ``from_unit``, ``n_units``, ``container_id``, ``spec_id``, ``capacity``.

    Every row of ``sizes`` comes out once, in one piece, unless its size exceeds the largest capacity: then as
    pieces of that capacity and one rest. A size of 0, below 0 or NULL counts as 0; such items take no room and are spread over
    the containers (a container of the smallest capacity if there is none). Specs with a NULL or non-positive
    capacity are ignored; of equal capacities the smallest ``spec_id`` is used. Raises ValueError without any capacity.

    ``sizes`` is read twice and should be a stored table. Items are numbered inside their size by
    (size, bucket) groups of about ``rows_per_bucket`` rows or less, so that one frequent size isn't one task.
    """
    usable = specs.where(f"{capacity} > 0").groupBy(capacity).agg(F.min(spec_id).alias(spec_id)).collect()  # as many rows as there are kinds of container
    by_cap = {int(x[capacity]): int(x[spec_id]) for x in usable}
    if not by_cap:
        raise ValueError("no container has a capacity")
    top = max(by_cap)
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    pieces = (
        sizes.select(F.col(item).alias("item"), n.alias("n"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr(f"(n - 1) div {top}"), F.lit(0)))))
        .select("item", "piece_no", (F.col("piece_no") * top).alias("from_unit"), F.least(F.col("n") - F.col("piece_no") * top, F.lit(top)).alias("n_units"))
    )
    histogram = {x["n_units"]: x["count"] for x in pieces.groupBy("n_units").count().collect()}  # at most top + 1 rows
    starts, width, base, bins = _segments(plan(histogram, list(by_cap)), histogram)
    buckets = max(1, -(-max(histogram.values(), default=0) // rows_per_bucket)) * 4
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "piece_no"), F.lit(buckets)))
    before = Window.partitionBy("n_units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("n_units", "bucket").count().select("n_units", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("n_units", "bucket").orderBy("item", "piece_no")
    ranked = (
        salted.withColumn("rn", F.row_number().over(inside))
        .join(offsets, ["n_units", "bucket"])
        .select("item", "piece_no", "from_unit", "n_units", (F.col("off") + F.col("rn") - 1).alias("rank"))
    )
    total = bins[-1][1] if bins else 0
    first_of = {}
    at = 0
    for s in sorted(histogram):
        if s > 0:
            first_of[s] = at
            at += histogram[s]
    shift = np.zeros(top + 1, np.int64)
    for s, x in first_of.items():
        shift[s] = x
    bin_from = np.array([b[0] for b in bins], np.int64)
    bin_cap = np.array([b[2] for b in bins], np.int64)
    small = min(by_cap)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            held = size > 0
            where = rank % max(total, 1)
            if len(starts):
                g = shift[size] + rank
                i = np.maximum(np.searchsorted(starts, g, "right") - 1, 0)
                where = np.where(held, base[i] + (g - starts[i]) // width[i], where)
            cap = bin_cap[np.searchsorted(bin_from, where, "right") - 1] if total else np.full(len(size), small)
            ids = np.vectorize(by_cap.get, otypes=[np.int64])(cap) if len(cap) else cap
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in range(4)], pa.array(where, pa.int64()), pa.array(ids, pa.int64()), pa.array(cap, pa.int64())],
                ["item", "piece_no", "from_unit", "n_units", "container_id", "spec_id", "capacity"],
            )

    ship(sizes.sparkSession)
    kind = sizes.schema[item].dataType.simpleString()
    return ranked.mapInArrow(place, f"item {kind}, piece_no bigint, from_unit bigint, n_units bigint, container_id bigint, spec_id bigint, capacity bigint").withColumnRenamed("item", item)


def _segments(patterns: list[Pattern], histogram: dict[int, int]):
    """The items, in the order of size and rank, as runs: start, items of the run's size in a container, first container; and (first, end, capacity) of patterns."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    bins, done = [], 0
    for p in patterns:
        for s, n in p.contents:
            runs.setdefault(s, []).append((n * p.times, n, done))
        bins.append((done, done + p.times, p.capacity))
        done += p.times
    starts, width, base, at = [], [], [], 0
    for s in sorted(runs):
        for count, n, first in runs[s]:
            starts.append(at)
            width.append(n)
            base.append(first)
            at += count
    return np.array(starts, np.int64), np.array(width, np.int64), np.array(base, np.int64), bins
