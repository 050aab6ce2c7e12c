"""Pairing each record with the nearest record in time of the same entity.

Both tables are range-partitioned together by (entity, time), so that an entity of any size spans as many
tasks as it needs. Each partition, sorted, says which right records lie at its edges; a prefix scan over
these few rows gives every partition the last right record before it and the first one after it, if they
belong to an entity that continues there. Then each partition is scanned on its own, batch by batch.

The inputs are evaluated once; sampling, placing and scanning read what was stored. Nothing of the scan passes through the driver's Python or a closure: the edges
are a table, and what the scan finds is joined to the first row of each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import checkpointed, materialize, ship

FAR = np.iinfo(np.int64).max
ROWS_PER_TASK = 250_000
MOST_TASKS = 100_000  # beyond so many, tasks get more rows; it bounds the table of edges
STRETCH = 512  # partitions that one step of the prefix scan covers


def nearest_join(
    left: DataFrame, right: DataFrame, entity: str, left_ts: str, left_id: str, right_ts: str, right_id: str, tolerance: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """entity, ``left_ts``, ``left_id``, ``right_id`` and ``distance``: one row per distinct left record.

    Times are integers of one unit, ids integers. The right record is the one of the same entity with the
    smallest |left_ts - right_ts|, if that is at most ``tolerance``; else ``right_id`` and ``distance`` are NULL. At equal
    distance the earlier right record holds, at one time the one with the smallest id. Repeated rows are one. A left record with a NULL
    entity or time has no partner; a right record with a NULL entity, time or id is none. Other columns are ignored.
    """
    l = left.select(F.col(entity).alias("e"), F.col(left_ts).cast("bigint").alias("t"), F.col(left_id).cast("bigint").alias("lid")).distinct()
    r = (
        right.select(F.col(entity).alias("e"), F.col(right_ts).cast("bigint").alias("t"), F.col(right_id).cast("bigint").alias("rid"))
        .where("e IS NOT NULL AND t IS NOT NULL AND rid IS NOT NULL")
        .groupBy("e", "t")
        .agg(F.min("rid").alias("rid"))
    )
    no = F.lit(None).cast("bigint")
    both = r.select("e", "t", F.lit(0).alias("side"), no.alias("lid"), "rid").unionByName(l.select("e", "t", F.lit(1).alias("side"), "lid", no.alias("rid")))
    ship(left.sparkSession)
    spark = left.sparkSession
    kept = materialize(both)
    rows = kept.count()
    least = min(spark.sparkContext.defaultParallelism, -(-rows // 20_000))
    tasks = min(max(1, least, -(-rows // rows_per_task)), MOST_TASKS)
    by = ["e", "t", "side", "lid"]
    placed = checkpointed(kept.where("e IS NOT NULL AND t IS NOT NULL").repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("row", F.monotonically_increasing_id()))
    kind = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("first_e", placed.schema["e"].dataType), T.StructField("last_e", placed.schema["e"].dataType)])
    for c in ("first_t", "first_id", "last_t", "last_id"):
        kind = kind.add(c, T.LongType())
    carries = _carries(placed.mapInArrow(_edges, kind))
    out = T.StructType([placed.schema["e"], placed.schema["t"], T.StructField("lid", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("distance", T.LongType())])
    first = F.shiftleft(F.col("pid").cast("bigint"), 33) == F.col("row")  # the first row of a partition; at most MOST_TASKS rows are broadcast
    matched = placed.join(F.broadcast(carries), first, "left").select(*placed.columns, *CARRIED).mapInArrow(lambda batches: _scan(batches, tolerance), out)
    lost = kept.where("side = 1 AND (e IS NULL OR t IS NULL)").select("e", "t", "lid", no.alias("rid"), no.alias("distance"))
    return matched.unionByName(lost).select(F.col("e").alias(entity), F.col("t").alias(left_ts), F.col("lid").alias(left_id), F.col("rid").alias(right_id), "distance")


CARRIED = ("before_t", "before_id", "after_t", "after_id")


def _carries(edges: DataFrame) -> DataFrame:
    """pid and, of the right record before the partition and of the one after it, time and id, each for the entity that goes on there."""
    before = edges.select(F.col("last_e").alias("e"), (F.col("pid") * 2 + 1).alias("at"), F.when(F.col("last_t").isNotNull(), F.struct(F.col("last_t").alias("t"), F.col("last_id").alias("id"))).alias("r"))
    after = edges.select(F.col("first_e").alias("e"), (1 - F.col("pid") * 2).alias("at"), F.when(F.col("first_t").isNotNull(), F.struct(F.col("first_t").alias("t"), F.col("first_id").alias("id"))).alias("r"))
    asks = lambda who, sign: edges.select(F.col(who).alias("e"), (F.col("pid") * 2 * sign).alias("at"), F.lit(None).alias("r"))
    left, right = _last_before(before.unionByName(asks("first_e", 1))), _last_before(after.unionByName(asks("last_e", -1)))
    return left.select((F.col("at") / 2).cast("int").alias("pid"), F.col("r.t").alias("before_t"), F.col("r.id").alias("before_id")).join(
        right.select((-F.col("at") / 2).cast("int").alias("pid"), F.col("r.t").alias("after_t"), F.col("r.id").alias("after_id")), "pid"
    )


def _last_before(events: DataFrame) -> DataFrame:
    """The even places of each entity with the last record before them: a prefix scan in two steps, inside stretches of partitions and over one total per stretch."""
    cut = events.withColumn("part", F.floor(F.col("at") / (2 * STRETCH)))
    inside = Window.partitionBy("e", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("e").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("e", "part").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("at"))).alias("total"))
    totals = totals.select("e", "part", F.last("total", ignorenulls=True).over(over).alias("carried"))
    own = cut.withColumn("own", F.last("r", ignorenulls=True).over(inside)).where("at % 2 = 0")
    return own.join(totals, ["e", "part"]).select("at", F.coalesce("own", "carried").alias("r"))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first_e = last_e = first = last = pid = None
    alone = True  # only the first entity so far
    schema = None
    for b in batches:
        if not b.num_rows:
            continue
        schema = b.schema
        e = b.column("e")
        is_right = b.column("side").to_numpy() == 0
        if first_e is None:
            first_e, pid = e[0].as_py(), b.column("row")[0].as_py() >> 33
        end = e[len(e) - 1].as_py()
        if first is None and alone:
            here = np.flatnonzero(is_right & pc.equal(e, e[0]).to_numpy(zero_copy_only=False)) if e[0].as_py() == first_e else []
            if len(here):
                first = (b.column("t")[here[0]].as_py(), b.column("rid")[here[0]].as_py())
        alone = alone and end == first_e
        here = np.flatnonzero(is_right & pc.equal(e, e[len(e) - 1]).to_numpy(zero_copy_only=False))
        if len(here):
            last = (b.column("t")[here[-1]].as_py(), b.column("rid")[here[-1]].as_py())
        elif end != last_e:
            last = None
        last_e = end
    if schema is not None:
        f, l = first or (None, None), last or (None, None)
        kind = schema.field("e").type
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid], pa.int32()), pa.array([first_e], kind), pa.array([last_e], kind), *[pa.array([x], pa.int64()) for x in (*f, *l)]],
            ["pid", "first_e", "last_e", "first_t", "first_id", "last_t", "last_id"],
        )


def _scan(batches: Iterator[pa.RecordBatch], tolerance: int) -> Iterator[pa.RecordBatch]:
    """Rows are held back until the next right record of their entity has come, or the entity's end."""
    held, before, after = None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        if held is None:  # the partition's first row carries what its edges need
            x = [b.column(c)[0].as_py() for c in CARRIED]
            before, after = (x[0], x[1]) if x[0] is not None else None, (x[2], x[3]) if x[2] is not None else None
        rows = pa.table(b.select(["e", "t", "side", "lid", "rid"]))
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        e, n = rows.column("e").combine_chunks(), rows.num_rows
        last = pc.equal(e, e[n - 1]).to_numpy(zero_copy_only=False)
        right = np.flatnonzero(last & (rows.column("side").to_numpy() == 0))
        cut = int(right[-1]) + 1 if len(right) else int(np.argmax(last))  # up to here all is known
        if cut:
            yield from _matched(rows.slice(0, cut), before, None, tolerance)
            before = (rows.column("t")[cut - 1].as_py(), rows.column("rid")[cut - 1].as_py()) if len(right) else None
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield from _matched(held, before, after, tolerance)


def _matched(rows: pa.Table, before: tuple | None, after: tuple | None, tolerance: int) -> Iterator[pa.RecordBatch]:
    """The left rows with their nearest right record; before and after: those of the first and of the last entity beyond the rows."""
    e, t = rows.column("e").combine_chunks(), rows.column("t").to_numpy()
    is_right = rows.column("side").to_numpy() == 0
    rid = rows.column("rid").combine_chunks().fill_null(0).to_numpy()
    n, at = len(t), np.arange(len(t))
    new = np.concatenate([[True], pc.not_equal(e.slice(1), e.slice(0, n - 1)).to_numpy(zero_copy_only=False)]) if n > 1 else np.array([True])
    start = np.maximum.accumulate(np.where(new, at, 0))
    end = np.minimum.accumulate(np.where(np.append(new[1:], True), at, n)[::-1])[::-1]
    prev = np.maximum.accumulate(np.where(is_right, at, -1))
    nxt = np.minimum.accumulate(np.where(is_right, at, n)[::-1])[::-1]
    ok_p, ok_n = prev >= start, nxt <= end
    pt, pid = np.where(ok_p, t[prev], 0), np.where(ok_p, rid[prev], 0)
    nt, nid = np.where(ok_n, t[np.minimum(nxt, n - 1)], 0), np.where(ok_n, rid[np.minimum(nxt, n - 1)], 0)
    if before:
        take = ~ok_p & (start == 0)
        pt[take], pid[take], ok_p = before[0], before[1], ok_p | take
    if after:
        take = ~ok_n & (end == n - 1)
        nt[take], nid[take], ok_n = after[0], after[1], ok_n | take
    dp, dn = np.where(ok_p, t - pt, FAR), np.where(ok_n, nt - t, FAR)
    back = dp <= dn
    near = np.where(back, dp, dn)
    want = ~is_right
    none = ((near > tolerance) | ~(ok_p | ok_n))[want]
    yield from pa.table(
        {
            "e": e.filter(pa.array(want)),
            "t": t[want],
            "lid": rows.column("lid").filter(pa.array(want)),
            "rid": pa.array(np.where(back, pid, nid)[want], mask=none),
            "distance": pa.array(near[want], mask=none),
        }
    ).to_batches()
