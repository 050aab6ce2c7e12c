"""References to records that don't exist, by a fixpoint cascade of semi-joins.

``orphan_cascade`` works on any graph of tables and foreign keys. ``stale_references`` is the case in which
the parent is a *state*: a message refers to an order that must rest just before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .lifecycle import CLOSE, OPEN
from .paged import PAGE, paged_fold
from .patches import Patches


@dataclass(frozen=True)
class ForeignKey:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def orphan_cascade(tables: Mapping[str, DataFrame], ids: Mapping[str, Sequence[str]], fks: Sequence[ForeignKey]) -> dict[str, DataFrame]:
    """For each table its orphaned rows: id columns, ``kind`` (``direct`` / ``inherited``) and ``depth``.

    direct (depth 0): some foreign key without NULLs has no parent row. inherited (depth n): not direct, and a
    parent row is an orphan of depth n - 1; found round by round by semi-joins with the orphans
    of the round before, until a round finds none (cycles end so too). A row is reported once, at
    its least depth. A key with a NULL part refers to nothing. Repeated id rows are one row.
    Only key columns are moved. Every round finds a row that no round before has found, so the rounds end.
    """
    need = {t: {*ids[t], *[c for k in fks if k.child == t for c in k.columns], *[c for k in fks if k.parent == t for c in k.parent_columns]} for t in tables}
    slim = {t: df.select(*sorted(need[t])).distinct() for t, df in tables.items()}

    def link(k: ForeignKey, child: DataFrame, parent: DataFrame, how: str) -> DataFrame:
        keys = [f"__p{i}" for i in range(len(k.columns))]
        right = parent.select(*[F.col(c).alias(n) for c, n in zip(k.parent_columns, keys)]).distinct()
        return child.join(right, reduce(Column.__and__, [F.col(c) == F.col(n) for c, n in zip(k.columns, keys)]), how)

    def whole(k: ForeignKey) -> Column:
        return reduce(Column.__and__, [F.col(c).isNotNull() for c in k.columns])

    found: dict[str, DataFrame] = {}
    fresh: dict[str, DataFrame] = {}
    for t in tables:
        parts = [link(k, slim[t].where(whole(k)), slim[k.parent], "left_anti") for k in fks if k.child == t]
        if parts:
            fresh[t] = materialize(reduce(DataFrame.unionByName, parts).distinct())
            found[t] = fresh[t].withColumn("depth", F.lit(0))
    for depth in count(1):
        nxt: dict[str, DataFrame] = {}
        for t in found:
            parts = [link(k, slim[t].where(whole(k)), fresh[k.parent], "left_semi") for k in fks if k.child == t and k.parent in fresh]
            if parts:
                seen = found[t].drop("depth")
                same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in seen.columns])
                new = reduce(DataFrame.unionByName, parts).distinct().alias("a").join(seen.alias("b"), same, "left_anti")
                new = materialize(new)
                if not new.isEmpty():
                    nxt[t] = new
        if not nxt:
            break
        for t, new in nxt.items():
            found[t] = found[t].unionByName(new.withColumn("depth", F.lit(depth)))
        fresh = nxt
    kind = F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("kind")
    return {t: df.groupBy(*ids[t]).agg(F.min("depth").alias("depth")).select(*ids[t], kind, "depth") for t, df in found.items()}


PLAIN = Patches()
PAGE_RESULT = f"struct<state:{PLAIN.state},orphan:boolean,orphans:array<struct<seq:bigint,inherited:boolean>>>"


def _read(items: Column, state: Column) -> Column:
    """Walk one order's operations of a page from the state before it: the state after it, its orphans, and whether the last operation is one."""
    start = F.struct(state.alias("state"), F.lit(False).alias("orphan"), F.array().alias("orphans")).cast(PAGE_RESULT)

    def step(acc: Column, x: Column) -> Column:
        size = acc["state"]["size"]
        rests, opens = size > 0, x["op"] == OPEN
        orphan = ~rests & ~opens
        after = F.when(opens, F.when(rests, size).otherwise(x["qty"])).when(x["op"] == CLOSE, F.lit(0)).otherwise(F.greatest(size - x["qty"], F.lit(0)))
        one = F.array(F.struct(x["at"].alias("seq"), acc["orphan"].alias("inherited")))
        listed = F.when(orphan, F.concat(acc["orphans"], one)).otherwise(acc["orphans"])
        return F.struct(F.struct(after.alias("size")).alias("state"), orphan.alias("orphan"), listed.alias("orphans")).cast(PAGE_RESULT)

    return F.aggregate(items, start, step)


def stale_references(ops: DataFrame, keys: Sequence[str], order: str, page: int = PAGE) -> DataFrame:
    """keys, ``order`` and ``kind`` of every reduce or close whose record doesn't rest just before it.

    ``direct``: the record was never opened, is opened only later, or has just gone. ``inherited``: the
    reference before it, on the same record, is an orphan already, so that it descends from one.

    The graph: the operations of a record hang on one another in their order, and so do its pages (see ``paged_fold``). A fixpoint of semi-joins settles which pages
    have a living parent. The references at the head of a page without one are orphans (kept by an anti-join), up to the next open; they inherit where the
    parent page ends on an orphan, which a last join down the chain tells. An empty feed has no orphans; NULL key parts are values of their own.
    """
    pages = paged_fold(ops, keys, order, PLAIN, [], _read, page)
    broken = pages.where("r.orphan").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("page").alias("__page"), F.lit(True).alias("__broken"))
    listed = lambda df, headed: df.select(*keys, F.explode("r.orphans").alias("o"), headed.alias("h")).select(
        *keys, F.col("o.seq").alias(order), F.when(F.col("o.inherited") | F.coalesce(F.col("o.seq") == F.col("h"), F.lit(False)), "inherited").otherwise("direct").alias("kind")
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("parent") == F.col("__page")])
    some = pages.where(F.size("r.orphans") > 0)
    first, later = some.where("parent IS NULL"), some.where("parent IS NOT NULL")
    return listed(first, F.lit(None).cast("bigint")).unionByName(listed(later.join(broken, same, "left"), F.when(F.col("__broken"), F.col("head"))))
