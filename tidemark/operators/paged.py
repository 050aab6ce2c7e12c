"""Folding a key's operations in order, a page at a time, with a fixpoint over pages.

A key of any size is cut into pages of consecutive order numbers. The pages of a key form a chain of children and parents: each is read from the
record that its parent leaves behind. Every page is read once as if there were none. Then, round by round, semi-joins find the pages whose
outcome still hangs on an unsettled parent, and join each with that parent: either the parent is settled, and then so is the child, or the child takes
over the parent's patch and hangs on the parent's parent from now on. So the stretch that a page has resolved doubles with each round, and a chain of n unsettled
pages takes log2(n) rounds. The operations themselves are stored once and never moved in a round. In the end an anti-join keeps the readings of the pages
without a living parent, the others are read again from what it left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .patches import Patches

PAGE = 64
SUPER = 8192  # pages that one task links to one another, so half a million order numbers


def paged_fold(ops: DataFrame, keys: Sequence[str], order: str, patches: Patches, item: Sequence[Column], read: Callable[[Column, Column], Column], page: int = PAGE) -> DataFrame:
    """keys, ``page``, ``parent`` (NULL for a key's first page), ``head`` (its first order number) and ``r`` = read(items, record before the page).

    ops: keys, ``order`` (BIGINT, not NULL, unique inside a key), ``op``, ``qty`` and the fields of ``patches``. item: what else ``read`` gets of each row. ``read``
    gets the rows of a page in order as an array, with ``at`` for the order number, and must follow the rules of ``patches``.
    """
    keys = list(keys)
    near = [*keys, "super"]
    at = ops.withColumn("page", F.expr(f"{order} div {page}")).withColumn("super", F.expr(f"page div {SUPER}"))
    fields = F.struct(F.col(order).alias("at"), "op", "qty", *patches.fields, *item)
    # one exchange, by key and stretch, serves the pages and their links
    pages = at.repartition(*[F.col(c) for c in near]).groupBy(*near, "page").agg(F.sort_array(F.collect_list(fields)).alias("items"))
    by = Window.partitionBy(*near).orderBy("page")
    linked = pages.withColumns({"parent": F.lag("page").over(by), "child": F.lead("page").over(by)})
    table = materialize(
        linked.select(*near, "page", "parent", "child", F.element_at("items", 1)["at"].alias("head"), read(F.col("items"), patches.absent()).alias("r"), "items", F.array_max(F.transform("items", lambda x: x["qty"])).alias("most"))
    )
    table = _across(table, keys)
    alive = _openings(table, keys, patches)
    heads, kids = table.where("parent IS NULL"), table.where("parent IS NOT NULL")
    same = _same(keys, {"page": "__page"})
    kept = kids.join(alive, same, "left_anti")
    again = kids.drop("r").join(alive, same).withColumn("r", read(F.col("items"), F.col("opening")))
    out = lambda df: df.select(*keys, "page", "parent", "head", "r")
    return out(heads).unionByName(out(kept)).unionByName(out(again))


def _same(keys: Sequence[str], others: dict[str, str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(a) == F.col(b) for a, b in others.items()])


def _across(table: DataFrame, keys: list[str]) -> DataFrame:
    """The pages with their links from one stretch of ``SUPER`` pages to the next as well. Without a second stretch there are none to add."""
    if table.where("super > 0").isEmpty():
        return table
    far = table.where("super > 0").select(*keys).distinct().select(*[F.col(k).alias(f"__{k}") for k in keys])
    ends = table.where("parent IS NULL OR child IS NULL").join(far, _same(keys, {}), "left_semi")
    stretch = ends.groupBy(*keys, "super").agg(F.min("page").alias("first"), F.max("page").alias("last"))  # a row per stretch
    by = Window.partitionBy(*keys).orderBy("super")
    over = stretch.withColumns({"up": F.lag("last").over(by), "down": F.lead("first").over(by)})
    cols = [F.col(k).alias(f"__{k}") for k in keys]
    links = over.where("up IS NOT NULL").select(*cols, F.col("first").alias("__page"), "up", F.lit(None).cast("bigint").alias("down"))
    links = links.unionByName(over.where("down IS NOT NULL").select(*cols, F.col("last").alias("__page"), F.lit(None).cast("bigint").alias("up"), "down"))
    links = links.groupBy(*[f"__{k}" for k in keys], "__page").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    both = table.join(links, _same(keys, {"page": "__page"}), "left")
    return materialize(both.withColumns({"parent": F.coalesce("parent", "up"), "child": F.coalesce("child", "down")}).select(*table.columns))


def _openings(table: DataFrame, keys: list[str], patches: Patches) -> DataFrame:
    """``__`` keys, ``__page`` and ``opening`` of the pages whose parent leaves a record behind."""
    chain = table.where("child IS NOT NULL")
    largest = chain.agg(F.max("most")).first()[0] or 0
    own = F.aggregate("items", patches.identity(), lambda f, x: patches.then(f, x, largest), lambda f: patches.thin(f, largest))

    def settled(df: DataFrame) -> DataFrame:
        """With ``end``: what a page leaves behind, NULL while that hangs on the page ``prev``."""
        return df.withColumn("end", F.when(F.col("prev").isNull(), patches.apply(F.col("patch"), patches.absent())).otherwise(patches.constant(F.col("patch"), largest)))

    rest = materialize(settled(chain.select(*keys, "page", F.col("parent").alias("prev"), own.alias("patch"))))
    ends = rest.where("end IS NOT NULL").select(*keys, "page", "end")
    rest = rest.where("end IS NULL")
    cols = [F.col(k).alias(f"__{k}") for k in keys]
    both = F.aggregate(F.array(F.struct(F.col("up.patch").alias("a"), F.col("patch").alias("b"))), patches.identity(), lambda acc, x: patches.compose(x["a"], x["b"], largest), lambda f: patches.thin(f, largest))
    while not rest.isEmpty():
        asked = rest.select(*cols, F.col("prev").alias("__page")).distinct()
        every = ends.withColumns({"prev": F.lit(None).cast("bigint"), "patch": F.lit(None).cast(patches.type)}).unionByName(rest.select(*keys, "page", "end", "prev", "patch"))
        parents = every.join(asked, _same(keys, {"page": "__page"}), "left_semi").select(*cols, F.col("page").alias("__page"), F.struct("prev", "patch", "end").alias("up"))
        joined = rest.drop("end").join(parents, _same(keys, {"prev": "__page"}))
        known = joined.where("up.end IS NOT NULL").select(*keys, "page", "prev", "patch", patches.apply(F.col("patch"), F.col("up.end")).alias("end"))
        further = settled(joined.where("up.end IS NULL").select(*keys, "page", F.col("up.prev").alias("prev"), both.alias("patch")))
        found = materialize(known.unionByName(further))
        ends = ends.unionByName(found.where("end IS NOT NULL").select(*keys, "page", "end"))
        rest = found.where("end IS NULL")
    left = ends.where("end.size > 0").select(*cols, F.col("page").alias("__parent"), F.col("end").alias("opening"))
    return table.where("parent IS NOT NULL").join(left, _same(keys, {"parent": "__parent"})).select(*cols, F.col("page").alias("__page"), "opening")
