"""What a stretch of operations does to a record, as a value that can be composed.

A record is a struct whose first field ``size`` is above 0 while it exists; further fields are set when it is opened. On such states
every composition of

    open a    absent -> (a, fields), present -> unchanged
    reduce c  size -> max(size - c, 0)
    close     -> absent

has the form *steps, then a shift*: states of a size up to ``t`` map to constants by intervals (``steps``: upper end and value,
ascending), a state above ``t`` keeps its fields and loses t of its size. The form is closed under composition, and composition is associative.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lifecycle import CLOSE, OPEN

INF = 2**61  # above any size, and twice it is still a BIGINT: with such a t no state is shifted


def _big(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _step(upto: Column, val: Column) -> Column:
    return F.struct(upto.alias("upto"), val.alias("val"))


class Patches:
    """Patches of records with the given further fields (name to type). Operations are structs with op, qty and those fields."""

    def __init__(self, fields: dict[str, str] | None = None):
        self.fields = fields or {}
        self.state = f"struct<{', '.join(['size:bigint', *[f'{k}:{t}' for k, t in self.fields.items()]])}>"
        self.type = f"struct<t:bigint,steps:array<struct<upto:bigint,val:{self.state}>>>"

    def absent(self) -> Column:
        return F.struct(_big(0).alias("size"), *[F.lit(0).cast(t).alias(k) for k, t in self.fields.items()]).cast(self.state)

    def _sized(self, s: Column, size: Column) -> Column:
        return F.struct(size.alias("size"), *[s[k].alias(k) for k in self.fields]).cast(self.state)

    def _lowered(self, s: Column, by: Column) -> Column:
        return F.when(s["size"] > by, self._sized(s, s["size"] - by)).otherwise(self.absent())

    def _patch(self, t: Column, steps: Column) -> Column:
        return F.struct(t.alias("t"), steps.alias("steps")).cast(self.type)

    def identity(self) -> Column:
        return self._patch(_big(0), F.array(_step(_big(0), self.absent())))

    def then(self, f: Column, x: Column, largest: int | None = None) -> Column:
        """The patch f followed by one operation x. No state is above ``largest``: beyond it no steps are kept."""
        a, t, steps = x["qty"], f["t"], f["steps"]
        new = F.struct(a.alias("size"), *[x[k].alias(k) for k in self.fields]).cast(self.state)
        opened = F.transform(steps, lambda s: _step(s["upto"], F.when((s["val"]["size"] == 0) & (a > 0), new).otherwise(s["val"])))
        lowered = F.transform(steps, lambda s: _step(s["upto"], self._lowered(s["val"], a)))
        end = t + a
        tail = F.element_at(steps, -1)["val"]["size"] <= a  # the last step has become absent too: the new step only extends it
        kept = F.when(tail, F.slice(lowered, F.lit(1), F.size(steps) - 1)).otherwise(lowered)
        reduced = F.when(t >= _big(INF if largest is None else largest), self._patch(t, lowered)).otherwise(self._patch(end, F.concat(kept, F.array(_step(end, self.absent())))))
        closed = self._patch(_big(INF), F.array(_step(_big(INF), self.absent())))
        return F.when(x["op"] == OPEN, self._patch(t, opened)).when(x["op"] == CLOSE, closed).otherwise(reduced).cast(self.type)

    def apply(self, g: Column, s: Column) -> Column:
        """The state after patch g, from the state s."""
        return F.when(s["size"] > g["t"], self._sized(s, s["size"] - g["t"])).otherwise(F.filter(g["steps"], lambda x: x["upto"] >= s["size"])[0]["val"])

    def compose(self, f: Column, g: Column, largest: int) -> Column:
        """The patch f followed by the patch g, on states up to ``largest``."""
        head = F.transform(f["steps"], lambda s: _step(s["upto"], self.apply(g, s["val"])))
        shifted = F.transform(F.filter(g["steps"], lambda s: s["upto"] > 0), lambda s: _step(F.least(s["upto"] + f["t"], _big(INF)), s["val"]))
        steps = F.when(f["t"] >= _big(largest), head).otherwise(F.concat(head, shifted))
        return self._patch(F.least(f["t"] + g["t"], _big(INF)), steps)

    def thin(self, patch: Column, largest: int) -> Column:
        """Merge neighbouring steps of one value and drop those that begin above ``largest``. patch: a lambda's variable or a column, else it is evaluated for every step."""
        steps = patch["steps"]
        needed = lambda s, i: ((i == F.size(steps) - 1) | (F.get(steps, i + 1)["val"] != s["val"])) & ((i == 0) | (F.get(steps, i - 1)["upto"] < _big(largest)))
        return self._patch(patch["t"], F.filter(steps, needed))

    def constant(self, patch: Column, largest: int) -> Column:
        """The state that a thin patch leaves from every state, NULL if that depends on the state."""
        return F.when((patch["t"] >= _big(largest)) & (F.size(patch["steps"]) == 1), patch["steps"][0]["val"])
