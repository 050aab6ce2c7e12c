"""A limit order book at the level of single orders, and how feed messages and snapshots change it.

Pure Python, without Spark: it is the state of an ordered scan. A level holds identified orders in the order of their arrival and
*anonymous* quantity, which is older than any of them: it comes from a seed or a snapshot, not from a message.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from ..schema import BUY, CROSS, DELETE, EXEC_HIDDEN, EXEC_VISIBLE, HALT, NEW_LIMIT, NO_ASK, NO_BID, PARTIAL_CANCEL, SELL


class Message(NamedTuple):
    ts: int
    type: int
    order_id: int
    size: int
    price: int
    side: int


class Level:
    __slots__ = ("price", "anon", "total", "queue")

    def __init__(self, price: int):
        self.price, self.anon, self.total = price, 0, 0
        self.queue: dict[int, int] = {}  # order id: quantity, oldest first

    @property
    def visible(self) -> int:
        return self.total + self.anon


class Side:
    """The levels of one side, best first by rank: the price for asks, its negative for bids."""

    def __init__(self, side: int):
        self.side = side
        self.ranks: list[int] = []
        self.levels: dict[int, Level] = {}

    def level(self, price: int) -> Level:
        found = self.levels.get(price)
        if found is None:
            found = self.levels[price] = Level(price)
            insort(self.ranks, -self.side * price)
        return found

    def tidy(self, level: Level) -> None:
        if not level.queue and level.anon <= 0:
            del self.levels[level.price]
            del self.ranks[bisect_left(self.ranks, -self.side * level.price)]

    def best(self) -> Level | None:
        return self.levels[-self.side * self.ranks[0]] if self.ranks else None

    def __iter__(self) -> Iterator[Level]:
        return (self.levels[-self.side * r] for r in self.ranks)


class OrderBook:
    """Both sides and an index of the orders. ``stats`` counts what happened; nothing raises on odd input."""

    def __init__(self) -> None:
        self.sides = {BUY: Side(BUY), SELL: Side(SELL)}
        self.where: dict[int, Level] = {}
        self.side_of: dict[int, int] = {}
        self.stats: Counter = Counter()

    # --- single orders
    def add(self, order_id: int, side: int, price: int, qty: int) -> bool:
        """Rest an order behind its level's queue. An id that rests already changes nothing."""
        if order_id in self.where:
            self.stats["duplicate_ids"] += 1
            return False
        level = self.sides[side].level(price)
        level.queue[order_id] = qty
        level.total += qty
        self.where[order_id], self.side_of[order_id] = level, side
        self.stats["adds"] += 1
        return True

    def _lower(self, order_id: int, qty: int, counter: str) -> bool:
        level = self.where.get(order_id)
        if level is None:
            return False
        rest = level.queue[order_id] - qty
        self.stats[counter] += 1
        if rest < 0:
            self.stats["over_qty"] += 1
        if rest <= 0:
            self._out(order_id)
        else:
            level.queue[order_id] = rest
            level.total -= qty
        return True

    def cancel(self, order_id: int, qty: int) -> bool:
        """Take quantity off; all of it removes the order. False for an unknown id."""
        return self._lower(order_id, qty, "cancels")

    def execute(self, order_id: int, qty: int) -> bool:
        return self._lower(order_id, qty, "executes")

    def remove(self, order_id: int) -> bool:
        if order_id not in self.where:
            return False
        self._out(order_id)
        self.stats["removes"] += 1
        return True

    def _out(self, order_id: int) -> None:
        level = self.where.pop(order_id)
        level.total -= level.queue.pop(order_id)
        self.sides[self.side_of.pop(order_id)].tidy(level)

    # --- anonymous quantity and whole levels
    def add_anon(self, side: int, price: int, qty: int) -> None:
        if qty > 0:
            self.sides[side].level(price).anon += qty

    def reduce_anon(self, side: int, price: int, qty: int) -> int:
        """Take off at most what is there; what was taken."""
        self.stats["anon_reduce"] += 1
        level = self.sides[side].levels.get(price)
        taken = min(qty, level.anon) if level else 0
        if taken < qty or not level:
            self.stats["anon_underflow"] += 1
        if level:
            level.anon -= taken
            self.sides[side].tidy(level)
        return taken

    def purge_level(self, side: int, price: int) -> int:
        """Drop a level with all it holds; the number of identified orders dropped."""
        level = self.sides[side].levels.get(price)
        if level is None:
            return 0
        gone = list(level.queue)
        for i in gone:
            del self.where[i], self.side_of[i]
        level.queue, level.total, level.anon = {}, 0, 0
        self.sides[side].tidy(level)
        self.stats["purged_orders"] += len(gone)
        return len(gone)

    def purge_better_than(self, side: int, limit: int) -> int:
        """Drop the levels strictly better than ``limit``; their number."""
        ranks = self.sides[side].ranks
        out = ranks[: bisect_left(ranks, -side * limit)]
        for r in out:
            self.purge_level(side, -side * r)
        return len(out)

    def set_level_visible(self, side: int, price: int, target: int) -> int:
        """Make a level show ``target``: by anonymous quantity, or if its orders are too many by trimming the youngest; orders trimmed."""
        if target <= 0:
            return self.purge_level(side, price)
        level = self.sides[side].level(price)
        level.anon = max(target - level.total, 0)
        trimmed = 0
        while level.total > target:
            youngest = next(reversed(level.queue))
            excess = level.total - target
            trimmed += 1
            if level.queue[youngest] <= excess:
                self._out(youngest)
            else:
                level.queue[youngest] -= excess
                level.total -= excess
        self.stats["purged_orders"] += trimmed
        return trimmed

    # --- views
    def best_price(self, side: int) -> int:
        top = self.sides[side].best()
        return top.price if top else (NO_BID if side == BUY else NO_ASK)

    def best_qty(self, side: int) -> int:
        top = self.sides[side].best()
        return top.visible if top else 0

    def touch(self) -> tuple[int, int, int, int]:
        """best bid, its quantity, best ask, its quantity."""
        bid, ask = self.sides[BUY].best(), self.sides[SELL].best()
        return (bid.price if bid else NO_BID, bid.visible if bid else 0, ask.price if ask else NO_ASK, ask.visible if ask else 0)

    def two_sided(self) -> bool:
        return bool(self.sides[BUY].ranks and self.sides[SELL].ranks)

    def depth(self, side: int, k: int) -> list[tuple[int, int, int]]:
        """The best k levels: price, visible quantity, identified orders."""
        s = self.sides[side]
        return [(x.price, x.visible, len(x.queue)) for x in (s.levels[-side * r] for r in s.ranks[:k])]

    def level_qty(self, side: int, price: int) -> int:
        level = self.sides[side].levels.get(price)
        return level.visible if level else 0

    def qty_ahead(self, order_id: int) -> int | None:
        """What stands before an order in its level; None for an unknown id."""
        level = self.where.get(order_id)
        if level is None:
            return None
        ahead = level.anon
        for i, q in level.queue.items():
            if i == order_id:
                break
            ahead += q
        return ahead

    def order(self, order_id: int) -> dict | None:
        level = self.where.get(order_id)
        if level is None:
            return None
        return {"order_id": order_id, "side": self.side_of[order_id], "price": level.price, "qty": level.queue[order_id], "queue_ahead": self.qty_ahead(order_id)}

    @property
    def num_orders(self) -> int:
        return len(self.where)

    def num_levels(self, side: int) -> int:
        return len(self.sides[side].ranks)

    def broken_rules(self) -> list[str]:
        """Invariants that don't hold, for tests."""
        bad, n = [], 0
        for s in self.sides.values():
            if s.ranks != sorted(set(s.ranks)) or {-s.side * r for r in s.ranks} != set(s.levels):
                bad.append("order of levels")
            for x in s.levels.values():
                n += len(x.queue)
                if sum(x.queue.values()) != x.total or any(q <= 0 for q in x.queue.values()):
                    bad.append(f"total at {x.price}")
                if not x.queue and x.anon <= 0:
                    bad.append(f"empty level {x.price}")
                if any(self.where.get(i) is not x for i in x.queue):
                    bad.append(f"index at {x.price}")
        if n != len(self.where) or set(self.where) != set(self.side_of):
            bad.append("number of orders")
        return bad


APPLY_COUNTERS = ("messages", "unknown_id", "hidden_execs", "crosses", "halts", "ignored", "priority_purges")
RESYNC_COUNTERS = ("rows", "levels_added", "levels_purged", "qty_adjusted", "orders_trimmed")
BOOK_COUNTERS = ("adds", "cancels", "executes", "removes", "duplicate_ids", "over_qty", "anon_reduce", "anon_underflow", "purged_orders")


def apply_message(book: OrderBook, m: Message, stats: Counter, purge: bool = True) -> bool:
    """Apply one feed message; whether it was one that addresses the visible book.

    purge: infer removals from price priority. A resting new order clears the opposite levels at or through its price, an
    execution the levels of its side that are strictly better. ``priority_purges`` counts messages that cleared something.
    """
    stats["messages"] += 1

    def clear(side: int, limit: int) -> None:
        if purge and book.purge_better_than(side, limit):
            stats["priority_purges"] += 1

    def anonymous() -> None:
        stats["unknown_id"] += 1
        book.reduce_anon(m.side, m.price, m.size)

    kind = m.type
    if kind == NEW_LIMIT:
        if m.size <= 0 or m.price <= 0:
            stats["ignored"] += 1
            return False
        clear(-m.side, m.price + m.side)
        book.add(m.order_id, m.side, m.price, m.size)
    elif kind == PARTIAL_CANCEL:
        if not book.cancel(m.order_id, m.size):
            anonymous()
    elif kind == DELETE:
        if not book.remove(m.order_id):
            anonymous()
    elif kind == EXEC_VISIBLE:
        clear(m.side, m.price)
        if not book.execute(m.order_id, m.size):
            anonymous()
    else:
        if kind == EXEC_HIDDEN:
            stats["hidden_execs"] += 1
            if m.price > 0:
                clear(m.side, m.price)
        else:
            stats["crosses" if kind == CROSS else "halts" if kind == HALT else "ignored"] += 1
        return False
    return True


def resync(book: OrderBook, side_levels: dict[int, Iterable[tuple[int, int]]], stats: Counter) -> None:
    """Put the book right by a snapshot: per side its real (price, size) levels, best first.

    Our levels at or better than the snapshot's worst price that it lacks are purged, those it has are set to its size,
    those we lack are added as anonymous quantity. Worse levels are out of its sight and stay; an empty side sees all.
    """
    stats["rows"] += 1
    for side, levels in side_levels.items():
        seen = dict(levels)
        edge = max((-side * p for p in seen), default=None)
        ours = [p for p in (-side * r for r in book.sides[side].ranks) if edge is None or -side * p <= edge]
        for price in ours:
            if price not in seen:
                stats["orders_trimmed"] += book.purge_level(side, price)
                stats["levels_purged"] += 1
            elif book.sides[side].levels[price].visible != seen[price]:
                stats["orders_trimmed"] += book.set_level_visible(side, price, seen[price])
                stats["qty_adjusted"] += 1
        for price in seen.keys() - set(ours):
            book.add_anon(side, price, seen[price])
            stats["levels_added"] += 1


def ofi_term(before: tuple[int, int, int, int], after: tuple[int, int, int, int]) -> int:
    """Order-flow imbalance from one touch to the next; 0 unless both are two-sided."""
    pb0, qb0, pa0, qa0 = before
    pb, qb, pa, qa = after
    if pb0 == NO_BID or pa0 == NO_ASK or pb == NO_BID or pa == NO_ASK:
        return 0
    bid = (qb if pb >= pb0 else 0) - (qb0 if pb <= pb0 else 0)
    ask = (qa if pa <= pa0 else 0) - (qa0 if pa >= pa0 else 0)
    return bid - ask
