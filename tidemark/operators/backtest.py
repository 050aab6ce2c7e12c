"""Event-driven backtests: simulated orders against replayed sessions.

One simulation is sequential: strategy, order, fill, strategy. It runs as the state of an ordered scan over a session. Simulated orders never touch
the book, so all specs of a sweep run side by side in one scan: a message is read once and applied to one book, whatever the number of specs.
History and our own delayed actions are merged in time; at equal times history comes first. Fills, samples and signals leave a run as they come.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signals import SESSION
from ..schema import BUY, DELETE, EXEC_HIDDEN, EXEC_VISIBLE, NEW_LIMIT, NO_ASK, NO_BID, NS_PER_SEC, PARTIAL_CANCEL, PRICE_SCALE, SELL
from .book import Message, OrderBook, apply_message, ofi_term, resync
from .replay import STATS, counters, first_books, ordered_scan, parse_snapshot, with_snapshots

PESSIMISTIC, PRO_RATA, OPTIMISTIC = "Pessimistic", "ProRata", "Optimistic"


@dataclass(frozen=True)
class RunSpec:
    """What one run is made of. The defaults of strategy and costs are those of a run by symbol."""

    label: str = ""
    latency_us: float = 500.0
    md_latency_ns: int = 0
    passive_entry: bool = True
    entry_z: float = 2.0
    exit_z: float = 0.5
    window_events: int = 50
    zscore_window: int = 1000
    order_qty: int = 100
    max_position: int = 100
    order_ttl_s: float = 2.0
    max_hold_s: float = 60.0
    cooldown_ms: float = 100.0
    cancel_assumption: str = PRO_RATA
    maker_fee: float = -0.0020
    taker_fee: float = 0.0030
    commission_bps: float = 0.0
    sample_ns: int = NS_PER_SEC
    start_ts: int = 34_200 * NS_PER_SEC
    end_ts: int = 57_600 * NS_PER_SEC
    flatten_before_close_ns: int = 60 * NS_PER_SEC
    start_index: int = 1
    price_priority_purge: bool = True
    flatten: bool = True  # close what is held at the end

    @property
    def latency_ns(self) -> int:
        return self.md_latency_ns + int(self.latency_us * 1000)


@dataclass
class SimOrder:
    id: int
    side: int
    price: int
    qty: int
    submit_ts: int
    market: bool = False
    ioc: bool = False
    filled: int = 0
    queue_ahead: int = 0
    state: str = "pending"  # pending, live, filled, cancelled

    @property
    def remaining(self) -> int:
        return self.qty - self.filled

    @property
    def open(self) -> bool:
        return self.state in ("pending", "live")


@dataclass(frozen=True)
class Fill:
    ts: int
    order_id: int
    side: int
    price: int
    qty: int
    passive: bool
    fee: float


class FillModel:
    """When simulated orders trade: by walking the visible book on arrival, then by what history trades."""

    def __init__(self, spec: RunSpec):
        if spec.cancel_assumption not in (PESSIMISTIC, PRO_RATA, OPTIMISTIC):
            raise ValueError(f"unknown cancel assumption: {spec.cancel_assumption}")
        self.spec = spec

    def fee(self, passive: bool, qty: int, price: int) -> float:
        s = self.spec
        return (s.maker_fee if passive else s.taker_fee) * qty + s.commission_bps * 1e-4 * qty * price / PRICE_SCALE

    def _fill(self, o: SimOrder, ts: int, price: int, qty: int, passive: bool) -> list[Fill]:
        qty = min(qty, o.remaining)
        if qty <= 0:
            return []
        o.filled += qty
        if not o.remaining:
            o.state = "filled"
        return [Fill(ts, o.id, o.side, price, qty, passive, self.fee(passive, qty, price))]

    def arrive(self, o: SimOrder, book: OrderBook, now: int) -> list[Fill]:
        """Take what is within the limit; a market or IOC rest expires, another rest queues behind its level."""
        o.state = "live"
        out: list[Fill] = []
        for level in book.sides[-o.side]:
            if not o.remaining or (level.price - o.price) * o.side > 0:
                break
            out += self._fill(o, now, level.price, level.visible, False)
        if o.remaining:
            if o.market or o.ioc:
                o.state = "cancelled"
            else:
                o.queue_ahead = book.level_qty(o.side, o.price)
        return out

    def history(self, o: SimOrder, m: Message, level_before: int) -> list[Fill]:
        """What a historical message does to a live order; level_before: visible quantity at the message's price before it."""
        if o.state != "live" or o.remaining <= 0:
            return []
        same, worse = m.side == o.side, (o.price - m.price) * o.side > 0
        if m.type in (EXEC_VISIBLE, EXEC_HIDDEN) and same:
            if worse:  # a print behind our price: we stood before it
                return self._fill(o, m.ts, o.price, m.size, True)
            if m.price != o.price:
                return []
            if m.type == EXEC_HIDDEN:
                return self._fill(o, m.ts, o.price, m.size, True) if not o.queue_ahead else []
            eaten = min(m.size, o.queue_ahead)
            o.queue_ahead -= eaten
            return self._fill(o, m.ts, o.price, m.size - eaten, True)
        if m.type in (PARTIAL_CANCEL, DELETE) and same and m.price == o.price and o.queue_ahead > 0:
            how = self.spec.cancel_assumption
            if how == OPTIMISTIC:
                o.queue_ahead -= min(m.size, o.queue_ahead)
            elif how == PRO_RATA and level_before > 0:
                o.queue_ahead -= min(math.floor(m.size * (o.queue_ahead / level_before) + 0.5), o.queue_ahead)
        elif m.type == NEW_LIMIT and not same and (m.price - o.price) * o.side <= 0:
            return self._fill(o, m.ts, o.price, m.size, True)  # it would have met us instead of resting
        return []


@dataclass
class Portfolio:
    """Position at average cost: ``realized`` before fees, cash after them."""

    position: int = 0
    cash: float = 0.0
    fees: float = 0.0
    realized: float = 0.0
    avg_cost: float = 0.0
    volume: int = 0
    n_fills: int = 0

    def apply(self, f: Fill) -> None:
        px, signed = f.price / PRICE_SCALE, f.side * f.qty
        if self.position * f.side >= 0:
            held = abs(self.position)
            self.avg_cost = (self.avg_cost * held + px * f.qty) / (held + f.qty)
        else:
            closed = min(f.qty, abs(self.position))
            self.realized += closed * (px - self.avg_cost) * -f.side
            if f.qty > closed:
                self.avg_cost = px
            elif closed == abs(self.position):
                self.avg_cost = 0.0
        self.position += signed
        self.cash -= signed * px + f.fee
        self.fees += f.fee
        self.volume += f.qty
        self.n_fills += 1

    def equity(self, mid: float) -> float:
        return self.cash + self.position * mid

    def unrealized(self, mid: float) -> float:
        return self.position * (mid - self.avg_cost)


class Strategy:
    """Override ``on_market``; the other callbacks do nothing unless overridden. ``ctx`` is the running ``Backtest``."""

    def on_start(self, ctx: Backtest) -> None: ...
    def on_market(self, ctx: Backtest, m: Message, ofi_e: int) -> None:
        raise NotImplementedError("a strategy needs on_market")

    def on_fill(self, ctx: Backtest, f: Fill) -> None: ...
    def on_timer(self, ctx: Backtest, now: int) -> None: ...
    def on_end(self, ctx: Backtest) -> None: ...


class FlowSignal:
    """Z-score of the order flow of the last events among its own last values. Strategies of one scan may share it: a message counts once."""

    def __init__(self, window: int, length: int):
        self.terms: deque[int] = deque(maxlen=max(1, window))
        self.flows: deque[float] = deque(maxlen=max(2, length))
        self.flow, self.total, self.squares = 0, 0.0, 0.0
        self.z, self.seen = 0.0, 0

    def take(self, ofi_e: int, number: int) -> float:
        """The score after message ``number``, which only its first caller adds."""
        if number == self.seen:
            return self.z
        self.seen = number
        self.flow += ofi_e - (self.terms[0] if len(self.terms) == self.terms.maxlen else 0)
        self.terms.append(ofi_e)
        w, old = float(self.flow), self.flows[0] if len(self.flows) == self.flows.maxlen else 0.0
        self.total += w - old
        self.squares += w * w - old * old
        self.flows.append(w)
        self.z = 0.0
        if len(self.flows) == self.flows.maxlen and len(self.terms) == self.terms.maxlen:
            n = len(self.flows)
            mean = self.total / n
            var = self.squares / n - mean * mean
            if var >= 1e-12:
                self.z = (w - mean) / math.sqrt(var)
        return self.z


class OfiStrategy(Strategy):
    """Trade with the flow when its z-score is extreme; leave when it fades or after a longest hold. One working order at a time."""

    def __init__(self, spec: RunSpec, signal: FlowSignal | None = None):
        self.spec = spec
        self.signal = signal or FlowSignal(spec.window_events, spec.zscore_window)
        self.z = 0.0
        self.order = self.entered = self.acted = 0
        self.leaving = False

    def on_start(self, ctx: Backtest) -> None:
        self.acted = ctx.now

    def on_market(self, ctx: Backtest, m: Message, ofi_e: int) -> None:
        self.z = self.signal.take(ofi_e, ctx.seen)
        if ctx.closing:
            return
        s, now = self.spec, ctx.now
        working = ctx.order(self.order)
        if working is None or not working.open:
            self.order = 0
        elif not self.leaving and now - working.submit_ts > s.order_ttl_s * NS_PER_SEC:
            ctx.cancel(self.order)
            self.order = 0
        position = ctx.position
        if position:
            if not (self.leaving and self.order):
                toward = self.z if position > 0 else -self.z
                if toward < s.exit_z or now - self.entered > s.max_hold_s * NS_PER_SEC:
                    if self.order:
                        ctx.cancel(self.order)
                    self.order = ctx.submit_market(-1 if position > 0 else 1, abs(position))
                    self.leaving, self.acted = True, now
        elif not self.order and now - self.acted >= s.cooldown_ms * 1e6 and abs(self.z) > s.entry_z and ctx.book.two_sided():
            side = BUY if self.z > 0 else SELL
            touch = ctx.book.best_price(side if s.passive_entry else -side)
            self.order = ctx.submit_limit(side, touch, s.order_qty, ioc=not s.passive_entry)
            self.leaving, self.acted = False, now

    def on_fill(self, ctx: Backtest, f: Fill) -> None:
        if not ctx.position:
            self.entered, self.leaving = 0, False
        elif not self.entered:
            self.entered = f.ts


class Curve:
    """An equity curve in figures, without its points: last value, greatest fall from a peak that starts at 0, mean and spread of the changes."""

    def __init__(self) -> None:
        self.last, self.peak, self.fall = None, 0.0, 0.0
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def _merge(self, n: int, mean: float) -> None:
        """n changes that are all ``mean``."""
        gap, total = mean - self.mean, self.n + n
        self.m2 += gap * gap * self.n * n / total
        self.mean += gap * n / total
        self.n = total

    def add(self, value: float, times: int) -> None:
        if self.last is not None:
            self._merge(1, value - self.last)
        if times > 1:
            self._merge(times - 1, 0.0)
        self.last = value
        self.peak = max(self.peak, value)
        self.fall = max(self.fall, self.peak - value)

    def sharpe(self, samples_per_day: float) -> float:
        """Mean over sample deviation of the changes, for 252 days of ``samples_per_day``; 0 below 3 samples or without variance."""
        if self.n < 2 or self.m2 <= 0:
            return 0.0
        return self.mean / math.sqrt(self.m2 / (self.n - 1)) * math.sqrt(samples_per_day * 252.0)


@dataclass
class Backtest:
    """One run. Feed messages by ``message`` in order, then call ``finish``; single use. book: one that is shared with other runs, which a scan moves on."""

    spec: RunSpec
    strategy: Strategy
    seed: Sequence[tuple[int, int, int]] = ()
    book: OrderBook = field(default_factory=OrderBook)
    fills: list[Fill] = field(default_factory=list)
    stretches: list[tuple[range, float, int, float]] = field(default_factory=list)
    counts: Counter = field(default_factory=Counter)
    applied: Counter = field(default_factory=Counter)
    synced: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        self.pf, self.model, self.curve = Portfolio(), FillModel(self.spec), Curve()
        self.plant(self.seed)
        self.now = self.next_sample = self.spec.start_ts
        self.orders: dict[int, SimOrder] = {}
        self.live: list[int] = []
        self.actions: list[tuple[int, int, str, int]] = []
        self.tick, self.seen, self.last_mid = 0, 0, 0.0
        self.closing = self.ended = self.forced_close = self._flattening = False
        self.strategy.on_start(self)

    def plant(self, seed: Sequence[tuple[int, int, int]]) -> None:
        for side, price, qty in seed:
            self.book.add_anon(side, price, qty)

    @property
    def samples(self) -> list[tuple[int, float, int, float]]:
        """time, equity, position and mid of the samples that weren't taken yet."""
        return [(t, *rest) for times, *rest in self.stretches for t in times]

    def take_fills(self) -> list[Fill]:
        new, self.fills = self.fills, []
        return new

    def take_samples(self) -> list[tuple[int, float, int, float]]:
        new = self.samples
        self.stretches = []
        return new

    # --- what a strategy may use
    @property
    def position(self) -> int:
        return self.pf.position

    @property
    def cash(self) -> float:
        return self.pf.cash

    def order(self, order_id: int) -> SimOrder | None:
        return self.orders.get(order_id)

    def open_orders(self) -> list[SimOrder]:
        return [o for i in self.live if (o := self.orders[i]).open]

    def open_qty(self, side: int) -> int:
        return sum(o.remaining for o in self.open_orders() if o.side == side)

    def submit_limit(self, side: int, price: int, qty: int, ioc: bool = False) -> int:
        return self._submit(side, price, qty, ioc, False)

    def submit_market(self, side: int, qty: int) -> int:
        return self._submit(side, NO_ASK if side == BUY else NO_BID, qty, True, True)

    def cancel(self, order_id: int) -> None:
        o = self.orders.get(order_id)
        if o is not None and o.open:
            self._later(self.now + self.spec.latency_ns, "cancel", order_id)

    def schedule_timer(self, at: int) -> None:
        self._later(max(at, self.now), "timer", 0)

    # --- inside
    def _later(self, at: int, what: str, order_id: int) -> None:
        self.tick += 1
        heapq.heappush(self.actions, (at, self.tick, what, order_id))

    def _submit(self, side: int, price: int, qty: int, ioc: bool, market: bool) -> int:
        """The new order's id, 0 if it is rejected: no quantity, closing, or |position + open same-side quantity| beyond the cap."""
        self.counts["orders_submitted"] += 1
        shut = self.closing and not self._flattening
        if qty <= 0 or shut or abs(self.pf.position + side * (qty + self.open_qty(side))) > self.spec.max_position:
            self.counts["orders_rejected"] += 1
            return 0
        o = SimOrder(len(self.orders) + 1, side, price, qty, self.now, market, ioc)
        self.orders[o.id] = o
        self.live.append(o.id)
        self._later(self.now + self.spec.latency_ns, "submit", o.id)
        return o.id

    def _mid(self) -> float:
        bid, _, ask, _ = self.book.touch()
        if bid != NO_BID and ask != NO_ASK:
            return (bid + ask) / (2.0 * PRICE_SCALE)
        if bid != NO_BID:
            return bid / PRICE_SCALE
        return ask / PRICE_SCALE if ask != NO_ASK else self.last_mid

    def _sample(self, until: int) -> None:
        """Equity at every sample time before ``until``: a sample at T has all that happened up to T."""
        until = min(until, self.spec.end_ts + 1)
        if self.next_sample >= until:
            return
        self.last_mid = mid = self._mid()  # nothing happens between the samples of one call
        equity, position = self.pf.equity(mid), self.pf.position
        times = range(self.next_sample, until, self.spec.sample_ns)
        self.curve.add(equity, len(times))
        self.stretches.append((times, equity, position, mid))
        self.next_sample = times[-1] + self.spec.sample_ns

    def _book_fills(self, new: list[Fill]) -> None:
        for f in new:
            self._keep(f)
            self.strategy.on_fill(self, f)

    def _keep(self, f: Fill) -> None:
        self.pf.apply(f)
        self.counts["passive"] += f.passive
        self.counts["aggressive"] += not f.passive
        self.fills.append(f)

    def _prune(self) -> None:
        self.live = [i for i in self.live if self.orders[i].open]

    def _act(self, at: int, what: str, order_id: int) -> None:
        self.now = max(self.now, at)
        if what == "timer":
            if not self.ended:
                self.strategy.on_timer(self, self.now)
        else:
            o = self.orders[order_id]
            if what == "cancel" and o.open:
                o.state = "cancelled"
                self.counts["orders_cancelled"] += 1
            elif what == "submit" and o.state == "pending":
                new = self.model.arrive(o, self.book, self.now)
                self.counts["orders_with_fill"] += bool(new)
                self.counts["orders_cancelled"] += o.state == "cancelled"
                self._book_fills(new)
        self._prune()

    def _drain(self, before: int | None) -> None:
        while self.actions and (before is None or self.actions[0][0] < before):
            at, _, what, order_id = heapq.heappop(self.actions)
            self._sample(at)
            self._act(at, what, order_id)

    def _begin_close(self) -> None:
        self.closing = True
        for i in list(self.live):
            self.cancel(i)
        if self.pf.position and self.spec.flatten:
            self._flattening = True
            self.submit_market(SELL if self.pf.position > 0 else BUY, abs(self.pf.position))
            self._flattening = False

    def message(self, m: Message, snap: dict | None = None) -> None:
        if self.skips():
            return
        level_before = self.before(m)
        self.after(m, move(self.book, m, snap, self.applied, self.synced, self.spec.price_priority_purge), level_before)

    def skips(self) -> bool:
        """Count a message; whether it is left out because the seed covers it."""
        self.seen += 1
        return self.seen <= self.spec.start_index

    def before(self, m: Message) -> int:
        """All that happens before a message, and what its level shows then."""
        self._drain(m.ts)
        self._sample(m.ts)
        self.now = max(self.now, m.ts)
        return self.book.level_qty(m.side, m.price) if m.type in (PARTIAL_CANCEL, DELETE) else 0

    def after(self, m: Message, ofi: int, level_before: int) -> None:
        """What a message that moved the book does to our orders and to the strategy."""
        new: list[Fill] = []
        for i in self.live:
            o = self.orders[i]
            had = o.filled
            new += self.model.history(o, m, level_before)
            self.counts["orders_with_fill"] += had == 0 < o.filled
        if new:
            self._book_fills(new)
            self._prune()
        if not self.closing and m.ts >= self.spec.end_ts - self.spec.flatten_before_close_ns:
            self._begin_close()
        self.strategy.on_market(self, m, ofi)

    def finish(self) -> None:
        """Out of messages: flatten if that hasn't begun, carry out what is under way, close at the last mid what is still held."""
        if not self.closing:
            self._begin_close()
        self._drain(None)
        self.ended = True
        self.strategy.on_end(self)
        if self.pf.position and self.spec.flatten:
            side, qty = (SELL if self.pf.position > 0 else BUY), abs(self.pf.position)
            price = math.floor(self._mid() * PRICE_SCALE + 0.5)
            f = Fill(self.now, 0, side, price, qty, False, self.model.fee(False, qty, price))
            self._keep(f)
            self.forced_close = True
        self._sample(self.spec.end_ts + 1)

    def metrics(self) -> dict:
        """The run in figures."""
        n = self.counts["orders_submitted"] - self.counts["orders_rejected"]
        pnl = self.pf.cash if self.curve.last is None else self.curve.last
        day = (self.spec.end_ts - self.spec.start_ts) / self.spec.sample_ns
        return {
            "total_pnl": pnl, "gross_pnl": pnl + self.pf.fees, "realized_pnl": self.pf.realized, "fees": self.pf.fees, "max_drawdown": self.curve.fall, "sharpe": self.curve.sharpe(day),
            "volume": self.pf.volume, "n_fills": self.pf.n_fills, "n_orders": n, "n_passive_fills": self.counts["passive"], "n_aggressive_fills": self.counts["aggressive"],
            "fill_rate": self.counts["orders_with_fill"] / n if n else 0.0, "pnl_per_share": pnl / self.pf.volume if self.pf.volume else 0.0,
            "orders_submitted": self.counts["orders_submitted"], "orders_rejected": self.counts["orders_rejected"], "orders_cancelled": self.counts["orders_cancelled"], "forced_close": self.forced_close,
        }


def move(book: OrderBook, m: Message, snap: dict | None, applied: Counter, synced: Counter, purge: bool) -> int:
    """Move the book on by a message and the snapshot after it; the order-flow imbalance of that."""
    touch = book.touch()
    apply_message(book, m, applied, purge)
    if snap is not None:
        resync(book, snap, synced)
    return ofi_term(touch, book.touch())


METRICS = T.StructType(
    [
        *[T.StructField(c, T.DoubleType()) for c in ("total_pnl", "gross_pnl", "realized_pnl", "fees", "max_drawdown", "sharpe")],
        *[T.StructField(c, T.LongType()) for c in ("volume", "n_fills", "n_orders", "n_passive_fills", "n_aggressive_fills")],
        *[T.StructField(c, T.DoubleType()) for c in ("fill_rate", "pnl_per_share")],
        *[T.StructField(c, T.LongType()) for c in ("orders_submitted", "orders_rejected", "orders_cancelled")],
        T.StructField("forced_close", T.BooleanType()),
    ]
)
FILLS = T.StructType(
    [T.StructField("ts", T.LongType()), T.StructField("order_id", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("price", T.LongType()), T.StructField("qty", T.LongType()),
     T.StructField("passive", T.BooleanType()), T.StructField("fee", T.DoubleType())]
)
EQUITY = T.StructType([T.StructField("ts", T.LongType()), T.StructField("equity", T.DoubleType()), T.StructField("position", T.LongType()), T.StructField("mid", T.DoubleType())])
SIGNALS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("z", T.DoubleType())])
OUTPUTS = {"metrics": METRICS, "fills": FILLS, "equity": EQUITY, "signals": SIGNALS, "counters": STATS}


class _Market:
    """A book that the runs of equal ``price_priority_purge`` and ``start_index`` share."""

    def __init__(self, seed: Sequence[tuple[int, int, int]]):
        self.book, self.applied, self.synced = OrderBook(), Counter(), Counter()
        self.runs: list[tuple[int, Backtest]] = []
        self.signals: dict[tuple[int, int], FlowSignal] = {}
        for planted in seed:
            self.book.add_anon(*planted)


class _Runs:
    """The backtests of all specs over a session, as the state of an ordered scan."""

    def __init__(self, specs: list[RunSpec], make: Callable[[RunSpec], Strategy], output: str):
        self.specs, self.make, self.output = specs, make, output
        self.markets: dict[tuple[bool, int], _Market] | None = None
        self.now = 0

    def _start(self, seed: list[tuple[int, int, int]], covered: bool) -> None:
        self.markets = {}
        for i, spec in enumerate(self.specs):
            spec = spec if covered else replace(spec, start_index=0)
            place = self.markets.setdefault((spec.price_priority_purge, spec.start_index), _Market(seed))
            strategy = self.make(spec)
            if type(strategy) is OfiStrategy:
                strategy.signal = place.signals.setdefault((spec.window_events, spec.zscore_window), strategy.signal)
            place.runs.append((i, Backtest(spec, strategy, (), place.book, applied=place.applied, synced=place.synced)))

    def row(self, v: tuple) -> list[tuple]:
        _, _, seq, ts, kind, order_id, size, price, direction, snap, first_book, covered = v
        if self.markets is None:
            self._start([] if first_book is None else [(side, *level) for side, levels in parse_snapshot(first_book).items() for level in levels], bool(covered))
        ts = self.now = max(self.now, ts) if ts is not None else self.now
        m = Message(ts, kind, order_id, size, price, BUY if direction >= 0 else SELL)
        levels = None if snap is None else parse_snapshot(snap)
        out: list[tuple] = []
        for (purge, _), place in self.markets.items():
            if [bt.skips() for _, bt in place.runs][0]:
                continue
            shown = [bt.before(m) for _, bt in place.runs]
            ofi = move(place.book, m, levels, place.applied, place.synced, purge)
            for (i, bt), level_before in zip(place.runs, shown):
                bt.after(m, ofi, level_before)
                if self.output == "signals":
                    out.append((i, seq, ts, getattr(bt.strategy, "z", None)))
                elif bt.fills or bt.stretches:
                    out += self._new(i, bt)
        return out

    def _new(self, i: int, bt: Backtest) -> list[tuple]:
        """What has come out of a run since it was last asked; what isn't wanted is dropped."""
        fills, samples = bt.take_fills(), bt.take_samples() if self.output == "equity" else bt.stretches.clear()
        if self.output == "fills":
            return [(i, f.ts, f.order_id, f.side, f.price, f.qty, f.passive, f.fee) for f in fills]
        return [(i, *x) for x in samples] if samples else []

    def end(self) -> list[tuple]:
        out: list[tuple] = []
        for place in (self.markets or {}).values():
            for i, bt in place.runs:
                bt.finish()
                out += self._new(i, bt)
                if self.output == "metrics":
                    m = bt.metrics()
                    out.append((i, *[m[f.name] for f in METRICS.fields]))
                elif self.output == "counters":
                    out.append((i, *counters(place.book, place.applied, place.synced)))
        return out


def spec_frame(spark: SparkSession, specs: Sequence[RunSpec]) -> DataFrame:
    """The specs as a table, with ``spec_id``."""
    names = [f.name for f in fields(RunSpec)]
    return spark.createDataFrame([(i, *[getattr(s, n) for n in names]) for i, s in enumerate(specs)], ["spec_id", *names])


def backtest(
    messages: DataFrame, specs: Sequence[RunSpec], depth: DataFrame | None = None, levels: int = 3, snapshot: bool = True, output: str = "metrics", make: Callable[[RunSpec], Strategy] = OfiStrategy
) -> DataFrame:
    """Run every spec over every session of a ``feed``: symbol, trade_date, spec_id, label and ``output``.

    output: metrics and counters (a row each), fills, equity, or signals (a row per message). The specs of a session run in one scan: the
    messages are moved once, however many specs there are. depth: gives the seed
    (``first_books``) and, with ``snapshot``, the levels that the book is put right by at equal seq. ``start_index`` leaves out the messages that the seed
    covers: in a session whose first message no depth row covers, none is left out. Clocks never run back: a message earlier than the one before, or without a
    time, happens at that one's time. label: the spec's, or its number.
    """
    if output not in OUTPUTS:
        raise ValueError(f"output is none of {', '.join(OUTPUTS)}: {output}")
    specs = list(specs)
    rows = with_snapshots(messages, depth, levels, False, snapshot).drop("seed")
    if depth is None:
        rows = rows.withColumns({"first_book": F.lit(None).cast("string"), "covered": F.lit(False)})
    else:
        rows = rows.join(first_books(messages, depth, levels), [*SESSION, "seq"], "left").select(*rows.columns, "first_book", "covered")
    kind = T.StructType([T.StructField("spec_id", T.IntegerType()), *OUTPUTS[output].fields])
    out = ordered_scan(rows, SESSION, "seq", lambda: _Runs(specs, make, output), kind)
    labels = F.array(*[F.lit(s.label or str(i)) for i, s in enumerate(specs)])
    return out.select(*SESSION, "spec_id", F.element_at(labels, F.col("spec_id") + 1).alias("label"), *[f.name for f in OUTPUTS[output].fields])


def latency_sweep(messages: DataFrame, latencies_us: Sequence[float] = (0, 50, 500, 5000, 50000), base: RunSpec | None = None, **kw) -> DataFrame:
    return _sweep(messages, "latency_us", latencies_us, base, **kw)


def cancel_assumption_sweep(messages: DataFrame, base: RunSpec | None = None, **kw) -> DataFrame:
    return _sweep(messages, "cancel_assumption", (PESSIMISTIC, PRO_RATA, OPTIMISTIC), base, **kw)


def entry_threshold_sweep(messages: DataFrame, thresholds: Sequence[float] = (2, 2.5, 3, 4), base: RunSpec | None = None, **kw) -> DataFrame:
    return _sweep(messages, "entry_z", thresholds, base, **kw)


def _sweep(messages: DataFrame, name: str, values: Sequence, base: RunSpec | None, **kw) -> DataFrame:
    specs = [replace(base or RunSpec(), **{name: v, "label": f"{name}={v}"}) for v in values]
    lit = F.element_at(F.array(*[F.lit(v if isinstance(v, str) else float(v)) for v in values]), F.col("spec_id") + 1)
    return backtest(messages, specs, **kw).withColumn(name, lit)


class _Ledger:
    """A portfolio as the state of an ordered scan over fills."""

    def __init__(self) -> None:
        self.pf = Portfolio()

    def row(self, v: tuple) -> list[tuple]:
        _, fill_id, ts, side, price, qty, passive, fee = v
        self.pf.apply(Fill(ts, 0, side, price, qty, bool(passive), fee))
        p = self.pf
        return [(fill_id, ts, p.position, p.cash, p.fees, p.realized, p.avg_cost, p.volume)]

    def end(self) -> list[tuple]:
        return []


LEDGER = T.StructType(
    [T.StructField("fill_id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("position", T.LongType()),
     *[T.StructField(c, T.DoubleType()) for c in ("cash", "fees", "realized", "avg_cost")], T.StructField("volume", T.LongType())]
)


def ledger(fills: DataFrame, run: str = "run_id") -> DataFrame:
    """The portfolio after each fill of a run, in order of time and id: position, cash, fees, realized, avg_cost, volume.

    Exact repeats count once, fills without a time are left out, a NULL fee is 0.
    """
    slim = fills.where("ts IS NOT NULL").select(run, "fill_id", "ts", "side", "price", "qty", "passive", F.coalesce("fee", F.lit(0.0)).alias("fee")).distinct()
    return ordered_scan(slim, [run], ["ts", "fill_id"], _Ledger, LEDGER)


class _Shadows:
    """A resting order behind every order that history adds, each followed for some messages under each assumption; the state of an ordered scan."""

    def __init__(self, life: int, assumptions: Sequence[str]):
        self.life, self.book, self.stats = life, OrderBook(), Counter()
        self.models = [FillModel(RunSpec(cancel_assumption=a)) for a in assumptions]
        self.live: deque[tuple[int, int, list[SimOrder], list[int]]] = deque()  # place, seq, an order and its number of fills per assumption
        self.n = 0

    def _row(self, seq: int, orders: list[SimOrder], fills: list[int]) -> list[tuple]:
        return [(seq, m.spec.cancel_assumption, o.filled, n, o.queue_ahead) for m, o, n in zip(self.models, orders, fills)]

    def row(self, v: tuple) -> list[tuple]:
        _, _, seq, ts, kind, order_id, size, price, direction = v
        m = Message(ts or 0, kind, order_id, size, price, BUY if direction >= 0 else SELL)
        shown = self.book.level_qty(m.side, m.price)
        adds = self.book.stats["adds"]
        apply_message(self.book, m, self.stats, False)
        for _, _, orders, fills in self.live:
            for k, (model, o) in enumerate(zip(self.models, orders)):
                fills[k] += len(model.history(o, m, shown))
        self.n += 1
        out: list[tuple] = []
        while self.live and self.n - self.live[0][0] >= self.life:
            out += self._row(*self.live.popleft()[1:])
        if self.book.stats["adds"] > adds:
            ahead = self.book.level_qty(m.side, m.price)
            self.live.append((self.n, seq, [SimOrder(0, m.side, m.price, m.size, m.ts, state="live", queue_ahead=ahead) for _ in self.models], [0] * len(self.models)))
        return out

    def end(self) -> list[tuple]:
        return [r for x in self.live for r in self._row(*x[1:])]


SHADOWS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("assumption", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("filled", "n_fills", "queue_left")]])


def shadow_orders(messages: DataFrame, life: int = 32, assumptions: Sequence[str] = (PESSIMISTIC, PRO_RATA, OPTIMISTIC)) -> DataFrame:
    """For every order that a ``feed`` adds, what a simulated order of its side, price and size right behind it would get within the next ``life`` messages.

    symbol, trade_date, seq (of the message that adds), assumption (on cancels ahead of it), filled, n_fills and queue_left. The book is the message-only one.
    """
    rows = messages.select(*SESSION, "seq", "ts_ns", F.col("type").cast("int").alias("type"), "order_id", "size", "price", "direction")
    return ordered_scan(rows, SESSION, "seq", lambda: _Shadows(life, assumptions), SHADOWS)
