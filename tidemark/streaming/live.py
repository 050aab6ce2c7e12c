"""Live forms: books kept as streaming state, and bucketed order flow with a watermark."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.signals import SESSION
from ..plans.scratch import ship
from ..operators.backtest import Backtest, OfiStrategy, RunSpec, Strategy
from ..operators.book import Message, OrderBook, apply_message, ofi_term
from ..schema import BUY, EXEC_HIDDEN, EXEC_VISIBLE, SELL

OUT = "symbol string, trade_date string, seq bigint, ts_ns bigint, type int, best_bid bigint, bid_qty bigint, best_ask bigint, ask_qty bigint, ofi_e bigint, trade_qty bigint, trade_side bigint"


def _ordered(frames: Iterator[pd.DataFrame], last: int, clock: int) -> Iterator[tuple[int, Message]]:
    """The messages of one session in one micro-batch, whose size the source's rate limit bounds, in the order of seq and above ``last``; NULLs count as 0, a NULL time as the one before."""
    whole = lambda x: 0 if x is None or x != x else int(x)
    rows = (r for f in frames for r in f[["seq", "ts_ns", "type", "order_id", "size", "price", "direction"]].itertuples(index=False, name=None))
    for seq, ts, kind, order_id, size, price, direction in sorted(rows, key=lambda r: r[0]):
        if seq <= last:
            continue
        last, clock = int(seq), clock if ts is None or ts != ts else int(ts)
        yield last, Message(clock, whole(kind), whole(order_id), whole(size), whole(price), BUY if whole(direction) >= 0 else SELL)


def live_features(messages: DataFrame, purge: bool = False) -> DataFrame:
    """A stream of features from a stream of messages (symbol, trade_date, seq, ts_ns, type, order_id, size, price, direction).

    The state of a session is its book and the last seq applied. Each micro-batch's messages of a session are applied in the order
    of seq; a seq at or below the last one is late or repeated and is dropped. On input in order the rows equal the batch replay's.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book, last, clock = pickle.loads(state.get[0]) if state.exists else (OrderBook(), -1, 0)
        out, stats = [], Counter()
        for seq, m in _ordered(frames, last, clock):
            last, clock = seq, m.ts
            before = book.touch()
            apply_message(book, m, stats, purge)
            traded = m.type in (EXEC_VISIBLE, EXEC_HIDDEN)
            out.append((*key, seq, m.ts, m.type, *book.touch(), ofi_term(before, book.touch()), m.size if traded else 0, m.side if traded else 0))
        state.update((pickle.dumps((book, last, clock)),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    ship(messages.sparkSession)
    return messages.groupBy(*SESSION).applyInPandasWithState(step, OUT, "book binary", "append", GroupStateTimeout.NoTimeout)


FILLS = "symbol string, trade_date string, ts bigint, order_id bigint, side int, price bigint, qty bigint, passive boolean, fee double"


def live_fills(messages: DataFrame, spec: RunSpec, make: Callable[[RunSpec], Strategy] = OfiStrategy, idle_ms: int | None = None) -> DataFrame:
    """Fills of a strategy run live on a stream of messages (paper trading): the state of a session is its whole ``Backtest``.

    Order and late messages as in ``live_features``. Positions are flattened by the spec's end time, as history's messages pass it; a
    session whose messages stop earlier stays open, or with ``idle_ms`` is finished and forgotten when none has come for so long: timers that are still due go off, what is
    held is closed. What a run has given out isn't kept in its state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, last, clock = pickle.loads(state.get[0]) if state.exists else (Backtest(spec, make(spec)), -1, 0)
        if state.hasTimedOut:
            run.finish()
            state.remove()
            yield pd.DataFrame([(*key, f.ts, f.order_id, f.side, f.price, f.qty, f.passive, f.fee) for f in run.take_fills()], columns=[c.split()[0] for c in FILLS.split(", ")])
            return
        for seq, m in _ordered(frames, last, clock):
            run.message(m)
            last, clock = seq, m.ts
        out = [(*key, f.ts, f.order_id, f.side, f.price, f.qty, f.passive, f.fee) for f in run.take_fills()]
        run.stretches.clear()
        state.update((pickle.dumps((run, last, clock)),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FILLS.split(", ")])

    ship(messages.sparkSession)
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return messages.groupBy(*SESSION).applyInPandasWithState(step, FILLS, "run binary", "append", timeout)


def live_buckets(features: DataFrame, bucket: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Order flow per session and event-time window of a feature stream: ofi, n_events, trade_qty. Rows later than ``delay`` are dropped.

    Event time is trade_date plus ts_ns, in microseconds.
    """
    at = F.timestamp_micros(F.unix_micros(F.to_timestamp("trade_date")) + F.expr("ts_ns div 1000"))
    return (
        features.withColumn("event_time", at).withWatermark("event_time", delay)
        .groupBy(*SESSION, F.window("event_time", bucket))
        .agg(F.sum("ofi_e").alias("ofi"), F.count(F.lit(1)).alias("n_events"), F.sum("trade_qty").alias("trade_qty"))
        .select(*SESSION, F.col("window.start").alias("bucket_start"), "ofi", "n_events", "trade_qty")
    )
