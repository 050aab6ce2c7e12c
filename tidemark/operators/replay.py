"""Ordered scans: replaying sessions of messages through a book.

A session's book is sequential; sessions run in parallel. The rows are placed by session and sorted, and each task streams
Arrow batches through the state of one session at a time: no session is ever held in memory, only its book is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signals import SESSION
from ..plans.scratch import ship
from ..schema import BUY, EXEC_HIDDEN, EXEC_VISIBLE, NO_ASK, NO_BID, SELL, depth_columns, real_price, real_size
from .book import APPLY_COUNTERS, BOOK_COUNTERS, RESYNC_COUNTERS, Message, OrderBook, apply_message, ofi_term, resync
from .depth import long_levels, real_levels, seeds


def feed(messages: DataFrame) -> DataFrame:
    """Messages as a replay takes them: symbol, trade_date, seq, ts_ns, type, order_id, size, price, direction.

    Once per seq (the version with the greatest recv_ts, then the greatest content). A NULL order_id or size counts as 0, a NULL direction as 0 (a
    buy), a NULL price as 0, a NULL type as 0 (ignored). ts_ns may be NULL: such a message happens at the time of the one before.
    """
    cols = ["type", "order_id", "size", "price", "direction", "ts_ns"]
    zero = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0)).alias(c)
    return (
        messages.where("seq IS NOT NULL").groupBy("symbol", "trade_date", "seq").agg(F.max(F.struct("recv_ts", *cols)).alias("m"))
        .select("symbol", "trade_date", "seq", "m.ts_ns", *[zero(c) for c in cols[:-1]])
    )


def ordered_scan(df: DataFrame, session: Sequence[str], order: str | Sequence[str], start: Callable[[], object], schema: T.StructType) -> DataFrame:
    """Stream each session's rows in order through a state: ``start()`` gives an object with row(dict) -> rows out and end() -> rows out (tuples without the session)."""
    names, n = df.columns, len(session)
    full = T.StructType([*[df.schema[c] for c in session], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        kind = None
        for b in batches:
            if kind is None:
                kind = pa.schema([(full.fields[i].name, b.schema.field(full.fields[i].name).type) for i in range(n)] + [(f.name, _arrow(f.dataType)) for f in schema.fields])
            out: list[tuple] = []
            cols = [c.to_pylist() for c in b.columns]
            keys = list(zip(*[cols[names.index(c)] for c in session]))
            for i, values in enumerate(zip(*cols)):
                if state is None or keys[i] != key:
                    if state is not None:
                        out += [(*key, *r) for r in state.end()]
                    key, state = keys[i], start()
                out += [(*key, *r) for r in state.row(values)]
            if out:
                yield _batch(out, kind)
        if state is not None and (out := [(*key, *r) for r in state.end()]):
            yield _batch(out, kind)

    # A fixed number, which adaptive execution leaves alone: it goes by bytes and would put many sessions of work into few tasks.
    spark = df.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *[F.col(c) for c in session]).sortWithinPartitions(*session, *([order] if isinstance(order, str) else order)).mapInArrow(run, full)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in t.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[t.simpleString()]


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


REPLAY = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("type", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("best_bid", "bid_qty", "best_ask", "ask_qty", "ofi_e", "trade_qty", "trade_side")],
    ]
)
MODES = ("message_only", "priority_purge", "snapshot_resync")


def padded(book: OrderBook, k: int) -> list[int]:
    """The best k levels in the order of ``depth_columns``, with spelled-out empty ones behind."""
    asks, bids = ([*((p, q) for p, q, _ in book.depth(side, k)), *[(none, 0)] * (k - book.num_levels(side))] for side, none in ((SELL, NO_ASK), (BUY, NO_BID)))
    return [x for a, b in zip(asks, bids) for x in (*a, *b)]


def parse_seed(text: str | None) -> list[tuple[int, int, int]]:
    """(side, price, size) of a seed written as ``side:price:size;...``."""
    return [tuple(map(int, x.split(":"))) for x in text.split(";")] if text else []


def parse_snapshot(text: str) -> dict[int, list[tuple[int, int]]]:
    """Per side the (price, size) levels of a snapshot written as ``asks|bids``, each ``price:size;...``."""
    asks, bids = ([tuple(map(int, x.split(":"))) for x in part.split(";")] if part else [] for part in text.split("|"))
    return {SELL: asks, BUY: bids}


class Replay:
    """The state of one session: rows are (symbol, trade_date, seq, ts_ns, type, order_id, size, price, direction, seed, snap).

    seed, on any row before ``start``: levels to begin with; snap: levels to put the book right by after the message.
    """

    def __init__(self, start: int, depth_k: int, purge: bool, stats_only: bool):
        self.start, self.k, self.purge, self.stats_only = start, depth_k, purge, stats_only
        self.book, self.applied, self.synced = OrderBook(), Counter(), Counter()
        self.n, self.now = 0, 0

    def row(self, v: tuple) -> list[tuple]:
        _, _, seq, ts, kind, order_id, size, price, direction, seed, snap = v
        ts = self.now = ts if ts is not None else self.now
        for planted in parse_seed(seed):
            self.book.add_anon(*planted)
        side = BUY if direction >= 0 else SELL
        ofi = trade = traded = 0
        if self.n >= self.start:
            before = self.book.touch()
            apply_message(self.book, Message(ts, kind, order_id, size, price, side), self.applied, self.purge)
            if snap is not None:
                resync(self.book, parse_snapshot(snap), self.synced)
            ofi = ofi_term(before, self.book.touch())
            if kind in (EXEC_VISIBLE, EXEC_HIDDEN):
                trade, traded = size, side
        self.n += 1
        if self.stats_only:
            return []
        bid, bid_qty, ask, ask_qty = self.book.touch()
        out = (seq, ts, kind, bid, bid_qty, ask, ask_qty, ofi, trade, traded)
        return [(*out, *padded(self.book, self.k)) if self.k else out]

    def end(self) -> list[tuple]:
        if not self.stats_only:
            return []
        return [counters(self.book, self.applied, self.synced)]


def counters(book: OrderBook, applied: Counter, synced: Counter) -> tuple:
    """A row of ``STATS``."""
    return (*[applied[c] for c in APPLY_COUNTERS], *[book.stats[c] for c in BOOK_COUNTERS], *[synced[c] for c in RESYNC_COUNTERS])


STATS = T.StructType([T.StructField(c, T.LongType()) for c in (*APPLY_COUNTERS, *BOOK_COUNTERS, *[f"resync_{c}" for c in RESYNC_COUNTERS])])


def _snapshot_text(levels: int) -> Column:
    """The real levels of the depth row in the struct ``d``, as ``parse_snapshot`` reads them."""

    def side(name: str) -> Column:
        real = real_levels(F.array(*[F.struct(F.col(f"d.{name}_px_{j}").alias("px"), F.col(f"d.{name}_sz_{j}").alias("sz")) for j in range(1, levels + 1)]))
        return F.array_join(F.transform(real, lambda x: F.concat_ws(":", x["px"], x["sz"])), ";")

    return F.concat(side("ask"), F.lit("|"), side("bid"))


def first_books(messages: DataFrame, depth: DataFrame, levels: int) -> DataFrame:
    """The recorded book that each session begins with: session, seq (of its first message), first_book (text as of ``with_snapshots``), covered.

    It is the last depth row up to the first message, never a later one, which a run couldn't know yet. covered: the row is of the first message itself, so it
    holds what that message did. A session without such a row has none.
    """
    firsts = messages.groupBy(*SESSION).agg(F.min("seq").alias("first"))
    last = F.max(F.struct(F.col("seq").alias("at"), *depth_columns(levels))).alias("d")
    at = depth.join(firsts, list(SESSION)).where("seq <= first").groupBy(*SESSION, "first").agg(last)
    return at.select(*SESSION, F.col("first").alias("seq"), _snapshot_text(levels).alias("first_book"), (F.col("d.at") == F.col("first")).alias("covered"))


def with_snapshots(messages: DataFrame, depth: DataFrame | None, levels: int, seed: bool, snapshot: bool) -> DataFrame:
    """The feed with ``seed`` (on each session's first message) and ``snap`` (the depth row of the same seq, its real levels).

    Both are written as text: nested columns, even NULL ones, would be most of the cost of handing rows to Python.
    """
    rows = messages.withColumns({"seed": F.lit(None).cast("string"), "snap": F.lit(None).cast("string")})
    if depth is not None and seed:
        level = F.concat_ws(":", "side", "px", "sz")
        s = seeds(depth, levels).groupBy(*SESSION).agg(F.array_join(F.sort_array(F.collect_list(level)), ";").alias("seed"))
        firsts = messages.groupBy(*SESSION).agg(F.min("seq").alias("seq")).join(s, list(SESSION))
        rows = rows.drop("seed").join(firsts, [*SESSION, "seq"], "left")
    if depth is not None and snapshot:
        one = depth.where("seq IS NOT NULL").groupBy(*SESSION, "seq").agg(F.max(F.struct(*depth_columns(levels))).alias("d")).select(*SESSION, "seq", _snapshot_text(levels).alias("snap"))
        rows = rows.drop("snap").join(one, [*SESSION, "seq"], "left")
    return rows.select(*SESSION, "seq", "ts_ns", F.col("type").cast("int").alias("type"), "order_id", "size", "price", "direction", "seed", "snap")


def replay_wide(messages: DataFrame, depth: DataFrame | None, levels: int, mode: str, start: int, depth_k: int, seed: bool) -> DataFrame:
    """``replay`` with its depth in the wide columns of ``depth_columns``: flat rows come back from Python much faster than nested ones."""
    if mode not in MODES:
        raise ValueError(f"mode is none of {', '.join(MODES)}: {mode}")
    rows = with_snapshots(messages, depth, levels, seed, mode == "snapshot_resync")
    purge = mode != "message_only"
    kind = T.StructType([*REPLAY.fields, *[T.StructField(c, T.LongType()) for c in depth_columns(depth_k)]])
    return ordered_scan(rows, SESSION, "seq", lambda: Replay(start, depth_k, purge, False), kind)


def replay(messages: DataFrame, depth: DataFrame | None = None, levels: int = 3, mode: str = "message_only", start: int = 0, depth_k: int = 0, seed: bool = False) -> DataFrame:
    """A row per message of each session: seq, ts_ns, type, touch, ofi_e, trade_qty, trade_side, and for depth_k > 0 ``asks`` and ``bids``.

    messages: a ``feed``. mode: message_only, priority_purge, or snapshot_resync (with purge, put right by the depth row of the same seq). Messages
    before the ``start``-th of a session aren't applied: they show the seed and have no flow.
    """
    out = replay_wide(messages, depth, levels, mode, start, depth_k, seed)
    if not depth_k:
        return out
    side = lambda s: F.array(*[F.struct(F.col(f"{s}_px_{j}").alias("px"), F.col(f"{s}_sz_{j}").alias("sz")) for j in range(1, depth_k + 1)]).alias(f"{s}s")
    return out.select(*SESSION, *[f.name for f in REPLAY.fields], side("ask"), side("bid"))


def replay_stats(messages: DataFrame, depth: DataFrame | None = None, levels: int = 3, mode: str = "message_only", start: int = 0, seed: bool = False) -> DataFrame:
    """A row of counters per session."""
    if mode not in MODES:
        raise ValueError(f"mode is none of {', '.join(MODES)}: {mode}")
    rows = with_snapshots(messages, depth, levels, seed, mode == "snapshot_resync")
    purge = mode != "message_only"
    return ordered_scan(rows, SESSION, "seq", lambda: Replay(start, 0, purge, True), STATS)


class _Modes:
    """The replays of a session in several modes at once, each compared with the recorded depth of the same seq; rows are those of ``Replay`` and ``recorded``."""

    def __init__(self, modes: Sequence[str], levels: int):
        self.runs = [(m, Replay(1, levels, m != "message_only", False), [0, 0, 0, None]) for m in modes]
        self.one = 4  # columns of the first level

    def row(self, v: tuple) -> list[tuple]:
        *row, recorded = v
        wanted = None if recorded is None else [int(x) for x in recorded.split(";")]
        for mode, run, seen in self.runs:
            (got,) = run.row(tuple(row) if mode == "snapshot_resync" else (*row[:-1], None))
            if wanted is None:
                continue
            depth = list(got[len(REPLAY.fields) :])
            seen[0] += 1
            if depth == wanted:
                seen[1] += 1
            elif seen[3] is None:
                seen[3] = got[0]
            seen[2] += depth[: self.one] == wanted[: self.one]
        return []

    def end(self) -> list[tuple]:
        return [(mode, n, exact, one, 100.0 * exact / n, 100.0 * one / n, first) for mode, _, (n, exact, one, first) in self.runs if n]


CHECKED = T.StructType(
    [T.StructField("mode", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_rows", "n_exact", "n_l1_exact")], T.StructField("exact_pct", T.DoubleType()), T.StructField("l1_pct", T.DoubleType()),
     T.StructField("first_mismatch", T.LongType())]
)


def validate(messages: DataFrame, depth: DataFrame, levels: int = 3, modes: Sequence[str] = MODES) -> DataFrame:
    """Per mode and session, each replay against the recorded depth of the same seq: n_rows, n_exact, n_l1_exact, exact_pct, l1_pct, first_mismatch.

    Replays are seeded from the session's first depth row and start at message 1. All modes go through the messages in one scan, each with its own book. Of several
    different depth rows of a seq the greatest counts, as in a resync. Both spellings of an empty side are equal.
    """
    for mode in modes:
        if mode not in MODES:
            raise ValueError(f"mode is none of {', '.join(MODES)}: {mode}")
    rows = with_snapshots(messages, depth, levels, True, True)
    one = depth.where("seq IS NOT NULL").groupBy(*SESSION, "seq").agg(F.max(F.struct(*depth_columns(levels))).alias("d"))
    empty = {c: F.lit(NO_ASK if c.startswith("ask") else NO_BID) for c in depth_columns(levels) if "_px_" in c}
    plain = F.array_join(F.array(*[F.coalesce(real_price(f"d.{c}"), empty[c]) if c in empty else real_size(f"d.{c}").cast("bigint") for c in depth_columns(levels)]), ";")
    rows = rows.join(one.select(*SESSION, "seq", plain.alias("recorded")), [*SESSION, "seq"], "left").select(*rows.columns, "recorded")
    out = ordered_scan(rows, SESSION, "seq", lambda: _Modes(modes, levels), CHECKED)
    return out.select("mode", *SESSION, *[f.name for f in CHECKED.fields[1:]])


def explain_row(messages: DataFrame, depth: DataFrame, symbol: str, trade_date: str, seq: int, mode: str = "priority_purge", levels: int = 3) -> DataFrame:
    """One message with the rebuilt and the recorded depth after it: a row per level and side. Only its session is replayed."""
    one = (F.col("symbol") == symbol) & (F.col("trade_date") == trade_date)
    got = replay_wide(messages.where(one), depth.where(one), levels, mode, 1, levels, True).where(F.col("seq") == seq)
    part = lambda df, a, b: long_levels(df, levels).select("side", "level", F.col("px").alias(a), F.col("sz").alias(b))
    both = part(got, "rebuilt_px", "rebuilt_sz").join(part(depth.where(one & (F.col("seq") == seq)), "recorded_px", "recorded_sz").distinct(), ["side", "level"], "full")
    message = messages.where(one & (F.col("seq") == seq)).select(F.lit(seq).alias("seq"), "ts_ns", "type", "order_id", "size", "price", "direction")
    return both.withColumn("seq", F.lit(seq)).join(message, "seq", "left")
