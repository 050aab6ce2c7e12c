"""The SQL of replays with purges and resyncs: a book as a list of entries that a recursive query carries from message to message.

An entry is (id, n, s, p, q): order (NULL for a level's anonymous quantity), place of its message, side, price, quantity.
"""

from __future__ import annotations

from ..schema import NO_ASK, NO_BID

ENTRY = "STRUCT(id BIGINT, n BIGINT, s INT, p BIGINT, q BIGINT)[]"
_SIGN = "CASE WHEN m.direction >= 0 THEN 1 ELSE -1 END"


def _levels(row: str, levels: int) -> str:
    """The real levels of a depth row as a list of (s, p, q)."""
    one = lambda s, n, j: f"{{'s': {n}, 'p': {row}.{s}_px_{j}, 'q': {row}.{s}_sz_{j}::BIGINT}}"
    every = ", ".join(one(s, n, j) for s, n in (("ask", -1), ("bid", 1)) for j in range(1, levels + 1))
    return f"[x FOR x IN [{every}] IF x.q > 0 AND x.p NOT IN ({NO_ASK}, {NO_BID})]"


FIRST_ROW = "SELECT symbol, trade_date, arg_min(snap, seq) AS seed, 1 AS st FROM sn GROUP BY ALL"
LAST_ROW_BEFORE = """SELECT symbol, trade_date, arg_max(snap, seq) AS seed, (max(seq) = first)::INT AS st
  FROM sn JOIN (SELECT symbol, trade_date, min(seq) AS first FROM f GROUP BY ALL) USING (symbol, trade_date) WHERE seq <= first GROUP BY symbol, trade_date, first"""


def book_steps(feed: str, modes: list[str], levels: int = 3, seeds: str = FIRST_ROW, unseeded: int = 1) -> str:
    """Tables of a recursive WITH, after that of ``feed`` (a table f): b has per mode and message k the book after it and what was counted.

    seeds: per session the list of levels to begin with and st, the number of messages that are left out; ``unseeded`` of those of a session without a row there.
    """
    start = "st"
    entry = "{'id': x.id, 'n': x.n, 's': x.s, 'p': x.p, 'q': %s}"
    through = "(x.p - price) * side"  # above 0: better than the price on the message's own side
    rank = "-x.s * x.p"
    edge = lambda s: f"list_max([-y.s * y.p FOR y IN snap IF y.s = {s}])"
    within = f"({rank} <= coalesce(CASE WHEN x.s = 1 THEN eb ELSE ea END, 9223372036854775807))"
    shown = "coalesce(list_sum([y.q FOR y IN snap IF y.s = x.s AND y.p = x.p]), 0)"
    total = "coalesce(list_sum([y.q FOR y IN done IF y.s = x.s AND y.p = x.p AND y.id IS NOT NULL]), 0)"
    before = "coalesce(list_sum([y.q FOR y IN done IF y.s = x.s AND y.p = x.p AND y.id IS NOT NULL AND y.n < x.n]), 0)"
    kept_qty = f"least(x.q, greatest({shown} - {before}, 0))::BIGINT"
    anon = f"greatest(x.q - coalesce(list_sum([y.q FOR y IN done IF y.s = x.s AND y.p = x.p AND y.id IS NOT NULL]), 0), 0)::BIGINT"
    our = "list_distinct([{'s': x.s, 'p': x.p, 'in': %s} FOR x IN done])" % within
    seen = "list_distinct([{'s': x.s, 'p': x.p} FOR x IN snap])"
    return f"""{feed},
one AS (SELECT DISTINCT ON (symbol, trade_date, seq) * FROM depth_primary WHERE seq IS NOT NULL),
sn AS (SELECT symbol, trade_date, seq, {_levels('one', levels)} AS snap FROM one),
sd AS ({seeds}),
m AS (SELECT f.*, row_number() OVER u AS k, coalesce(max(f.ts_ns) OVER (u ROWS UNBOUNDED PRECEDING), 0) AS clock, {_SIGN.replace('m.', 'f.')} AS side, coalesce(st, {unseeded}) AS st, sn.snap
  FROM f LEFT JOIN sn USING (symbol, trade_date, seq) LEFT JOIN sd USING (symbol, trade_date) WINDOW u AS (PARTITION BY f.symbol, f.trade_date ORDER BY f.seq)),
b AS (SELECT DISTINCT mode, f.symbol, f.trade_date, 0::BIGINT AS k, [{{'id': NULL::BIGINT, 'n': 0::BIGINT, 's': x.s::INT, 'p': x.p::BIGINT, 'q': x.q::BIGINT}} FOR x IN coalesce(seed, [])]::{ENTRY} AS book,
    NULL::STRUCT(known BOOLEAN, unknown BOOLEAN, over BOOLEAN, added BOOLEAN, dup BOOLEAN, under BOOLEAN, cleared BIGINT, gone BIGINT) AS c, NULL::STRUCT(rows BIGINT, levels_added BIGINT, levels_purged BIGINT, qty_adjusted BIGINT, orders_trimmed BIGINT) AS r
  FROM f LEFT JOIN sd USING (symbol, trade_date), (SELECT unnest({modes}) AS mode)
  UNION ALL
  SELECT mode, symbol, trade_date, k,
    (CASE WHEN NOT sync THEN done ELSE list_concat(
      [{entry % kept_qty} FOR x IN done IF {within} AND x.id IS NOT NULL AND {kept_qty} > 0], [x FOR x IN done IF NOT {within}],
      [{{'id': NULL::BIGINT, 'n': 0::BIGINT, 's': x.s::INT, 'p': x.p::BIGINT, 'q': {anon}}} FOR x IN snap IF {anon} > 0]) END)::{ENTRY},
    CASE WHEN k > {start} THEN {{'known': known, 'unknown': unknown, 'over': over, 'added': added, 'dup': dup, 'under': under, 'cleared': cleared, 'gone': gone}} END,
    CASE WHEN sync THEN {{'rows': 1::BIGINT,
      'levels_added': len([x FOR x IN {seen} IF NOT list_contains([{{'s': y.s, 'p': y.p}} FOR y IN done], x)]),
      'levels_purged': len([x FOR x IN {our} IF x.in AND NOT list_contains({seen}, {{'s': x.s, 'p': x.p}})]),
      'qty_adjusted': len([x FOR x IN {our} IF x.in AND list_contains({seen}, {{'s': x.s, 'p': x.p}}) AND coalesce(list_sum([y.q FOR y IN done IF y.s = x.s AND y.p = x.p]), 0) <> {shown}]),
      'orders_trimmed': len([x FOR x IN done IF x.id IS NOT NULL AND {within} AND {kept_qty} < x.q])}} END
  FROM (SELECT *, k > {start} AND mode = 'snapshot_resync' AND snap IS NOT NULL AS sync, {edge(1)} AS eb, {edge(-1)} AS ea FROM (
    SELECT *, CASE WHEN k <= {start} THEN kept
        WHEN added THEN list_append(kept, {{'id': order_id, 'n': k, 's': side, 'p': price, 'q': size::BIGINT}})
        WHEN known AND type IN (2, 4) THEN [{entry % 'CASE WHEN x.id = order_id THEN x.q - size ELSE x.q END'} FOR x IN kept IF x.id IS NULL OR x.id <> order_id OR x.q > size]
        WHEN known THEN [x FOR x IN kept IF x.id IS NULL OR x.id <> order_id]
        WHEN unknown THEN [{entry % 'CASE WHEN x.id IS NULL AND x.s = side AND x.p = price THEN x.q - size ELSE x.q END'} FOR x IN kept IF x.id IS NOT NULL OR x.s <> side OR x.p <> price OR x.q > size]
        ELSE kept END AS done,
      unknown AND size > anon_before OR unknown AND NOT level AS under,
      known AND type IN (2, 4) AND coalesce(list_max([x.q FOR x IN kept IF x.id = order_id]), 0) < size AS over FROM (
      SELECT *, fresh AND NOT there AS added, fresh AND there AS dup, type IN (2, 3, 4) AND there AS known, type IN (2, 3, 4) AND NOT there AS unknown FROM (
        SELECT *, type = 1 AND size > 0 AND price > 0 AS fresh, list_contains([x.id FOR x IN kept], order_id) AS there,
          coalesce(list_sum([x.q FOR x IN kept IF x.id IS NULL AND x.s = side AND x.p = price]), 0) AS anon_before, len([x FOR x IN kept IF x.s = side AND x.p = price]) > 0 AS level,
          len(list_distinct([{{'s': x.s, 'p': x.p}} FOR x IN book])) - len(list_distinct([{{'s': x.s, 'p': x.p}} FOR x IN kept])) AS cleared,
          len([x FOR x IN book IF x.id IS NOT NULL]) - len([x FOR x IN kept IF x.id IS NOT NULL]) AS gone FROM (
          SELECT *, CASE WHEN k <= {start} OR mode = 'message_only' THEN book
              WHEN type = 1 AND size > 0 AND price > 0 THEN [x FOR x IN book IF x.s = side OR {through} > 0]
              WHEN type = 4 OR type = 5 AND price > 0 THEN [x FOR x IN book IF x.s <> side OR {through} <= 0] ELSE book END AS kept FROM (
            SELECT b.mode, m.*, b.book FROM b JOIN m ON m.symbol = b.symbol AND m.trade_date = b.trade_date AND m.k = b.k + 1)))))))"""


def stats_sql(feed: str) -> str:
    """Counters per session of a seeded replay that is put right by snapshots."""
    n = lambda cond: f"count(*) FILTER ({cond})"
    fresh = "type = 1 AND size > 0 AND price > 0"
    total = lambda c: f"coalesce(sum({c}), 0)::BIGINT"
    counts = {
        "messages": "count(c)", "unknown_id": n("c.unknown"), "hidden_execs": n("c IS NOT NULL AND type = 5"), "crosses": n("c IS NOT NULL AND type = 6"), "halts": n("c IS NOT NULL AND type = 7"),
        "ignored": n(f"c IS NOT NULL AND (type NOT BETWEEN 1 AND 7 OR type = 1 AND NOT ({fresh}))"), "priority_purges": n("c.cleared > 0"), "adds": n("c.added"),
        "cancels": n("c.known AND type = 2"), "executes": n("c.known AND type = 4"), "removes": n("c.known AND type = 3"), "duplicate_ids": n("c.dup"), "over_qty": n("c.over"), "anon_reduce": n("c.unknown"),
        "anon_underflow": n("c.under"), "purged_orders": f"({total('c.gone')} + {total('r.orders_trimmed')})", "resync_rows": total("r.rows"),
        **{f"resync_{x}": total(f"r.{x}") for x in ("levels_added", "levels_purged", "qty_adjusted", "orders_trimmed")},
    }
    return f"WITH RECURSIVE {book_steps(feed, ['snapshot_resync'])} SELECT symbol, trade_date, {', '.join(f'{v} AS {k}' for k, v in counts.items())} FROM b JOIN m USING (symbol, trade_date, k) GROUP BY symbol, trade_date"


def _top(s: int, j: int, none: int) -> str:
    order = "DESC" if s == 1 else "ASC"
    at = f"list_sort(list_distinct([x.p FOR x IN book IF x.s = {s}]), '{order}')[{j}]"
    return f"coalesce({at}, {none}) AS p{j}, coalesce(list_sum([x.q FOR x IN book IF x.s = {s} AND x.p = {at}]), 0)::BIGINT AS q{j}"


def validate_sql(feed: str, modes: list[str], levels: int = 3) -> str:
    """Each mode's replay against the recorded depth of the same seq."""
    side = lambda s, n, none: ", ".join(_top(n, j, none).replace(f" AS p{j}", f" AS {s}_p{j}").replace(f" AS q{j}", f" AS {s}_q{j}") for j in range(1, levels + 1))
    ok = {
        j: " AND ".join(
            f"{s}_p{j} = coalesce(nullif(nullif(one.{s}_px_{j}, {NO_ASK}), {NO_BID}), {none}) AND {s}_q{j} = coalesce(one.{s}_sz_{j}, 0)" for s, none in (("ask", NO_ASK), ("bid", NO_BID))
        )
        for j in range(1, levels + 1)
    }
    exact = " AND ".join(ok.values())
    return f"""WITH RECURSIVE {book_steps(feed, modes, levels)},
t AS (SELECT mode, b.symbol, b.trade_date, m.seq, {side('bid', 1, NO_BID)}, {side('ask', -1, NO_ASK)} FROM b JOIN m USING (symbol, trade_date, k)),
c AS (SELECT t.mode, t.symbol, t.trade_date, t.seq, {exact} AS exact, {ok[1]} AS l1 FROM t JOIN one USING (symbol, trade_date, seq))
SELECT mode, symbol, trade_date, count(*) AS n_rows, count(*) FILTER (exact) AS n_exact, count(*) FILTER (l1) AS n_l1_exact, 100.0::DOUBLE * count(*) FILTER (exact) / count(*) AS exact_pct,
  100.0::DOUBLE * count(*) FILTER (l1) / count(*) AS l1_pct, min(seq) FILTER (NOT exact) AS first_mismatch FROM c GROUP BY mode, symbol, trade_date"""


END, START = 57_600_000_000_000, 34_200_000_000_000


def backtest_steps(feed: str, specs: list, levels: int = 3) -> str:
    """After ``book_steps``: w has a row per spec and event (a message, or one of our own delayed actions) with the state after it and its ``fills``.

    specs: ``RunSpec``s of equal signal windows, with purge, the default hours and sampling. An order is (id, s, p, q, qa, live, sub, arr, cx, ioc): q is what is left of it, arr its arrival, cx the arrival of
    its cancel. Closed orders leave the list. Actions of one time don't act on one another, so their order is free.
    """
    we, wz = specs[0].window_events, specs[0].zscore_window
    rows = ", ".join(
        f"({i}, {x.latency_ns}, {x.passive_entry}, {x.entry_z}::DOUBLE, {x.exit_z}::DOUBLE, {x.order_qty}, {x.max_position}, {int(x.order_ttl_s * 1e9)}, {int(x.max_hold_s * 1e9)}, {int(x.cooldown_ms * 1e6)}, '{x.cancel_assumption}')"
        for i, x in enumerate(specs)
    )
    best = lambda s, f: f"list_{f}([x.p FOR x IN book IF x.s = {s}])"
    qty = lambda s, p, book="book": f"coalesce(list_sum([y.q FOR y IN {book} IF y.s = {s} AND y.p = {p}]), 0)::BIGINT"
    order = "STRUCT(id BIGINT, s INT, p BIGINT, q BIGINT, qa BIGINT, live BOOLEAN, sub BIGINT, arr BIGINT, cx BIGINT, ioc BOOLEAN)[]"
    fill = "STRUCT(id BIGINT, ts BIGINT, s INT, p BIGINT, q BIGINT, passive BOOLEAN)[]"
    put = lambda o, **kw: "{" + ", ".join(f"'{c}': {kw.get(c, f'{o}.{c}')}" for c in ("id", "s", "p", "q", "qa", "live", "sub", "arr", "cx", "ioc")) + "}"
    same, worse = "o.s = m_side", "(o.p - m_price) * o.s > 0"
    # what a message takes from an order, and from the queue before it
    hit = f"""(CASE WHEN NOT o.live THEN 0 WHEN m_type IN (4, 5) AND {same} THEN CASE WHEN {worse} THEN m_size WHEN m_price <> o.p THEN 0 WHEN m_type = 5 THEN CASE WHEN o.qa = 0 THEN m_size ELSE 0 END ELSE m_size - least(m_size, o.qa) END
      WHEN m_type = 1 AND o.s <> m_side AND (m_price - o.p) * o.s <= 0 THEN m_size ELSE 0 END)::BIGINT"""
    eaten = f"""(CASE WHEN NOT o.live OR NOT {same} OR m_price <> o.p THEN 0 WHEN m_type = 4 THEN least(m_size, o.qa)
      WHEN m_type IN (2, 3) AND o.qa > 0 THEN CASE cancels WHEN 'Optimistic' THEN least(m_size, o.qa) WHEN 'ProRata' THEN CASE WHEN shown > 0 THEN least(floor(m_size * (o.qa / shown) + 0.5)::BIGINT, o.qa) ELSE 0 END ELSE 0 END ELSE 0 END)::BIGINT"""
    opposite = "list_sort(list_distinct([x.p * arr.s FOR x IN book IF x.s = -arr.s AND (x.p - arr.p) * arr.s <= 0]))"  # ranks, best first
    level = lambda i: f"coalesce(list_sum([y.q FOR y IN book IF y.s = -arr.s AND y.p = ranks[{i}] * arr.s]), 0)::BIGINT"
    due = "list_min([least(CASE WHEN o.live THEN 9223372036854775807 ELSE o.arr END, coalesce(o.cx, 9223372036854775807)) FOR o IN orders])"
    flat = lambda side, n, at: f"{{'id': {n}, 's': {side}, 'p': {side} * {NO_ASK}, 'q': abs(pos2), 'qa': 0, 'live': false, 'sub': {at}, 'arr': {at} + lat, 'cx': NULL, 'ioc': true}}"
    open_qty = lambda side, orders: f"coalesce(list_sum([o.q FOR o IN {orders} IF o.s = {side}]), 0)"
    return f"""{book_steps(feed, ['snapshot_resync'], levels, LAST_ROW_BEFORE, 0)},
t0 AS (SELECT b.symbol, b.trade_date, b.k, b.book, {best(1, 'max')} AS pb, {best(-1, 'min')} AS pa FROM b),
t1 AS (SELECT *, CASE WHEN pb IS NULL THEN 0 ELSE {qty(1, 'pb')} END AS qb, CASE WHEN pa IS NULL THEN 0 ELSE {qty(-1, 'pa')} END AS qa FROM t0),
t2 AS (SELECT *, lag(pb) OVER u AS pb0, lag(pa) OVER u AS pa0, lag(qb) OVER u AS qb0, lag(qa) OVER u AS qa0, lag(book) OVER u AS book0 FROM t1 WINDOW u AS (PARTITION BY symbol, trade_date ORDER BY k)),
t3 AS (SELECT t2.*, m.seq, m.clock, m.type AS m_type, m.size::BIGINT AS m_size, m.price AS m_price, m.side AS m_side, CASE WHEN m.type IN (2, 3) THEN {qty('m.side', 'm.price', 'book0')} ELSE 0 END AS shown, k > st AS counts,
    (CASE WHEN pb IS NULL OR pb0 IS NULL OR pa IS NULL OR pa0 IS NULL THEN 0 ELSE CASE WHEN pb >= pb0 THEN qb ELSE 0 END - CASE WHEN pb <= pb0 THEN qb0 ELSE 0 END - CASE WHEN pa <= pa0 THEN qa ELSE 0 END + CASE WHEN pa >= pa0 THEN qa0 ELSE 0 END END)::DOUBLE AS ofi
  FROM t2 JOIN m USING (symbol, trade_date, k)),
t4 AS (SELECT symbol, trade_date, k, row_number() OVER u AS n, sum(ofi) OVER (u ROWS BETWEEN {we - 1} PRECEDING AND CURRENT ROW) AS flow FROM t3 WHERE counts WINDOW u AS (PARTITION BY symbol, trade_date ORDER BY k)),
t5 AS (SELECT *, sum(flow) OVER u / {wz} AS mean, sum(flow * flow) OVER u / {wz} AS sq FROM t4 WINDOW u AS (PARTITION BY symbol, trade_date ORDER BY k ROWS BETWEEN {wz - 1} PRECEDING AND CURRENT ROW)),
bk AS MATERIALIZED (SELECT symbol, trade_date, k, book, pb, pa FROM t0),
ev AS MATERIALIZED (SELECT symbol, trade_date, k, clock, m_type, m_size, m_price, m_side, shown, pb, pa, coalesce(CASE WHEN n >= {max(we, wz)} AND sq - mean * mean >= 1e-12 THEN (flow - mean) / sqrt(sq - mean * mean) END, 0)::DOUBLE AS z FROM t3 LEFT JOIN t5 USING (symbol, trade_date, k)),
sp(spec_id, lat, passive_entry, entry_z, exit_z, order_qty, cap, ttl, hold, cool, cancels) AS (VALUES {rows}),
w AS (SELECT spec_id, symbol, trade_date, 0::BIGINT AS step, max(st)::BIGINT AS k, max(k)::BIGINT AS last, {START}::BIGINT AS now, []::{order} AS orders, 0::BIGINT AS nid, 0::BIGINT AS ord, false AS leaving, 0::BIGINT AS entered, {START}::BIGINT AS acted,
    0::BIGINT AS pos, false AS closing, false AS done, []::{fill} AS fills, 0::BIGINT AS sent, 0::BIGINT AS refused, 0::BIGINT AS dropped FROM m, sp GROUP BY spec_id, symbol, trade_date
  UNION ALL
  SELECT spec_id, symbol, trade_date, step + 1, k2, last, now2, orders5::{order}, nid3, ord3, leaving3, entered2, acted3, pos2, closing2, what = 'end', fills::{fill}, sent3, refused3, dropped2 FROM (
   SELECT *, CASE WHEN enter AND entry_ok OR leave AND exit_ok THEN nid2 + 1 ELSE nid2 END AS nid3,
     CASE WHEN leave THEN CASE WHEN exit_ok THEN nid2 + 1 ELSE 0 END WHEN enter THEN CASE WHEN entry_ok THEN nid2 + 1 ELSE 0 END ELSE ord2 END AS ord3,
     CASE WHEN leave THEN true WHEN enter THEN false ELSE leaving2 END AS leaving3, CASE WHEN leave OR enter THEN now2 ELSE acted END AS acted3,
     sent2 + (leave OR enter)::BIGINT AS sent3, refused2 + (leave AND NOT exit_ok OR enter AND NOT entry_ok)::BIGINT AS refused3,
     CASE WHEN leave AND exit_ok THEN list_append(orders4, {flat('-sign(pos2)::INT', 'nid2 + 1', 'now2')})
       WHEN enter AND entry_ok THEN list_append(orders4, {{'id': nid2 + 1, 's': go, 'p': CASE WHEN (go = 1) = passive_entry THEN pb ELSE pa END, 'q': order_qty, 'qa': 0, 'live': false, 'sub': now2, 'arr': now2 + lat, 'cx': NULL, 'ioc': NOT passive_entry}}) ELSE orders4 END AS orders5 FROM (
   SELECT *, abs(pos2 - sign(pos2) * (abs(pos2) + {open_qty('-sign(pos2)', 'orders4')})) <= cap AS exit_ok, abs(pos2 + go * (order_qty + {open_qty('go', 'orders4')})) <= cap AS entry_ok FROM (
   SELECT *, CASE WHEN z > 0 THEN 1 ELSE -1 END AS go, CASE WHEN leave AND ord2 > 0 OR late THEN [{put('o', cx='CASE WHEN o.id = was THEN coalesce(o.cx, now2 + lat) ELSE o.cx END')} FOR o IN orders3] ELSE orders3 END AS orders4 FROM (
   SELECT *, think AND pos2 <> 0 AND NOT (leaving2 AND ord2 > 0) AND (z * sign(pos2) < exit_z OR now2 - entered2 > hold) AS leave,
     think AND pos2 = 0 AND ord2 = 0 AND now2 - acted >= cool AND abs(z) > entry_z AND pb IS NOT NULL AND pa IS NOT NULL AS enter FROM (
   SELECT *, CASE WHEN NOT think THEN ord WHEN late OR NOT alive THEN 0 ELSE ord END AS ord2, ord AS was FROM (
   SELECT *, think AND alive AND NOT leaving2 AND now2 - list_max([o.sub FOR o IN orders3 IF o.id = ord]) > ttl AS late FROM (
   SELECT *, what = 'message' AND NOT closing2 AS think, coalesce(list_contains([o.id FOR o IN orders3], ord), false) AS alive, nid + flatten::BIGINT AS nid2, sent + (shut AND pos2 <> 0)::BIGINT AS sent2, refused + (shut AND pos2 <> 0 AND NOT flatten)::BIGINT AS refused2 FROM (
   SELECT *, CASE WHEN flatten THEN list_append(held, {flat('-sign(pos2)::INT', 'nid + 1', 'now2')}) ELSE held END AS orders3, closing OR shut AS closing2 FROM (
   SELECT *, shut AND pos2 <> 0 AND abs(pos2 - sign(pos2) * (abs(pos2) + {open_qty('-sign(pos2)', 'orders2')})) <= cap AS flatten,
     CASE WHEN shut THEN [{put('o', cx='coalesce(o.cx, now2 + lat)')} FOR o IN orders2] ELSE orders2 END AS held FROM (
   SELECT *, what = 'shut' OR what = 'message' AND NOT closing AND clock >= {END - 60_000_000_000} AS shut,
     CASE WHEN len(fills) = 0 THEN entered WHEN pos2 = 0 THEN 0 WHEN touched_zero OR entered = 0 THEN fills[1].ts ELSE entered END AS entered2, CASE WHEN touched_zero THEN false ELSE leaving END AS leaving2 FROM (
   SELECT *, pos + coalesce(list_sum([f.s * f.q FOR f IN fills]), 0)::BIGINT AS pos2, len([i FOR i IN range(1, len(fills) + 1) IF pos + list_sum([f.s * f.q FOR f IN fills[1:i]]) = 0]) > 0 AS touched_zero FROM (
   SELECT *, CASE what
       WHEN 'message' THEN [{{'id': o.id, 'ts': clock, 's': o.s, 'p': o.p, 'q': least({hit}, o.q), 'passive': true}} FOR o IN orders IF least({hit}, o.q) > 0]
       WHEN 'arrive' THEN [{{'id': arr.id, 'ts': now2, 's': arr.s, 'p': ranks[i] * arr.s, 'q': least({level('i')}, arr.q - before[i]), 'passive': false}} FOR i IN range(1, len(ranks) + 1) IF arr.q > before[i]]
       WHEN 'end' THEN [{{'id': 0, 'ts': now, 's': -sign(pos)::INT, 'p': floor((CASE WHEN cpb IS NOT NULL AND cpa IS NOT NULL THEN (cpb + cpa) / (2.0::DOUBLE * 10000) ELSE coalesce(cpb, cpa) / 10000.0::DOUBLE END) * 10000 + 0.5)::BIGINT, 'q': abs(pos), 'passive': false}}]
       ELSE [] END::{fill} AS fills,
     CASE what WHEN 'message' THEN [{put('o', q=f'o.q - least({hit}, o.q)', qa=f'o.qa - {eaten}')} FOR o IN orders IF o.q > {hit}]
       WHEN 'arrive' THEN [CASE WHEN o.id = arr.id THEN {put('o', q='o.q - taken', live='true', qa=f"{qty('arr.s', 'arr.p')}")} ELSE o END FOR o IN orders IF o.id <> arr.id OR o.q > taken AND NOT o.ioc]
       WHEN 'cancel' THEN [o FOR o IN orders IF o.cx IS NULL OR o.cx > due OR NOT o.live AND o.arr > due] ELSE orders END AS orders2,
     dropped + CASE WHEN what = 'cancel' THEN len([o FOR o IN orders IF o.cx <= due]) WHEN what = 'arrive' AND arr.ioc AND arr.q > taken THEN 1 ELSE 0 END AS dropped2 FROM (
   SELECT *, least(arr.q, coalesce(list_sum([{level('i')} FOR i IN range(1, len(ranks) + 1)]), 0))::BIGINT AS taken, [coalesce(list_sum([{level('j')} FOR j IN range(1, i)]), 0)::BIGINT FOR i IN range(1, len(ranks) + 1)] AS before FROM (
   SELECT *, CASE WHEN what = 'arrive' THEN {opposite} ELSE [] END AS ranks, CASE WHEN what = 'message' THEN k + 1 ELSE k END AS k2, CASE what WHEN 'message' THEN greatest(now, clock) WHEN 'arrive' THEN greatest(now, due) WHEN 'cancel' THEN greatest(now, due) ELSE now END AS now2 FROM (
   SELECT *, [o FOR o IN orders IF NOT o.live AND o.arr = due][1] AS arr, CASE WHEN clock IS NULL AND NOT closing THEN 'shut' WHEN due IS NOT NULL AND due < coalesce(clock, 9223372036854775807) THEN CASE WHEN len([o FOR o IN orders IF NOT o.live AND o.arr = due]) > 0 THEN 'arrive' ELSE 'cancel' END
       WHEN clock IS NOT NULL THEN 'message' ELSE 'end' END AS what FROM (
   SELECT w.* EXCLUDE (fills), sp.* EXCLUDE (spec_id), nx.clock, nx.m_type, nx.m_size, nx.m_price, nx.m_side, nx.shown, nx.z, nx.pb, nx.pa, cu.book, cu.pb AS cpb, cu.pa AS cpa, {due.replace('orders', 'w.orders')} AS due
   FROM w JOIN sp USING (spec_id) LEFT JOIN ev nx ON nx.symbol = w.symbol AND nx.trade_date = w.trade_date AND nx.k = w.k + 1 LEFT JOIN bk cu ON cu.symbol = w.symbol AND cu.trade_date = w.trade_date AND cu.k = w.k
   WHERE NOT w.done AND (w.k < w.last OR NOT w.closing OR len(w.orders) > 0 OR w.pos <> 0))))))))))))))))))"""


def _label(specs: list) -> str:
    return "CASE spec_id " + " ".join(f"WHEN {i} THEN '{x.label or i}'" for i, x in enumerate(specs)) + " END AS label"


def _account(feed: str, specs: list, levels: int = 3) -> str:
    """After ``backtest_steps``: fl has the fills in order with their fees, cum what they add up to, sa the equity at every second."""
    fee = " ".join(f"WHEN {i} THEN CASE WHEN f.passive THEN {x.maker_fee}::DOUBLE ELSE {x.taker_fee}::DOUBLE END * f.q" for i, x in enumerate(specs))
    return f"""{backtest_steps(feed, specs, levels)},
fl AS MATERIALIZED (SELECT spec_id, symbol, trade_date, f.ts AS ts, f.id AS id, f.s AS side, f.p AS price, f.q AS qty, f.passive AS passive, CASE spec_id {fee} END AS fee, row_number() OVER (PARTITION BY spec_id, symbol, trade_date ORDER BY step, i) AS r
  FROM (SELECT spec_id, symbol, trade_date, step, unnest(fills) AS f, unnest(range(len(fills))) AS i FROM w)),
cm AS (SELECT *, sum(-side * qty * (price / 10000.0::DOUBLE) - fee) OVER u AS cash, (sum(side * qty) OVER u)::BIGINT AS pos FROM fl WINDOW u AS (PARTITION BY spec_id, symbol, trade_date ORDER BY r)),
cum AS (SELECT spec_id, symbol, trade_date, ts, arg_max(cash, r) AS cash, arg_max(pos, r) AS pos FROM cm GROUP BY ALL),
md AS (SELECT symbol, trade_date, since, arg_max(mid, k) FILTER (mid IS NOT NULL) AS mid FROM (
  SELECT bk.symbol, bk.trade_date, bk.k, CASE WHEN bk.k = coalesce(sd.st, 0) THEN -1 ELSE m.clock END AS since,
    coalesce(CASE WHEN pb IS NOT NULL AND pa IS NOT NULL THEN (pb + pa) / (2.0::DOUBLE * 10000) ELSE coalesce(pb, pa) / 10000.0::DOUBLE END, 'nan'::DOUBLE) AS mid
  FROM bk LEFT JOIN sd USING (symbol, trade_date) LEFT JOIN m USING (symbol, trade_date, k) WHERE bk.k >= coalesce(sd.st, 0)) GROUP BY ALL),
tm AS (SELECT symbol, trade_date, {START} + n * 1000000000 AS t FROM (SELECT DISTINCT symbol, trade_date FROM f), range(0, {(END - START) // 1_000_000_000 + 1}) x(n)),
mt AS (SELECT symbol, trade_date, t, coalesce(last_value(nullif(mid, 'nan'::DOUBLE) IGNORE NULLS) OVER (PARTITION BY symbol, trade_date ORDER BY t), 0) AS mid
  FROM (SELECT tm.symbol, tm.trade_date, tm.t, md.mid FROM tm ASOF LEFT JOIN md ON md.symbol = tm.symbol AND md.trade_date = tm.trade_date AND tm.t >= md.since)),
sm AS (SELECT sp.spec_id, mt.* FROM mt, sp),
sa AS (SELECT sm.spec_id, sm.symbol, sm.trade_date, sm.t AS ts, coalesce(cum.cash, 0) + coalesce(cum.pos, 0) * sm.mid AS equity, coalesce(cum.pos, 0)::BIGINT AS position, sm.mid
  FROM sm ASOF LEFT JOIN cum ON cum.spec_id = sm.spec_id AND cum.symbol = sm.symbol AND cum.trade_date = sm.trade_date AND sm.t >= cum.ts)"""


def fills_sql(feed: str, specs: list) -> str:
    return f"""WITH RECURSIVE {_account(feed, specs)}
SELECT symbol, trade_date, spec_id, {_label(specs)}, ts, id AS order_id, side, price, qty, passive, round(fee, 6) AS fee FROM fl"""


def equity_sql(feed: str, specs: list) -> str:
    return f"""WITH RECURSIVE {_account(feed, specs)}
SELECT symbol, trade_date, spec_id, {_label(specs)}, ts, round(equity, 6) + 0.0 AS equity, position, round(mid, 6) AS mid FROM sa"""


def metrics_sql(feed: str, specs: list, name: str | None = None) -> str:
    """The metrics of every spec and session; name: a field of the specs that comes out beside them."""
    value = lambda x: f"'{getattr(x, name)}'" if isinstance(getattr(x, name), str) else f"{float(getattr(x, name))}::DOUBLE"
    extra = "" if name is None else ", CASE spec_id " + " ".join(f"WHEN {i} THEN {value(x)}" for i, x in enumerate(specs)) + f" END AS {name}"
    return f"""WITH RECURSIVE {_account(feed, specs)},
rz AS (SELECT spec_id, symbol, trade_date, r, (side * qty)::BIGINT AS pos, 0.0::DOUBLE AS realized, (price / 10000.0)::DOUBLE AS cost FROM fl WHERE r = 1
  UNION ALL SELECT fl.spec_id, fl.symbol, fl.trade_date, fl.r, rz.pos + fl.side * fl.qty, CASE WHEN rz.pos * fl.side < 0 THEN rz.realized + least(fl.qty, abs(rz.pos)) * (fl.price / 10000.0 - rz.cost) * -fl.side ELSE rz.realized END,
    CASE WHEN rz.pos * fl.side >= 0 THEN (rz.cost * abs(rz.pos) + fl.price / 10000.0 * fl.qty) / (abs(rz.pos) + fl.qty) WHEN fl.qty > abs(rz.pos) THEN fl.price / 10000.0 WHEN fl.qty = abs(rz.pos) THEN 0 ELSE rz.cost END
  FROM rz JOIN fl ON fl.spec_id = rz.spec_id AND fl.symbol = rz.symbol AND fl.trade_date = rz.trade_date AND fl.r = rz.r + 1),
re AS (SELECT spec_id, symbol, trade_date, arg_max(realized, r) AS realized FROM rz GROUP BY ALL),
dd AS (SELECT *, equity - lag(equity) OVER u AS chg, greatest(0, max(equity) OVER (u ROWS UNBOUNDED PRECEDING)) - equity AS fall FROM sa WINDOW u AS (PARTITION BY spec_id, symbol, trade_date ORDER BY ts)),
cv AS (SELECT spec_id, symbol, trade_date, arg_max(equity, ts) AS pnl, max(fall) AS fall, CASE WHEN stddev_samp(chg) > 1e-15 THEN avg(chg) / stddev_samp(chg) * sqrt({(END - START) / 1e9} * 252.0) ELSE 0 END AS sharpe FROM dd GROUP BY ALL),
fs AS (SELECT spec_id, symbol, trade_date, sum(fee) AS fees, sum(qty)::BIGINT AS volume, count(*) AS n, count(*) FILTER (passive) AS n_passive, count(DISTINCT id) FILTER (id > 0) AS hit, bool_or(id = 0) AS forced FROM fl GROUP BY ALL),
ws AS (SELECT spec_id, symbol, trade_date, arg_max(sent, step) AS sent, arg_max(refused, step) AS refused, arg_max(dropped, step) AS dropped FROM w GROUP BY ALL)
SELECT symbol, trade_date, spec_id, {_label(specs)}, round(pnl, 6) + 0.0 AS total_pnl, round(pnl + coalesce(fees, 0), 6) + 0.0 AS gross_pnl, round(coalesce(realized, 0), 6) + 0.0 AS realized_pnl, round(coalesce(fees, 0), 6) + 0.0 AS fees,
  round(fall, 6) AS max_drawdown, round(sharpe, 4) + 0.0 AS sharpe, coalesce(volume, 0) AS volume, coalesce(n, 0) AS n_fills, sent - refused AS n_orders, coalesce(n_passive, 0) AS n_passive_fills, coalesce(n - n_passive, 0) AS n_aggressive_fills,
  round(CASE WHEN sent > refused THEN coalesce(hit, 0) / (sent - refused) ELSE 0 END, 6) AS fill_rate, round(CASE WHEN volume > 0 THEN pnl / volume ELSE 0 END, 6) + 0.0 AS pnl_per_share, sent AS orders_submitted, refused AS orders_rejected,
  dropped AS orders_cancelled, coalesce(forced, false) AS forced_close{extra}
FROM ws JOIN cv USING (spec_id, symbol, trade_date) LEFT JOIN re USING (spec_id, symbol, trade_date) LEFT JOIN fs USING (spec_id, symbol, trade_date)"""
