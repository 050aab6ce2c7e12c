"""The book: golden sequences, counters, and a randomised comparison with a naive one."""

import random
from collections import Counter

from tidemark.operators.book import Message, OrderBook, apply_message, ofi_term, resync
from tidemark.operators.replay import Replay
from tidemark.schema import BUY, NO_ASK, NO_BID, SELL


def book_of(*messages, purge=True):
    b, st = OrderBook(), Counter()
    for m in messages:
        apply_message(b, Message(*m), st, purge)
    return b, st


def replay_rows(messages, start=0, k=0, seed=None, purge=True):
    r = Replay(start, k, purge, False)
    out = []
    for i, (ts, kind, oid, size, price, side) in enumerate(messages):
        out += r.row(("s", "d", i, ts, kind, oid, size, price, side, seed if i == 0 else None, None))
    return r, out


def test_features_and_flow():
    rows = [(1, 1, 1, 100, 1000, 1), (2, 1, 2, 100, 1100, -1), (3, 1, 3, 50, 1000, 1), (4, 4, 2, 30, 1100, -1), (5, 1, 4, 20, 1050, -1)]
    _, out = replay_rows(rows, k=2)
    assert (out[1][3], out[1][5]) == (1000, 1100)
    assert [r[7] for r in out[2:]] == [50, 30, -20]
    assert (out[3][8], out[3][9]) == (30, -1)
    assert list(out[4][10:]) == [1050, 20, 1000, 150, 1100, 70, NO_BID, 0]


def test_small_replay():
    r, out = replay_rows([(1, 1, 1, 100, 1000, 1), (2, 1, 2, 100, 1100, -1), (3, 1, 3, 50, 1000, 1), (4, 4, 2, 30, 1100, -1)])
    assert [o[3] for o in out] == [1000] * 4 and [o[6] for o in out] == [0, 100, 100, 70]
    assert r.book.stats["adds"] == 3


def test_seed_and_start():
    seed = "-1:1100:40;1:1000:100"
    r, out = replay_rows([(1, 1, 1, 100, 1000, 1), (2, 3, 1, 100, 1000, 1)], start=1, seed=seed)
    assert out[0][3] == 1000 and out[1][3] == NO_BID and out[1][5] == 1100
    assert r.applied["unknown_id"] == 1
    assert out[0][7:10] == (0, 0, 0)


def test_trade_before_start_has_no_flow():
    _, out = replay_rows([(1, 4, 9, 10, 1000, 1)], start=1)
    assert out[0][7:10] == (0, 0, 0)


def test_all_types():
    b, st = book_of((1, 1, 10, 100, 2200000, 1), (2, 1, 11, 200, 2200100, -1), (3, 2, 10, 40, 2200000, 1))
    assert b.best_qty(BUY) == 60
    for m in [(4, 4, 11, 50, 2200100, -1), (5, 5, 0, 50, 2200050, 1)]:
        apply_message(b, Message(*m), st, False)
    assert b.best_qty(SELL) == 150
    for m in [(6, 3, 10, 60, 2200000, 1), (7, 7, 0, 0, 0, 1)]:
        apply_message(b, Message(*m), st, False)
    assert b.best_price(BUY) == NO_BID and st["hidden_execs"] == 1 and st["halts"] == 1 and st["messages"] == 7


def test_unknown_ids_take_anonymous_quantity():
    b, st = OrderBook(), Counter()
    b.add_anon(SELL, 2200100, 500)
    apply_message(b, Message(1, 4, 999, 100, 2200100, -1), st)
    assert b.best_qty(SELL) == 400 and st["unknown_id"] == 1
    apply_message(b, Message(2, 3, 998, 400, 2200100, -1), st)
    assert b.best_price(SELL) == NO_ASK


def test_priority_purge():
    for purge, best in ((True, 1200), (False, 1000)):
        b, st = OrderBook(), Counter()
        b.add_anon(SELL, 1000, 100)
        b.add(1, SELL, 1200, 50)
        apply_message(b, Message(1, 4, 1, 10, 1200, -1), st, purge)
        assert b.best_price(SELL) == best
        if purge:
            assert b.best_qty(SELL) == 40 and st["priority_purges"] == 1
            apply_message(b, Message(2, 1, 7, 10, 1250, 1), st, purge)
            assert b.best_price(SELL) == NO_ASK and b.best_price(BUY) == 1250 and st["priority_purges"] == 2


def test_purge_comes_before_the_duplicate_check():
    b, st = book_of((1, 1, 1, 10, 1000, 1), (2, 1, 2, 5, 1100, -1), (3, 1, 1, 10, 1100, 1))
    assert b.best_price(SELL) == NO_ASK and b.stats["duplicate_ids"] == 1


def test_resync():
    b, st = OrderBook(), Counter()
    b.add(1, SELL, 1000, 100)
    b.add(2, SELL, 1100, 100)
    b.add(3, BUY, 900, 100)
    snap = {SELL: [(1100, 60), (1200, 30)], BUY: [(900, 100), (800, 10)]}
    resync(b, snap, st)
    assert b.depth(SELL, 3) == [(1100, 60, 1), (1200, 30, 0)] and b.level_qty(BUY, 800) == 10
    assert b.order(1) is None and b.order(2)["qty"] == 60
    assert (st["levels_purged"], st["levels_added"], st["qty_adjusted"]) == (1, 2, 1)
    b.add(4, BUY, 700, 5)
    resync(b, snap, st)
    assert b.level_qty(BUY, 700) == 5 and not b.broken_rules()


def test_resync_with_an_empty_side_clears_it():
    b, st = book_of((1, 1, 1, 10, 1000, 1))
    resync(b, {SELL: [], BUY: []}, st)
    assert b.num_orders == 0


def test_anonymous_clamp_and_queue():
    b = OrderBook()
    b.add_anon(BUY, 1000, 300)
    b.add(7, BUY, 1000, 50)
    assert b.level_qty(BUY, 1000) == 350 and b.qty_ahead(7) == 300
    assert [b.reduce_anon(BUY, 1000, 100), b.reduce_anon(BUY, 1000, 500)] == [100, 200]
    assert b.stats["anon_underflow"] == 1 and b.level_qty(BUY, 1000) == 50


def test_over_execution_removes():
    b, _ = book_of((1, 1, 1, 10, 1200, -1), (2, 4, 1, 25, 1200, -1))
    assert b.num_orders == 0 and b.stats["over_qty"] == 1


def test_first_in_first_out():
    b = OrderBook()
    for i, q in ((1, 10), (2, 20), (3, 30)):
        b.add(i, BUY, 1000, q)
    assert b.qty_ahead(3) == 30
    totals = []
    for i in (2, 1, 3):
        b.remove(i)
        totals.append(b.level_qty(BUY, 1000))
    assert totals == [40, 30, 0] and not b.broken_rules()


def test_trimming_drops_the_youngest():
    b = OrderBook()
    for i, q in ((1, 10), (2, 20), (3, 30)):
        b.add(i, BUY, 1000, q)
    assert b.set_level_visible(BUY, 1000, 25) == 2
    assert b.order(3) is None and b.order(2)["qty"] == 15 and not b.broken_rules()


def test_flow_needs_both_sides():
    assert ofi_term((NO_BID, 0, 1100, 5), (1000, 5, 1100, 5)) == 0


def test_random_operations_against_a_naive_book():
    rnd = random.Random(42)
    b, naive, live, nxt = OrderBook(), {}, [], 1
    for step in range(60_000):
        x = rnd.random()
        if x < 0.45 or not live:
            side, price, qty = rnd.choice((BUY, SELL)), 10_000 + 100 * rnd.randrange(60), rnd.randrange(1, 500)
            b.add(nxt, side, price, qty)
            naive[nxt] = [side, price, qty]
            live.append(nxt)
            nxt += 1
        else:
            at = rnd.randrange(len(live))
            i = live[at]
            qty = naive[i][2]
            if x < 0.65:
                take = max(1, qty // 2)
                b.cancel(i, take)
            elif x < 0.85:
                take = rnd.randrange(1, 600)
                b.execute(i, take)
            else:
                take = qty
                b.remove(i)
            naive[i][2] -= take
            if naive[i][2] <= 0:
                del naive[i]
                live[at] = live[-1]
                live.pop()
        if step % 10_000 == 9_999:
            assert not b.broken_rules()
            for side in (BUY, SELL):
                levels: Counter = Counter()
                for s, p, q in naive.values():
                    if s == side:
                        levels[p] += q
                assert [(p, q) for p, q, _ in b.depth(side, 100)] == sorted(levels.items(), key=lambda y: -side * y[0])
