"""Packing: every piece once, no container beyond its capacity, little room unused."""

import random
from collections import Counter

import pytest

from tidemark.llm.packing import pack, plan
from tidemark.llm.tokens import encoder, token_counts
from tidemark.llm.tokens import TOKENIZER

SPECS = [(1, 512, "x"), (2, 2048, "x"), (3, 4096, "x"), (4, 8192, "x"), (9, None, "x"), (8, 0, "x"), (7, 512, "x")]


def check(rows, sizes, caps):
    top = max(caps.values())
    pieces: dict = {}
    used: Counter = Counter()
    kind = {}
    for r in rows:
        pieces.setdefault(r.id, []).append((r.piece_no, r.from_unit, r.n_units))
        used[r.container_id] += r.n_units
        assert kind.setdefault(r.container_id, (r.spec_id, r.capacity)) == (r.spec_id, r.capacity) and caps[r.spec_id] == r.capacity
    for c, n in used.items():
        assert n <= kind[c][1]
        assert n == 0 or kind[c][1] == min(x for x in caps.values() if x >= n)  # downsized
    want = {}
    for i, n in sizes:
        n = max(n or 0, 0)
        want[i] = [(k, k * top, min(top, n - k * top)) for k in range(max(1, -(-n // top)))]
    assert {i: sorted(p) for i, p in pieces.items()} == want
    return 1 - sum(used.values()) / max(sum(kind[c][1] for c in used), 1)


@pytest.mark.parametrize("rows_per_bucket", [500_000, 20])
def test_random_sizes(spark, rows_per_bucket):
    rnd = random.Random(3)
    sizes = [(i, rnd.choice((rnd.randrange(1, 300), rnd.randrange(1, 3000), 77, rnd.randrange(1, 30_000)))) for i in range(1500)] + [(-1, 0), (-2, None), (-3, -5)]
    df = spark.createDataFrame(sizes, "id bigint, n bigint").repartition(5)
    out = pack(df, "id", "n", spark.createDataFrame(SPECS, "spec_id int, cap int, n string"), "spec_id", "cap", rows_per_bucket).collect()
    assert check(out, sizes, {1: 512, 2: 2048, 3: 4096, 4: 8192}) < 0.01


def test_edges(spark):
    specs = spark.createDataFrame(SPECS[:2], "spec_id int, cap int, n string")
    p = lambda sizes: pack(spark.createDataFrame(sizes, "id bigint, n bigint"), "id", "n", specs, "spec_id", "cap").collect()
    assert p([]) == []
    check(p([(1, 0), (2, None)]), [(1, 0), (2, None)], {1: 512, 2: 2048})
    check(p([(1, 2048), (2, 2049), (3, 4096)]), [(1, 2048), (2, 2049), (3, 4096)], {1: 512, 2: 2048})
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 1)], "id bigint, n bigint"), "id", "n", specs.limit(0), "spec_id", "cap")


def test_repeated_items_come_out_each(spark):
    df = spark.createDataFrame([(1, 10)] * 60, "id bigint, n bigint")
    out = pack(df, "id", "n", spark.createDataFrame(SPECS, "spec_id int, cap int, n string"), "spec_id", "cap").collect()
    assert len(out) == 60 and max(Counter(r.container_id for r in out).values()) <= 51


def test_few_patterns():
    patterns = plan({s: 10**9 + s for s in range(1, 2000)}, [512, 2048])
    assert len(patterns) < 4000 and all(sum(s * n for s, n in p.contents) <= p.capacity for p in patterns)
    done = Counter()
    for p in patterns:
        for s, n in p.contents:
            done[s] += n * p.times
    assert done == {s: 10**9 + s for s in range(1, 2000)}


def test_token_counts(spark):
    texts = [(1, "def f(x): return x"), (2, ""), (3, None), (4, "x" * 200_000), (5, "<|endoftext|> é 漢")]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(texts, "d int, t string"), "d", "t").collect()}
    enc = encoder(TOKENIZER)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in texts} and enc.decode(enc.encode_ordinary(texts[4][1])) == texts[4][1]
