"""Leakage against a brute-force search for runs of words."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

import tidemark.llm.leakage as lk
from tidemark.llm.leakage import leaked

VOCABULARY = [f"w{i}" for i in range(60)]


def words(text, pattern="[a-z0-9]+"):
    return re.findall(pattern, text.lower())


def truth(docs, items, run=16):
    out = set()
    for i, t in items:
        w = words(t or "")
        runs = {tuple(w[j : j + run]) for j in range(len(w) - run + 1)}
        for d, x in docs:
            v = words(x or "")
            if any(tuple(v[j : j + run]) in runs for j in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def data(seed, n_docs=120, n_items=90):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(VOCABULARY) for _ in range(n))
    items = [(i, text(rnd.choice((5, 16, 17, 40, 80)))) for i in range(n_items)] + [(900, None), (901, ""), (902, "w1 " * 30)]
    docs = []
    for d in range(n_docs):
        parts = [text(rnd.randrange(0, 90))]
        for _ in range(rnd.randrange(3)):
            w = words(rnd.choice(items)[1] or "")
            n = rnd.choice((14, 15, 16, 17, 30))
            at = rnd.randrange(max(1, len(w) - n + 1))
            parts += [rnd.choice((" ", "-", "\r\n// ", "_")).join(w[at : at + n]).upper(), text(rnd.randrange(40))]
        docs.append((d, " ".join(parts)))
    return docs + [(500, None), (501, ""), (502, "?!"), (503, "w1 " * 15), (504, "W1, " * 16)], items


@pytest.mark.parametrize("seed,chunk,shard", [(1, 1 << 20, 1 << 20), (2, 100, 1 << 20), (3, 1 << 20, 500)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, shard):
    docs, items = data(seed)
    df = spark.createDataFrame(docs, "d bigint, text string")
    it = spark.createDataFrame(items + items[:5], "i bigint, text string")
    index = [spark.sparkContext.broadcast(x.value) for x in lk.shards(it.distinct().where("text IS NOT NULL").withColumnRenamed("text", "t"), 16, None, shard)]
    assert len(index) == (1 if shard > 10_000 else -(-sum(len(words(t or "")) for _, t in items if len(words(t or "")) >= 16) // shard))
    cutter, found = lk.Cutter(None), set()
    for d, x in docs:  # here, for the small pieces
        for p in lk.pieces([cutter.ready(x)], cutter.joint, 15, chunk):
            w = lk.Words(p, cutter.joint)
            for s in index:
                found |= {(d, int(s.value.ids[k])) for _, k, _ in s.value.search(w, lk.rows_hash(w.hash, 5), lk.rows_hash(w.hash, 16), {})}
    assert found == truth(docs, items)
    got = leaked(df, "d", "text", it, "i", "text", postings_per_shard=shard).collect()
    assert {(r.d, r.i) for r in got} == truth(docs, items)
    runs = lambda t: {tuple(words(t or "")[j : j + 16]) for j in range(len(words(t or "")) - 15)}
    assert all(r.n_runs == len(runs(dict(docs)[r.d]) & runs(dict(items)[r.i])) for r in got)


def test_retrieval_gives_every_item_at_its_threshold_and_no_other(spark):
    docs, items = data(11, 30, 400)
    it = spark.createDataFrame([(i, t) for i, t in items if t], "i bigint, t string").distinct()
    index = lk.shards(it, 16, None, 1 << 20)[0].value
    assert len(index.ids) > 3 * lk.BLOCK
    rnd = random.Random(3)
    for _ in range(300):
        terms = rnd.choices(range(len(index.term)), k=rnd.randrange(1, 27))
        score = {}
        for t in terms:
            for p in range(index.at[t], index.at[t + 1]):
                score[int(index.item[p])] = score.get(int(index.item[p]), 0) + int(index.impact[p])
        want = sorted(x for x, s in score.items() if s >= index.threshold[x])
        assert index.retrieve(terms) == want
    for k in range(len(index.ids)):  # an item's own run
        a = index.first[k]
        own = index.terms_of(lk.rows_hash(index.hash[a : a + 16], 5))
        assert k in index.retrieve(own.tolist())


def test_other_scripts_and_answers(spark):
    item = "der Käse und das Brot lagen schon früh am Morgen auf dem Tisch in der kleinen Küche am Fluß"
    docs = spark.createDataFrame([(1, f"vorher {item} nachher, die Antwort ist Zürich am See."), (2, item), (3, "Zürich am See"), (4, None)], "d bigint, text string")
    items = spark.createDataFrame([(1, item, "Zürich am See"), (2, item, None), (3, "kurz", "x")], "i bigint, text string, answer string")
    got = leaked(docs, "d", "text", items, "i", "text", word=r"\w+", answer="answer").collect()
    assert {(r.d, r.i, r.answer_found) for r in got} == {(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, False)}


def test_many_items_in_one_pass(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(f"v{rnd.randrange(3000)}" for _ in range(n))
    items = [(i, text(40)) for i in range(4000)]
    docs = [(d, text(100) + " " + items[d * 7][1] + " " + text(50)) for d in range(300)]
    out = leaked(spark.createDataFrame(docs, "d bigint, text string"), "d", "text", spark.createDataFrame(items, "i bigint, text string"), "i", "text", postings_per_shard=20_000)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.d, r.i) for r in out.collect()} == {(d, d * 7) for d in range(300)}


def test_a_hot_text_takes_linear_time(spark):
    docs, items = data(9, 5, 50)
    it = spark.createDataFrame(items, "i bigint, text string").where(F.col("text").isNotNull())
    began = time.time()
    got = leaked(spark.createDataFrame([(1, (items[4][1] + " ") * 20_000)], "d bigint, text string"), "d", "text", it, "i", "text").collect()
    assert 4 in {r.i for r in got} or len(words(items[4][1])) < 16
    assert time.time() - began < 60


def test_other_run_lengths(spark):
    docs, items = data(7, 40, 40)
    for run in (8, 40):
        got = leaked(spark.createDataFrame(docs, "d bigint, text string"), "d", "text", spark.createDataFrame(items, "i bigint, text string"), "i", "text", run).collect()
        assert {(r.d, r.i) for r in got} == truth(docs, items, run)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a " * 20)], "d bigint, text string"), spark.createDataFrame([(1, "a " * 20)], "i bigint, text string")
    assert leaked(docs, "d", "text", items.limit(0), "i", "text").count() == 0 and leaked(docs.limit(0), "d", "text", items, "i", "text").count() == 0
    assert [tuple(r) for r in leaked(docs, "d", "text", items, "i", "text").collect()] == [(1, 1, 1)]
