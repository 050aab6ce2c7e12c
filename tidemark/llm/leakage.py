"""Evaluation texts inside training texts.

The test items make a BM25 inverted index whose terms are ``TERM`` words in a row: per term the items that have it with their
impacts as small integers, in blocks of items with the greatest impact of each. A training text is cut into passages of
two segments of ``run`` words that overlap by one segment, so that every run of ``run`` words lies inside some passage. An item's threshold is the
least score that any of its own runs has, so a passage that holds a run of the item scores at least that much: retrieval
above the thresholds loses nothing. Each passage is a query of block-max WAND: cursors on its terms' postings are moved to the
next item that their greatest impacts could bring to a threshold, blocks that can't are jumped over. The retrieved pairs of passage and item, and
no others, are verified word by word.

The index is a table in the shared folder, computed by Spark. It is handed to the tasks in shards of a bounded number of postings, all of
which are consulted in one pass over the texts; no text is moved.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, ship, stored
from .wordcut import Piece, mixed, pieces, prefix, span_hash, spans

TERM = 5  # words of a term
BLOCK = 64  # items of a block
POSTINGS = 1 << 20  # of a shard, about 100 bytes each
K1, B = 1.2, 0.75
ASCII = np.zeros(256, bool)
ASCII[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
SPACED = np.arange(256) != 32


class Cutter:
    """Texts as bytes, and which bytes belong to words: maximal runs of ASCII letters and digits after lower-casing, or the matches of ``pattern`` in the lower-cased text."""

    def __init__(self, pattern: str | None):
        self.pattern = re.compile(pattern) if pattern else None
        self.joint = SPACED if pattern else ASCII

    def ready(self, text: str | None) -> bytes | None:
        if not text:
            return None
        low = text.lower()
        if self.pattern:
            low = " ".join("".join(m.group(0).split()) for m in self.pattern.finditer(low))
        return low.encode("utf-8", "replace")


class Words:
    def __init__(self, p: Piece, joint: np.ndarray):
        self.data = p.data
        inside = joint[p.data].copy()
        inside[p.data == 10] = False
        self.start, self.end = spans(inside)
        self.hash = span_hash(prefix(p.data), self.start, self.end)
        self.doc = p.doc_of(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def rows_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n values in a row."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return mixed(out)


def postings(items: DataFrame, run: int, pattern: str | None = None) -> DataFrame:
    """The words of the items ``i``, ``t`` in order: i, v (which text of it), at, word, h, term (of the words from here on, NULL at the end) and impact (1 to 255).

    Impacts are BM25 weights over all items: every term's number of items and every item's length count. Items of fewer than ``run`` words have no rows.
    """
    cutter = Cutter(pattern)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                whole = cutter.ready(b.column(2)[r].as_py()) or b""
                for p in pieces([whole], cutter.joint, 0, len(whole) + 1):
                    w = Words(p, cutter.joint)
                    n = len(w.hash)
                    if n < run:
                        continue
                    term = np.zeros(n, np.uint64)
                    term[: max(n - TERM + 1, 0)] = rows_hash(w.hash, TERM)
                    one = lambda c: pa.repeat(b.column(c)[r], n)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [one(0), one(1), pa.array(np.arange(n, dtype=np.int32)), pa.array([w.word(k) for k in range(n)], pa.binary()), pa.array(w.hash.view(np.int64)),
                         pa.array(term.view(np.int64), mask=np.arange(n) > n - TERM), pa.repeat(pa.scalar(n, pa.int32()), n)],
                        ["i", "v", "at", "word", "h", "term", "size"],
                    )

    words = items.select("i", F.xxhash64("t").alias("v"), "t").mapInArrow(cut, "i bigint, v bigint, at int, word binary, h bigint, term bigint, size int")
    terms = words.where("term IS NOT NULL").groupBy("i", "v", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))
    total, mean = words.where("at = 0").agg(F.count(F.lit(1)), F.avg("size")).first()
    n, mean = F.lit(float(total)), F.lit(mean or 1.0)
    seen = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    most = F.log(1 + F.greatest(n - 0.5, F.lit(0.5)) / 1.5) * (K1 + 1)  # no weight is above it
    impact = F.greatest(F.lit(1), F.least(F.lit(255), F.round(weight / most * 255))).cast("smallint")
    weighed = terms.join(seen, "term").select("i", "v", "term", impact.alias("impact"))
    return words.drop("size").join(weighed, ["i", "v", "term"], "left")


class Texts:
    """The words of one shard's items, from its rows of ``postings`` sorted by (i, v, at)."""

    def __init__(self, rows: pa.Table):
        get = lambda c: rows.column(c).combine_chunks()
        i, v, h = (get(c).to_numpy() for c in ("i", "v", "h"))
        self.hash = h.view(np.uint64)
        word = get("word").cast(pa.large_binary())
        lengths = np.array([len(x) for x in word.to_pylist()], np.int64)
        self.blob, self.word_at = b"".join(word.to_pylist()), np.append(0, np.cumsum(lengths)).astype(np.int64)
        self.new = np.concatenate([[True], (i[1:] != i[:-1]) | (v[1:] != v[:-1])]) if len(i) else np.zeros(0, bool)
        self.first = np.append(np.flatnonzero(self.new), len(i))  # of each item's words
        self.ids = i[self.first[:-1]]

    def word(self, j: int) -> bytes:
        return self.blob[self.word_at[j] : self.word_at[j + 1]]

    def standing_in(self, w: Words) -> set[int]:
        """The ids of the items whose whole text stands in the words."""
        out = set()
        for i, a, b in zip(self.ids.tolist(), self.first[:-1].tolist(), self.first[1:].tolist()):
            for p in np.flatnonzero(w.hash[: max(len(w.hash) - (b - a) + 1, 0)] == self.hash[a]).tolist():
                if w.doc[p] == w.doc[p + b - a - 1] and all(w.word(p + s) == self.word(a + s) for s in range(b - a)):
                    out.add(i)
                    break
        return out


class Index(Texts):
    """A shard with its postings, thresholds and runs."""

    def __init__(self, rows: pa.Table, run: int):
        super().__init__(rows)
        get = lambda c: rows.column(c).combine_chunks()
        self.run = run
        n, item = len(self.hash), np.cumsum(self.new) - 1
        has = ~np.asarray(get("term").is_null())
        term = get("term").fill_null(0).to_numpy().view(np.uint64)
        impact = get("impact").fill_null(0).to_numpy().astype(np.int64)
        # thresholds: per run its distinct terms' impacts, the least per item
        self.threshold = np.zeros(len(self.ids), np.int64)
        span = run - TERM + 1
        for k, (a, b) in enumerate(zip(self.first[:-1], self.first[1:])):
            t, x = term[a : b - TERM + 1], impact[a : b - TERM + 1]
            again = np.zeros(len(t), np.int64)  # how far back the same term stands, 0 for nowhere
            if len(np.unique(t)) < len(t):
                last: dict[int, int] = {}
                for p, y in enumerate(t.tolist()):
                    again[p] = p - last.get(y, p)
                    last[y] = p
            fresh = np.lib.stride_tricks.sliding_window_view(again, span)
            weight = np.lib.stride_tricks.sliding_window_view(x, span)
            self.threshold[k] = np.where((fresh == 0) | (fresh > np.arange(span)), weight, 0).sum(1).min()
        self.least = int(self.threshold.min()) if n else 0
        blocks = -(-len(self.ids) // BLOCK)
        self.block_least = np.array([self.threshold[k * BLOCK : (k + 1) * BLOCK].min() for k in range(blocks)], np.int64)
        # postings: by term, then item; one per pair
        order = np.lexsort((item[has], term[has]))
        t, x, w = term[has][order], item[has][order], impact[has][order]
        once = np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])]) if len(t) else np.zeros(0, bool)
        t, self.item, self.impact = t[once], x[once].astype(np.int32), w[once].astype(np.int16)
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
        self.term, self.at = t[start], np.append(start, len(t))
        self.most = np.maximum.reduceat(self.impact, start).astype(np.int64) if len(start) else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(start)), np.diff(self.at))
        block = self.item // BLOCK
        cut = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (block[1:] != block[:-1])])) if len(t) else np.zeros(0, int)
        self.block_no, self.block_most = block[cut], np.maximum.reduceat(self.impact, cut) if len(cut) else np.zeros(0, np.int16)
        self.block_at = np.append(np.searchsorted(number[cut], np.arange(len(start))), len(cut))
        bits = max(16, int(8 * max(len(self.term), 1)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)  # a filter before the search for a term
        self.maybe[self.term >> self.shift] = True
        # runs, per item sorted by hash, for the verification
        runs = rows_hash(self.hash, run)
        self.run_hash, self.run_at = [], []
        for a, b in zip(self.first[:-1], self.first[1:]):
            order = np.argsort(runs[a : b - run + 1], kind="stable")
            self.run_hash.append(runs[a : b - run + 1][order])
            self.run_at.append(a + order)

    def terms_of(self, h: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for those of no item."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.maybe[h >> self.shift])
        if len(at):
            k = np.minimum(np.searchsorted(self.term, h[at]), len(self.term) - 1)
            out[at] = np.where(self.term[k] == h[at], k, -1)
        return out

    def retrieve(self, terms: list[int]) -> list[int]:
        """Block-max WAND: the items whose score over ``terms`` reaches their threshold."""
        cursors = []  # [current item, place, end, greatest impact, term]
        for t in terms:
            a, b = int(self.at[t]), int(self.at[t + 1])
            cursors.append([int(self.item[a]), a, b, int(self.most[t]), t])
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0, None
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= self.least:
                    pivot = k
                    break
            if pivot is None:
                break
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            block = d // BLOCK
            end = (block + 1) * BLOCK
            if sum(self._most_in(c[4], block) for c in cursors[: pivot + 1]) < self.block_least[block]:
                # nothing in this block before the next cursor: jump over
                goal = min(end, cursors[pivot + 1][0]) if pivot + 1 < len(cursors) else end
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == d:
                if sum(int(self.impact[c[1]]) for c in cursors[: pivot + 1]) >= self.threshold[d]:
                    found.append(d)
                goal, moved = d + 1, cursors[: pivot + 1]
            else:
                goal, moved = d, [c for c in cursors[: pivot + 1] if c[0] < d]
            for c in moved:
                if c[0] < goal:
                    c[1] = c[1] + int(np.searchsorted(self.item[c[1] : c[2]], goal))
                    c[0] = int(self.item[c[1]]) if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[1] < c[2]]
        return found

    def _most_in(self, t: int, block: int) -> int:
        """The greatest impact that a term has in a block."""
        a, b = int(self.block_at[t]), int(self.block_at[t + 1])
        k = bisect_left(self.block_no, block, a, b)
        return int(self.block_most[k]) if k < b and self.block_no[k] == block else 0

    def search(self, w: Words, terms: np.ndarray, runs: np.ndarray, memo: dict) -> Iterator[tuple[int, int, int]]:
        """(text, item, hash of a run) of every run of an item in the words."""
        run = self.run
        tid = self.terms_of(terms)
        known = tid >= 0
        if not known.any():
            return
        reach = np.append(0, np.cumsum(np.where(known, self.most[tid], 0)))
        begin = np.arange(0, len(tid), run)
        span = np.minimum(begin + 2 * run - TERM, len(tid))  # terms that lie in the 2 * run - 1 words of a passage
        for k in np.flatnonzero(reach[span] - reach[begin] >= self.least).tolist():
            a, b = int(begin[k]), int(span[k])
            wanted = tid[a:b][known[a:b]]
            key = wanted.tobytes()
            items = memo.get(key)
            if items is None:
                if len(memo) > 50_000:
                    memo.clear()
                items = memo[key] = self.retrieve(wanted.tolist())
            for x in items:
                yield from self._verify(w, a, min(a + run, len(runs)), runs, x)

    def _verify(self, w: Words, a: int, b: int, runs: np.ndarray, x: int) -> Iterator[tuple[int, int, int]]:
        table, places = self.run_hash[x], self.run_at[x]
        lo = np.searchsorted(table, runs[a:b])
        hit = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == runs[a:b])
        for p in (hit + a).tolist():
            if w.doc[p] != w.doc[p + self.run - 1]:
                continue
            k = int(lo[p - a])
            j = int(places[k])
            if all(w.word(p + s) == self.word(j + s) for s in range(self.run)):
                yield int(w.doc[p]), x, int(runs[p])


def shards(items: DataFrame, run: int, pattern: str | None, size: int, whole: bool = False) -> list[Broadcast]:
    """The index as broadcasts of about ``size`` postings each; a single item isn't divided. whole: only the words of the items, to find whole texts."""
    spark = items.sparkSession
    table, path = stored(postings(items, run, pattern))
    n = table.count()
    parts = max(1, -(-n // size))
    cols = ["i", "v", "at", "word", "h", "term", "impact"]
    out = []
    for s in range(parts):
        mine = table.where(F.pmod(F.xxhash64("i", "v"), F.lit(parts)) == s) if parts > 1 else table
        rows = mine.select(*cols).sort("i", "v", "at").toArrow()
        out.append(spark.sparkContext.broadcast(Texts(rows) if whole else Index(rows, run)))
    discard(spark, path)
    return out


def leaked(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 16, word: str | None = None, answer: str | None = None, postings_per_shard: int = POSTINGS
) -> DataFrame:
    """doc_id, item_id, ``n_runs``: every document that has ``run`` words in a row of an item's text, with the number of different runs of the item it has.

    Words: maximal runs of ASCII letters and digits after lower-casing, or the matches of the pattern ``word``. NULL, empty and shorter texts match nothing.
    answer: a second column of the items; then ``answer_found`` says whether the answer's words also stand in a row in the document (false for an answer without words).
    Documents need no shuffle: one pass over them consults all shards of the index. What a task holds is the index, about 100 bytes a word of the items.
    Several documents rows of one id each come out. Repeated item rows are one; an item id with several texts stands for all of them.
    """
    if run < TERM:
        raise ValueError(f"run must be at least {TERM} words")
    spark = docs.sparkSession
    ship(spark)
    named = lambda c: items.where(F.col(item_id).isNotNull() & F.col(c).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(c).alias("t")).distinct()
    index = shards(named(item_text), run, word, postings_per_shard)
    answers = shards(named(answer), 1, word, postings_per_shard, True) if answer else []
    slim = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("x"))
    kind = slim.schema["d"].dataType.simpleString()
    cutter = Cutter(word)
    out = slim.mapInArrow(lambda batches: _scan(batches, index, answers, run, cutter), f"d {kind}, i bigint, n_runs bigint" + (", answer_found boolean" if answer else ""))
    return out.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "n_runs", *(["answer_found"] if answer else []))


def _scan(batches: Iterator[pa.RecordBatch], index: list[Broadcast], answers: list[Broadcast], run: int, cutter: Cutter) -> Iterator[pa.RecordBatch]:
    parts = [s.value for s in index if len(s.value.ids)]
    memos: list[dict] = [{} for _ in parts]
    replies = [s.value for s in answers]
    longest = max([int(np.diff(a.first).max()) for a in replies if len(a.ids)], default=1)
    for b in batches:
        found: dict[tuple[int, int], set[int]] = {}
        for p in pieces((cutter.ready(v.as_py()) for v in b.column(1)) if parts else [], cutter.joint, run - 1):
            w = Words(p, cutter.joint)
            terms, runs = rows_hash(w.hash, TERM), rows_hash(w.hash, run)
            for part, memo in zip(parts, memos):
                for d, x, h in part.search(w, terms, runs, memo):
                    found.setdefault((d, int(part.ids[x])), set()).add(h)
        rows = sorted(found)
        cols = [b.column(0).take(pa.array([d for d, _ in rows], pa.int64())), pa.array([i for _, i in rows], pa.int64()), pa.array([len(found[r]) for r in rows], pa.int64())]
        if answers:
            said = {d: set() for d, _ in rows}
            for d in said:
                for p in pieces([cutter.ready(b.column(1)[d].as_py())], cutter.joint, longest):
                    w = Words(p, cutter.joint)
                    for a in replies:
                        said[d] |= a.standing_in(w)
            cols.append(pa.array([i in said[d] for d, i in rows], pa.bool_()))
        yield pa.RecordBatch.from_arrays(cols, ["d", "i", "n_runs", *(["answer_found"] if answers else [])])
