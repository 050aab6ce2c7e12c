"""Keyword-stuffed and link-list pages, by shares that are measured on every text and bounded per language.

A text's links are taken out and measured, mark-up and signs before the first word of a line are left aside. What remains is
described by shares: the most frequent word and word pair, repeated words and lines, separators between short phrases,
structural signs (those of code and data) and function words. Nothing is listed by hand: function words are the words that stand in most
texts of a language, and the bounds are tails of the language's ordinary texts. A page is spam if links make it up, or if
function words are missing, structure is missing too and one of the repetition or separator shares is beyond its bound.

Two passes over the texts: one counts in how many texts of its language each word stands, one measures. Neither moves a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import ship
from .wordcut import Piece, mixed, pieces, prefix, span_hash, spans

# Every pattern takes linear time without a longest length: what it may skip never contains its own first character.
_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>")
_BLOCK = re.compile(r"</?(?:br|p|li|div|ul|ol|h[1-6]|tr|td|th|table|body|head|html|title)\b", re.I)
_CONTENT = re.compile(r"""\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)
_MD_LINK = re.compile(r"!?\[[^\[\]\n]*\]\([^()\n]*\)")
_URL = re.compile(r"""(?:\b(?:https?|ftp)://|\bwww\.)[^\s<>"'()\[\]|,]+""", re.I)
_STOP = re.compile("[。！？，、；：]")
_SIGN = re.compile(r"[^\w\s\x00-\x7f]")
LINK = "\x01"
WINDOW = 256  # words within which repeated words are counted, so that the share doesn't grow with a text's length
PRIOR = 200  # texts of the whole corpus that a language's own figures are blended with


def _bytes(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode("latin-1"))] = True
    return t


WORD = _bytes("abcdefghijklmnopqrstuvwxyz0123456789_")
WORD[0x80:] = True
BETWEEN = _bytes(",;/|>-")  # between phrases, where a blank follows
STRUCTURE = _bytes("{}()[]<>=;:\"'`$%&+^~?!\\.*#@,/|")
UNIT = WORD.copy()
UNIT[1] = True  # a link


def unlinked(text: str) -> tuple[str, int, int]:
    """The text with a mark in place of each link and without mark-up, the characters of links and anchors, and their number. Keywords of a page's head are text."""
    chars = links = 0
    text = text.replace(LINK, " ")

    def take(m: re.Match) -> str:
        nonlocal chars, links
        chars += len(m.group(0))
        links += 1
        return f" {LINK} "

    if "<" in text:
        out: list[str] = []
        at, anchor = 0, None
        for m in _TAG.finditer(text):
            tag = m.group(0).lower()
            if tag.startswith("</a") and not tag[3].isalnum():
                if anchor is not None:
                    chars, links, anchor = chars + m.end() - anchor, links + 1, None
                    out.append(f" {LINK} ")
                    at = m.end()
            elif anchor is None:
                out.append(text[at : m.start()])
                at = m.end()
                if tag.startswith("<a") and not tag[2].isalnum():
                    anchor = m.start()
                elif tag.startswith("<meta") and ("keywords" in tag or "description" in tag) and (c := _CONTENT.search(m.group(0))):
                    out.append("\n" + (c.group(1) or c.group(2) or "").replace(",", ", ") + "\n")
                else:
                    out.append("\n" if _BLOCK.match(tag) else " ")
        text = "".join([*out, text[at:]])
    if "](" in text:
        text = _MD_LINK.sub(take, text)
    if "://" in text or "www." in text or "WWW." in text:
        text = _URL.sub(take, text)
    return text, chars, links


def _ready(text: str | None, markup: bool) -> tuple[bytes | None, int, int]:
    if not text:
        return None, 0, 0
    chars = links = 0
    if markup:
        text, chars, links = unlinked(text)
        if not text.isascii():
            text = _SIGN.sub("|", _STOP.sub("\n", text))
    return text.lower().encode("utf-8", "replace"), chars, links


class Words:
    """The words of a piece: start, hash, text number, and whether they begin with a digit."""

    def __init__(self, p: Piece):
        self.start, end = spans(WORD[p.data])
        self.sums = prefix(p.data)
        self.hash = span_hash(self.sums, self.start, end)
        self.doc = p.doc_of(self.start)
        first = p.data[self.start]
        self.number = (first >= 48) & (first <= 57)


def _runs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, key and count of every distinct (text, key); keys are cut to 44 bits to be sorted with the text number as one integer."""
    both = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
    return (both[at] >> np.uint64(44)).astype(np.int64), both[at] << np.uint64(20), np.diff(np.append(at, len(both)))


COUNTS = ("n_words", "visible", "separators", "structure", "function", "content", "repeats", "lines", "same_lines", "pairs")


def counts(texts: list[str | None], function: list[np.ndarray], markup: bool = True) -> dict[str, np.ndarray]:
    """What the shares are made of, per text. function: the sorted hashes of the function words of each text's language.

    A text longer than a piece is counted piece by piece; only its most frequent words and pairs need all pieces at once.
    """
    n = len(texts)
    out = {c: np.zeros(n) for c in (*COUNTS, "top", "top_pair", "link_chars", "links")}
    ready: list[bytes | None] = []
    for i, t in enumerate(texts):
        b, out["link_chars"][i], out["links"][i] = _ready(t, markup)
        ready.append(b)
    whole: dict[int, list] = {}  # of texts in several pieces: words, pairs, lines seen so far

    def add(name: str, doc: np.ndarray, weight: np.ndarray | None = None) -> None:
        out[name] += np.bincount(doc, weight, n)

    def most(name: str, doc: np.ndarray, key: np.ndarray) -> None:
        d, k, c = _runs(doc, key)
        if len(d) and d[0] in whole:
            seen = whole[int(d[0])].setdefault(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            k, inverse = np.unique(np.concatenate([seen[0], k]), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([seen[1], c])).astype(np.int64)
            whole[int(d[0])][name] = (k, c)
            d = np.full(len(k), d[0])
        if len(d):
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            out[name][d[at]] = np.maximum(out[name][d[at]], np.maximum.reduceat(c, at))

    last = -1
    for p in pieces(ready, WORD):
        if len(p.doc) == 1 and len(p.data) != len(ready[p.doc[0]]) + 1:
            whole.setdefault(int(p.doc[0]), {})
        data, w = p.data, Words(p)
        add("n_words", w.doc)
        out["visible"][p.doc] += np.add.reduceat(data > 32, p.at, dtype=np.int64)
        # signs after the first word or link of their line
        newline = data == 10
        line = np.cumsum(newline) - newline
        units, _ = spans(UNIT[data])
        first = np.full(int(line[-1]) + 1, len(data))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(line[units]) > 0])) if len(units) else np.zeros(0, int)
        first[line[units[starts]]] = units[starts]
        sign = np.flatnonzero(BETWEEN[data] | STRUCTURE[data])
        sign = sign[sign > first[line[sign]]]
        after, before = data[np.minimum(sign + 1, len(data) - 1)], data[sign - 1]
        left = np.searchsorted(w.start, sign, "right") - 1
        numeric = w.number[left] & (left >= 0) & (line[w.start[left]] == line[sign]) if len(w.start) else np.zeros(len(sign), bool)
        label = (((data[sign] == 35) | (data[sign] == 64)) & (before == 32) | (data[sign] == 58) & WORD[before]) & WORD[after] & ~((after >= 48) & (after <= 57))
        loose = BETWEEN[data[sign]] & (after == 32) & ~numeric | label
        add("separators", p.doc_of(sign[loose]))
        add("structure", p.doc_of(sign[~loose]))
        add("structure", w.doc[w.number])
        head = first[(first < len(data)) & (first > 0)]
        add("separators", p.doc_of(head[(data[head - 1] == 35) | (data[head - 1] == 64)]))  # a label at the start of its line
        # words and pairs
        known = np.zeros(len(w.hash), bool)
        same = np.concatenate([[True], function_change(w.doc, function)]) if len(w.doc) else np.zeros(0, bool)
        cuts = np.append(np.flatnonzero(same), len(w.doc))
        for a, b in zip(cuts[:-1], cuts[1:]):
            f = function[w.doc[a]]
            if len(f):
                cut = w.hash[a:b] >> np.uint64(20) << np.uint64(20)  # as in word_frequencies
                known[a:b] = f[np.minimum(np.searchsorted(f, cut), len(f) - 1)] == cut
        add("function", w.doc[known])
        plain_doc, plain = w.doc[~known], w.hash[~known]
        add("content", plain_doc)
        if len(plain):
            at = np.flatnonzero(np.concatenate([[True], plain_doc[1:] != plain_doc[:-1]]))
            place = np.arange(len(plain)) - np.repeat(at, np.diff(np.append(at, len(plain))))
            d, _, c = _runs(plain_doc, mixed(plain + (place // WINDOW).astype(np.uint64)))
            add("repeats", d, c - 1)
        most("top", w.doc, w.hash)
        joined = w.doc[1:] == w.doc[:-1]
        most("top_pair", w.doc[1:][joined], mixed(w.hash[:-1] * np.uint64(3) + w.hash[1:])[joined])
        add("pairs", w.doc[1:][joined])
        # lines, from their first word on
        full = first < len(data)
        ends = np.flatnonzero(newline)
        d, _, c = _runs(p.doc_of(first[full]), span_hash(w.sums, first[full], ends[full]))
        add("lines", d, c)
        add("same_lines", d, c - 1)
    return out


def function_change(doc: np.ndarray, function: list[np.ndarray]) -> np.ndarray:
    """Where the next word has another list of function words."""
    key = np.array([id(f) for f in function])[doc]
    return key[1:] != key[:-1]


MEASURES = ("links", "top_word", "top_pair", "repeated", "same_lines", "separators", "structure", "function")
EVIDENCE = {"top_word": 0.12, "top_pair": 0.08, "repeated": 0.5, "same_lines": 0.3, "separators": 0.25}  # and the least value that counts


def shares(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The measures, all 0 for an empty text. A word or pair counts as frequent from its second occurrence on, so few words repeat nothing."""
    n, units = np.maximum(c["n_words"], 1), np.maximum(c["n_words"] + c["links"], 1)
    return {
        "links": c["link_chars"] / np.maximum(c["link_chars"] + c["visible"] - c["links"], 1),
        "top_word": np.maximum(c["top"] - 1, 0) / n, "top_pair": 2 * np.maximum(c["top_pair"] - 1, 0) / n,
        "repeated": c["repeats"] / np.maximum(c["content"], 1), "same_lines": c["same_lines"] / np.maximum(c["lines"], 1),
        "separators": c["separators"] / units, "structure": c["structure"] / units, "function": c["function"] / n,
    }


def _language(lang: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(lang).cast("string"), F.lit("")))).alias("language")


def word_frequencies(docs: DataFrame, text: str, lang: str, markup: bool = True) -> DataFrame:
    """language, word (hash), n_docs: in how many texts of the language the word stands; the word NULL has the number of texts. Numbers aren't words here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, number = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            ready = [_ready(v.as_py(), markup)[0] for v in b.column(1)]
            found = [np.zeros((0, 2), np.uint64)]
            for p in pieces(ready, WORD):
                w = Words(p)
                d, k, _ = _runs(w.doc[~w.number], w.hash[~w.number])
                found.append(np.stack([number[d].astype(np.uint64), k], 1))
                if len(p.doc) == 1:  # the pieces of one text count it once
                    found[-1] = np.append(found[-1], np.full((len(d), 1), p.doc[0], np.uint64), 1)
            once = [x for x in found if x.shape[1] == 3]
            rest = [x for x in found if x.shape[1] == 2] + ([np.unique(np.concatenate(once), axis=0)[:, :2]] if once else [])
            every = np.concatenate(rest)
            order = np.lexsort((every[:, 1], every[:, 0]))
            every = every[order]
            at = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]).any(1)])) if len(every) else np.zeros(0, int)
            times = np.diff(np.append(at, len(every)))
            lang_no = np.concatenate([every[at, 0].astype(np.int64), np.arange(len(names))])
            word = pa.array(np.concatenate([every[at, 1].view(np.int64), np.zeros(len(names), np.int64)]), mask=np.arange(len(lang_no)) >= len(at))
            n = np.concatenate([times, np.bincount(number, minlength=len(names))])
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(lang_no)), word, pa.array(n.astype(np.int64))], ["language", "word", "n"])

    ship(docs.sparkSession)
    parts = docs.select(_language(lang), F.col(text).alias("text")).mapInArrow(run, "language string, word bigint, n bigint")
    return parts.groupBy("language", "word").agg(F.sum("n").alias("n_docs"))


def function_words(frequencies: DataFrame, share: float = 0.5, least_share: float = 1e-4) -> dict[str, list[int]]:
    """Per language the words that stand in at least ``share`` of its texts, blended with ``PRIOR`` texts of the whole corpus, and those that stand in ``share`` of all texts.

    A language with less than ``least_share`` of all texts isn't listed: at most 1 / least_share languages are, each with at most mean words of a text / share.
    """
    total = frequencies.where("word IS NULL").agg(F.sum("n_docs")).first()[0] or 0
    sizes = frequencies.where("word IS NULL").select("language", F.col("n_docs").alias("n")).where(F.col("n") >= least_share * total)
    every = frequencies.where("word IS NOT NULL").groupBy("word").agg((F.sum("n_docs") / max(total, 1)).alias("p"))
    # a blended share of at least ``share`` needs one of the two shares to reach it; most words are gone before the join
    own = frequencies.where("word IS NOT NULL").join(F.broadcast(sizes), "language").where((F.col("n_docs") + PRIOR) / (F.col("n") + PRIOR) >= share)
    found = own.join(every, "word").where((F.col("n_docs") + PRIOR * F.col("p")) / (F.col("n") + PRIOR) >= share)
    common = {x["word"] for x in every.where(F.col("p") >= share).collect()}
    out: dict[str, set[int]] = {x["language"]: set(common) for x in sizes.select("language").collect()}
    for x in found.select("language", "word").collect():
        out[x["language"]].add(x["word"])
    return {k: sorted(v) for k, v in out.items()}


def text_measures(docs: DataFrame, doc_id: str, text: str, lang: str, function: dict[str, list[int]] | None = None, markup: bool = True) -> DataFrame:
    """doc_id, ``language`` (lower case; '' for NULL and for languages not in ``function``), the measures and ``n_words`` of whole texts.

    function: as of ``function_words``; without it no word is one. markup: take out links and mark-up first; else texts are measured as they stand.
    """
    spark = docs.sparkSession
    lists = {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in (function or {}).items()}
    shared = spark.sparkContext.broadcast(lists)
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        for b in batches:
            at = 0
            while at < b.num_rows:  # so many rows at once as fill a few pieces
                part = b.slice(at, 1024)
                at += part.num_rows
                known = [k if k in lists else "" for k in part.column(1).to_pylist()]
                c = counts(part.column(2).to_pylist(), [lists.get(k, none) for k in known], markup)
                s = shares(c)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(known, pa.string()), *[pa.array(s[m]) for m in MEASURES], pa.array(c["n_words"].astype(np.int64))], ["doc_id", "language", *MEASURES, "n_words"]
                )

    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), _language(lang), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, language string, {', '.join(f'{m} double' for m in MEASURES)}, n_words bigint")


def calibrated(measures: DataFrame, missing: float = 0.25, tail: float = 0.95) -> DataFrame:
    """Per language: ``max_function``, below which function words are missing, and ``b_*``, the bound of each evidence.

    max_function: ``missing`` times the median share. The bounds are the ``tail`` quantile of the ordinary texts, those whose function words aren't missing (all texts
    of a language that has none). Both are blended with the whole corpus's as if by ``PRIOR`` texts, so that no language is too small to have its own.
    """
    some = measures.where("n_words > 0")

    def blended(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
        every = df.agg(*[v.alias(k) for k, v in wanted.items()]).first()  # the whole corpus's, one row
        mean = lambda k: ((F.col("n") * F.col(k) + PRIOR * F.lit(every[k])) / (F.col("n") + PRIOR)).alias(k)
        return df.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in wanted.items()]).select("language", *[mean(k) for k in wanted])

    usual = blended(some, {"max_function": F.percentile_approx("function", 0.5) * missing})
    ordinary = some.join(F.broadcast(usual), "language").where("function > max_function OR max_function = 0")
    bounds = blended(ordinary, {f"b_{m}": F.percentile_approx(m, tail) for m in EVIDENCE})
    return usual.join(F.broadcast(bounds), "language", "left")


def stuffed_pages(measures: DataFrame, bounds: DataFrame, share: float = 0.8, structure: float = 0.2) -> DataFrame:
    """doc_id and its measures, of the texts that are spam.

    A text with at most ``structure`` structural signs and numbers per word or link is spam if links make up at least ``share`` of it, or if its function
    words are missing and one of the evidences is above both its language's bound and its least value in ``EVIDENCE``, or if repeated words or lines alone reach ``share``. NULL, empty and blank texts
    never are. Rows are judged each on its own, so a repeated one comes out as often.
    measures should be a stored table. bounds has a row per language, of which ``function_words`` bounds the number.
    """
    known = measures.join(F.broadcast(bounds), "language", "left")
    evident = F.lit(False)
    for m, least in EVIDENCE.items():
        evident = evident | (F.col(m) > F.greatest(F.coalesce(F.col(f"b_{m}"), F.lit(0.0)), F.lit(least)))
    bare = F.col("function") <= F.coalesce(F.col("max_function"), F.lit(0.0))
    alone = (F.col("links") >= share) | (F.col("repeated") >= share) | (F.col("same_lines") >= share)
    return known.where((F.col("structure") <= structure) & (alone | (bare & evident))).select(*measures.columns)
