"""Pages made by hand of each kind, and what must not be taken for them, inside a corpus of ordinary texts."""

import time
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.stuffing import calibrated, counts, function_words, shares, stuffed_pages, text_measures, word_frequencies
from tidemark.llm.wordcut import pieces, prefix, span_hash, spans

PROSE = "When the cache is full, we drop the oldest entry and read the page again. It is a rule that every reader of this file knows.\n"
NOUNS = "table river window engine letter garden market signal copper winter forest bridge paper silver harbor planet".split()
SPAM = {
    "commas": "# best shoes\n\n" + "cheap shoes, best boots, buy shoes, cheap shoes, online boots, " * 12,
    "slashes": "\n".join("shoes / SKU812 / Red / best boots / SKU99 / wide" for _ in range(9)),
    "arrows": "\n".join("boots » narrow » cheap boots » Velo » SKU1" for _ in range(9)),
    "queries": "\n".join(f"cheap boots Velo {2010 + i}\nbest shoes near me" for i in range(9)),
    "labels": " ".join(f"#boots{i} #cheap_shoes" for i in range(40)),
    "mentions": " ".join(f"@boots{i}" for i in range(40)),
    "tags": " ".join(f"tag:boots{i}" for i in range(40)),
    "links": "Welcome to shoes.\n\n" + "\n".join(f"- [shoes {i}](https://a.example/some/where/{i})" for i in range(20)),
    "bare": "\n".join(f"https://a.example/x/{i}" for i in range(20)),
    "seven bare": "\n".join(f"https://a.example/x/{i}" for i in range(7)),
    "html": "<html><body>" + " | ".join(f'<a href="https://a.example/{i}">boots</a>' for i in range(20)) + "</body></html>",
    "long addresses": "<html><body>" + " | ".join(f'<a href="https://a.example/{"q" * 5000}{i}">boots</a>' for i in range(20)) + "</body></html>",
    "long anchors": " ".join(f'<a href="https://a.example/{i}">{"cheap boots " * 300}</a>' for i in range(5)),
    "meta": '<html><head><meta name="keywords" content="' + ",".join(["boots", "cheap shoes"] * 20) + '"></head><body><div>' + "boots cheap shoes " * 20 + "</div></body></html>",
    "comment": "/*\n" + " * cheap boots buy shoes best boots online shoes sale boots\n" * 12 + " */\nvar a = 1;\n",
    "repeated lines with full stops": "cheap shoes buy online discount nike adidas puma.\n" * 30,
    "function words between keywords": "cheap shoes for the man and boots for the man\n" * 30,
}
FINE = {
    "prose": PROSE + "The garden lies behind the house, and it is open to every visitor who comes before noon.\n",
    "german": "Der alte Garten liegt hinter dem Haus und ist jeden Morgen offen\nWer früh kommt, findet dort meist noch Ruhe\nAm Abend sitzen die Nachbarn auf den Bänken\nDann erzählen sie von früher und lachen viel\n",
    "russian": "Старый сад лежит за домом и открыт каждое утро\nКто приходит рано, находит там тишину\nВечером соседи сидят на скамейках\nОни рассказывают о прошлом и много смеются\n",
    "chinese": "老花园在房子后面，每天早上都开放。来得早的人可以在那里找到安静。晚上邻居们坐在长椅上，讲过去的故事，笑得很开心。\n",
    "described links": "\n".join(f"- [a{i}](https://a.example/{i}) When the {a} is full, we drop the {b} and read a {c} of this {d} again." for i, (a, b, c, d) in enumerate(zip(NOUNS, NOUNS[3:], NOUNS[5:], NOUNS[7:]))),
    "csv": "id,name,kind,n\n" + "\n".join(f"{i},strip,remote,{i * 7}" for i in range(30)),
    "link csv": "id,address,hits\n" + "\n".join(f"{i},https://a.example/{i},{i * 7}" for i in range(30)),
    "json": '{\n  "name": "x",\n  "keywords": ["cheap", "boots", "shoes"],\n  "deep": {"a": 1}\n}\n' * 3,
    "yaml": "name: boots\nkind: shoes\nsize: 12\n" * 9,
    "code": "def f(a):\n    b = a.c(1)\n    return b[0]\n" * 9,
    "words in code": "WORDS = [\n" + '    "boots", "shoes", "cheap", "best",\n' * 20 + "]\n",
    "bytes": "static const x[] = {\n" + "  0xfd, 0x47, 0xbd, 0x5e, 0x0d, 0x23,\n" * 30 + "};\n",
    "url list in code": "URLS = [\n" + "".join(f'    "https://a.example/{i}",\n' for i in range(30)) + "]\n",
    "lock": "\n".join(f"boots=={i}.2.1" for i in range(30)),
    "a few words": "# to do\n",
    "one word": "x",
    "blank": " \n\t\n",
}


def corpus(n=60):
    """Ordinary texts: sentences with the function words of PROSE and changing nouns."""
    rng = np.random.default_rng(5)
    return ["".join(f"When the {a} is full, we drop the {b} and read a {c} again. It is a rule of this {d}.\n" for a, b, c, d in rng.choice(NOUNS, (6, 4))) for _ in range(n)]


def judged(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id string, text string, language string")
    known = function_words(word_frequencies(docs, "text", "language"))
    m = text_measures(docs, "doc_id", "text", "language", known).cache()
    return sorted(r.doc_id for r in stuffed_pages(m, calibrated(m)).collect()), known


@pytest.mark.parametrize("lang", ["markdown", "Text", None])
def test_spam_among_ordinary_texts(spark, lang):
    rows = [(f"o{i}", t, lang) for i, t in enumerate(corpus())] + [(k, t, lang) for k, t in [*SPAM.items(), *FINE.items(), ("null", None), ("empty", "")]]
    found, known = judged(spark, rows)
    assert found == sorted(SPAM)
    assert len(known) == 1 and 5 <= len(next(iter(known.values()))) < 30  # the, is, we, a, it, ...


def test_each_language_has_its_own_function_words(spark):
    german = [t.replace("the", "der").replace(" is ", " ist ").replace(" we ", " wir ").replace(" a ", " ein ") for t in corpus(300)]
    rows = [(f"e{i}", t, "en") for i, t in enumerate(corpus(300))] + [(f"d{i}", t, "de") for i, t in enumerate(german)] + [("spam", SPAM["comment"], "de"), ("fine", german[0], "de")]
    found, known = judged(spark, rows)
    assert found == ["spam"] and set(known["en"]) != set(known["de"])


def test_repeated_documents_are_judged_each_and_nothing_gives_nothing(spark):
    found, _ = judged(spark, [("1", SPAM["bare"], "x")] * 3)
    assert found == ["1"] * 3
    assert judged(spark, [("1", None, None)]) == ([], {"": []})
    docs = spark.createDataFrame([], "doc_id string, text string, language string")
    m = text_measures(docs, "doc_id", "text", "language", function_words(word_frequencies(docs, "text", "language")))
    assert stuffed_pages(m, calibrated(m)).count() == 0


@pytest.mark.parametrize("text", [" " * 300_000 + "x", "<a " * 60_000, "[" * 200_000, "](" * 100_000, "](" + "a" * 300_000, "/" * 200_000, "<meta name=" * 20_000, "a" * 500_000, "- " * 100_000, "a,b " * 100_000, "\x01" * 1001])
def test_long_and_odd_texts_take_linear_time(text):
    began = time.time()
    shares(counts([text], [np.zeros(0, np.uint64)]))
    assert time.time() - began < 5


def words_of(text):
    return "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()


@pytest.mark.parametrize("chunk", [64, 1000, 1 << 20])
def test_pieces_keep_words_whole_and_overlap(chunk):
    joint = np.zeros(256, bool)
    joint[list(b"abcdefghijklmnopqrstuvwxyz")] = True
    texts = [b"one two", None, b"", b"three", b"ab cd ef gh " * 50 + b"x" * 300 + b" end", b"last"]
    got = {}
    for p in pieces(texts, joint, 2, chunk):
        s, e = spans(joint[p.data])
        for a, b, d in zip(s, e, p.doc_of(s)):
            got.setdefault(int(d), []).append(p.data[a:b].tobytes())
    for d, t in enumerate(texts):
        if t:
            want, have = t.split(), got[d]
            if chunk > len(t):
                assert have == want
            else:
                at = 0  # an overlap repeats words, but every run of three stands in some piece
                assert set(zip(want, want[1:], want[2:])) <= set(zip(have, have[1:], have[2:])) and len(have) >= len(want), at


def test_equal_words_have_equal_hashes():
    data = np.frombuffer(b"ab abc ab c abc a b", np.uint8)
    s, e = spans(data != 32)
    h = span_hash(prefix(data), s, e)
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 5


def test_counts_equal_plain_counting_whatever_the_pieces(monkeypatch):
    import tidemark.llm.stuffing as st

    texts = [*SPAM.values(), *corpus(3), "word " * 3000]
    none = [np.zeros(0, np.uint64)] * len(texts)
    whole = counts(texts, none, markup=False)
    for i, t in enumerate(texts):
        w = words_of("".join(c if c.isascii() else "x" for c in t.lower()))
        assert whole["n_words"][i] == len(w) and whole["top"][i] == max(Counter(w).values())
        assert whole["top_pair"][i] == max(Counter(zip(w, w[1:])).values(), default=0)
    monkeypatch.setattr(st, "pieces", lambda t, j, **k: pieces(t, j, 0, 2000))
    small = counts(texts, none, markup=False)
    for c in ("n_words", "top", "visible"):
        assert (whole[c] == small[c]).all()
