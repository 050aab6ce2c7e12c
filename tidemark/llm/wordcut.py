"""Words of many texts at once: numpy arrays over their UTF-8 bytes.

A text becomes bytes, a table says which bytes belong to words, and every word gets a 64-bit hash from two prefix arrays,
so that no step runs word by word in Python. Texts are handled together in chunks, a long one in several pieces, so memory
is bounded by ``CHUNK`` and the longest single word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

CHUNK = 1 << 20  # bytes of a chunk
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    if len(_powers.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK) + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    up, _ = _tables(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end): equal spans have equal hashes wherever they stand."""
    _, down = _tables(len(sums) - 1)
    return mixed((sums[end] - sums[start]) * down[start])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


class Piece(NamedTuple):
    """Bytes of several texts, or of a part of one: ``doc`` and ``at`` (its first byte) per text; every text ends with a newline."""

    data: np.ndarray
    doc: np.ndarray
    at: np.ndarray

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        if len(self.doc) == 1:
            return np.full(len(positions), self.doc[0])
        return np.repeat(self.doc, np.diff(np.append(self.at, len(self.data))))[positions]


def pieces(texts: Iterable[bytes | None], joint: np.ndarray, overlap: int = 0, chunk: int = CHUNK) -> Iterator[Piece]:
    """The texts as pieces of about ``chunk`` bytes. A longer text is cut where a word ends (``joint``: the bytes of words), a piece repeating the last ``overlap`` words of the one before."""
    data: list[bytes] = []
    docs: list[int] = []
    sizes: list[int] = []
    held = 0

    def flush() -> Iterator[Piece]:
        if data:
            yield Piece(np.frombuffer(b"".join(data), np.uint8), np.array(docs), np.cumsum([0, *sizes[:-1]]))
            data.clear(), docs.clear(), sizes.clear()

    for d, text in enumerate(texts):
        if not text:
            continue
        if len(text) >= chunk:
            yield from flush()
            held = 0
            yield from (Piece(p, np.array([d]), np.array([0])) for p in _long(text, joint, overlap, chunk))
            continue
        data.append(text + b"\n")
        docs.append(d)
        sizes.append(len(text) + 1)
        held += len(text) + 1
        if held >= chunk:
            yield from flush()
            held = 0
    yield from flush()


def _long(text: bytes, joint: np.ndarray, overlap: int, chunk: int) -> Iterator[np.ndarray]:
    whole = np.frombuffer(text, np.uint8)
    at, end = 0, 0
    while end < len(whole):
        end = min(end + chunk, len(whole))
        while end < len(whole):  # on to the end of the word
            rest = np.flatnonzero(~joint[whole[end : end + chunk]])
            end += int(rest[0]) + 1 if len(rest) else len(whole[end : end + chunk])
            if len(rest):
                break
        yield np.append(whole[at:end], np.uint8(10))
        if overlap:
            back = chunk // 16
            while True:  # far enough back for the last words of this piece
                low = max(at, end - back)
                start, _ = spans(joint[whole[low:end]])
                if len(start) > overlap or low == at:
                    break
                back *= 2
            at = low + int(start[-overlap]) if len(start) >= overlap else low
        else:
            at = end
