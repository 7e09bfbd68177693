"""Whole texts cut into the matches of the byte-level BPE pattern, each distinct match encoded once.

The pattern splits a text before any merge, so equal matches have equal ids everywhere. Cuts are found
on arrays of code points, at most about `CHUNK_BYTES` of a text at a time; a worker keeps the ids of the matches it has met, by 64-bit hash, in flat
arrays of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from batchloom.llm.words import _BASES, _STEP, _Polynomial, flat, mix

CHUNK_BYTES = 1 << 20
KNOWN = 1_000_000
OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)
# fixed values: the code points with the property White_Space, without the space itself
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# fixed values: what may follow an apostrophe and end a match with it
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _kinds() -> np.ndarray:
    kinds = np.zeros(0x110000, dtype=np.uint8)
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for found in regex.finditer(pattern, text):
            kinds[points[found.start() : found.end()]] = kind
    kinds[list(WHITE_SPACE)] = WHITE
    kinds[0x20] = SPACE
    return kinds


_ASCII_WHITE = np.zeros(256, dtype=bool)
_ASCII_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_KINDS: list[np.ndarray] = []
_VALUES: list[np.ndarray] = []
_POINTS = _Polynomial(_BASES[1])


def code_points(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, its code points, and where each text begins; null is empty."""
    data, offsets = flat(texts)
    joined = data.tobytes().decode("utf-8")
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    heads = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return joined, points, heads[offsets]


def cuts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches begin, in all texts; they leave no gaps."""
    if not _KINDS:
        _KINDS.append(_kinds())
    n = len(points)
    kind = _KINDS[0][points]
    white = kind >= WHITE
    starts = np.zeros(n + 1, dtype=bool)
    starts[first] = True
    before_white = np.ones(n, dtype=bool)  # is white space above, in the same text
    before_white[1:] = white[:-1]
    before_white[first[first < n]] = False
    after_solid = np.zeros(n, dtype=bool)  # does the same text go on with something else
    after_solid[:-1] = ~white[1:]
    ends = first[first > 0] - 1
    after_solid[ends] = False
    previous = np.full(n, 255, dtype=np.uint8)
    previous[1:] = kind[:-1]
    opens = np.where(
        white, ~before_white | after_solid, np.where(before_white, previous == WHITE, kind != previous)
    )
    starts[:n] |= opens
    last = np.zeros(n + 1, dtype=bool)
    last[first] = True
    for at in np.flatnonzero(starts[:n] & (points == 0x27)):
        # an apostrophe that begins a match takes the rest of a contraction with it
        for tail in CONTRACTIONS:
            stop = at + 1 + len(tail)
            if stop <= n and points[at + 1 : stop].tolist() == [ord(c) for c in tail]:
                if not last[at + 1 : stop].any():
                    starts[at + 1 : stop] = False
                    starts[stop] = True
                    break
    return np.flatnonzero(starts[:n])


def sections(data: np.ndarray, size: int):
    """Byte ranges of a text of about `size`, each but the first from white space after something else on.

    A match begins there, whatever is around it, so the sections of a text have the matches of the text. A
    stretch without such a place stays whole.
    """
    begin = 0
    while begin < len(data):
        end = begin + size
        found = np.zeros(0, dtype=np.int64)
        at = begin + 1
        while at < len(data) and not len(found):
            part = data[at - 1 : end]
            white = _ASCII_WHITE[part]
            found = np.flatnonzero(white[1:] & ~white[:-1] & (part[:-1] < 0x80))
            found, at, end = found + at, max(end, at + 1), end + size
        stop = int(found[-1]) if len(found) and len(data) - begin > size else len(data)
        yield begin, stop
        begin = stop


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], .., start[0]+size[0]-1, start[1], .. in one array."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)


class Encoder:
    """Ids of whole texts. `encode(list of matches)` gives all their ids and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (and the last one's end)."""
        data, offsets = flat(texts)
        if len(data) <= 2 * CHUNK_BYTES:
            return self._short(texts)
        ids, sizes = [np.zeros(0, dtype=np.int32)], []
        for begin, end in zip(offsets, offsets[1:]):
            text, before = data[begin:end], len(ids)
            for a, b in sections(text, CHUNK_BYTES):
                ids.append(self._short(pa.array([text[a:b].tobytes()], pa.binary()).cast(pa.string()))[0])
            sizes.append(sum(map(len, ids[before:])))
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def _short(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        joined, points, first = code_points(texts)
        begin = cuts(points, first)
        end = np.append(begin[1:], len(points))
        hashes = self._hashes(points, begin, end)
        codes, distinct = pd.factorize(hashes)
        at = np.full(len(distinct), -1, dtype=np.int64)
        at[codes[::-1]] = np.arange(len(codes))[::-1]
        rows = self._rows(distinct, joined, begin[at], end[at])
        size = self.size[rows][codes]
        sums = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[spread(self.start[rows][codes], size)]
        return ids, sums[np.searchsorted(begin, first)]

    def _hashes(self, points, begin, end):
        n = len(points)
        _POINTS.reach(n + 1)
        if not _VALUES:
            _VALUES.append(mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(_STEP)))
        values = _VALUES[0][points]
        values *= _POINTS.up[:n]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        return mix((sums[end] - sums[begin]) * _POINTS.down[begin] + (end - begin).astype(np.uint64))

    def _rows(self, hashes, joined, begin, end):
        """Rows of the table of known matches; new ones are encoded first."""
        if len(self.known) + len(hashes) > KNOWN:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        fresh = np.flatnonzero(new)
        if len(fresh):
            fresh = fresh[np.argsort(hashes[fresh])]
            matches = [joined[b:e] for b, e in zip(begin[fresh].tolist(), end[fresh].tolist())]
            ids, size = self.encode(matches)
            where = np.searchsorted(self.known, hashes[fresh])
            self.known = np.insert(self.known, where, hashes[fresh])
            self.start = np.insert(self.start, where, len(self.ids) + np.cumsum(size) - size)
            self.size = np.insert(self.size, where, size)
            self.ids = np.concatenate((self.ids, ids))
            at = np.searchsorted(self.known, hashes)
        return at
