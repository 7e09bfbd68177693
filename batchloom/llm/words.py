"""Words of whole texts and their hashes, vectorised over Arrow batches.

A word is a longest run of bytes outside a set of ASCII separators. Hashes are 64 bits wide and
depend on the bytes of a word only (A-Z and a-z alike if `fold`), never on the process, the batch
or the partition: a polynomial over random byte values, then a finaliser. All work is done
on slices of bounded size; what is kept for a text is a few numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
CHUNK_BYTES = 1 << 23
_STEP = 0x9E3779B97F4A7C15
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)


def separators(codes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(codes)] = True
    return table


SPACES = separators([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = separators(c for c in range(128) if not chr(c).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Polynomial:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)


_BYTES, _WORDS = _Polynomial(_BASES[0]), _Polynomial(_BASES[1])


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
    if fold:
        values[65:91] = values[97:123]
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins and ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in pieces of at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Words:
    """Words of a few texts: `hash`, byte range `start`..`end`, and `first[i]`..`first[i+1]` of text i."""

    def __init__(self, texts: pa.Array, fold: bool = False, seps: np.ndarray = SPACES):
        data, offsets = flat(texts)
        self.data, self.offsets = data, offsets
        parts = []
        begin = 0
        while begin < len(data):
            end = min(len(data), begin + SLICE_BYTES)
            if end < len(data):
                # a slice ends behind a separator, so that no word is cut
                found, at = np.zeros(0, dtype=np.int64), begin
                while not len(found) and end < len(data):
                    found = np.flatnonzero(seps[data[at:end]])
                    if not len(found):
                        at, end = end, min(len(data), end + SLICE_BYTES)
                if len(found):
                    end = at + int(found[-1]) + 1
            parts.append(self._slice(begin, end, fold, seps))
            begin = end
        join = lambda i, kind: (
            np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=kind)
        )
        self.start, self.end = join(0, np.int64), join(1, np.int64)
        self.hash = join(2, np.uint64)
        self.first = np.searchsorted(self.start, offsets)

    def _slice(self, begin, end, fold, seps):
        part = self.data[begin:end]
        n = len(part)
        _BYTES.reach(n + 1)
        inside = ~seps[part]
        lo, hi = np.searchsorted(self.offsets, (begin, end))
        cuts = self.offsets[lo:hi] - begin
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[cuts] = inside[cuts]
        closes = np.zeros(n + 1, dtype=bool)
        closes[1:n] = inside[:-1] & ~inside[1:]
        closes[n] = inside[-1]
        inner = cuts[cuts > 0]
        closes[inner] = inside[inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
        values = _VALUES[fold][part]
        values *= _BYTES.up[:n]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _BYTES.down[starts]
        hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(_STEP))
        return starts + begin, ends + begin, hashes

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def sums(self) -> np.ndarray:
        """Rolling sums: the hash of words i..j is read off two of them."""
        n = len(self.hash)
        _WORDS.reach(n + 1)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * _WORDS.up[:n], out=out[1:])
        return out

    def spans(self, begin: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the word sequences begin..end."""
        sums = self.sums() if sums is None else sums
        raw = (sums[end] - sums[begin]) * _WORDS.down[begin]
        return mix(raw + (end - begin).astype(np.uint64) * np.uint64(_STEP))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of `size` words that lie in one text."""
        room = np.maximum(self.counts() - size + 1, 0)
        begin = np.repeat(self.first[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
        return begin, self.spans(begin, begin + size)
