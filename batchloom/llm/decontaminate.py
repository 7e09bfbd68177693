"""Benchmark decontamination: seeds of two words, then Smith-Waterman alignment of words.

Words are runs of letters and digits (A-Z lower-cased; all bytes beyond ASCII count as letters), as
hashes. Test items are a stated query set: they are taken in blocks of a bounded number of words, and
each block is sent to all tasks and compared with all documents where these are read.

A seed is a pair of words that stand side by side or with one word between, in the item and in the
document. Past its first matching word, an alignment gains at each matching word at most MATCH less what
was left between: MATCH at a pair side by side in both, 1 at any other seed, nothing elsewhere. So a copy
with the score asked for has seeds worth at least that score less MATCH, at different places of the item, and
all within so many words of the document as the score leaves room for.

1. How many documents hold each pair of the items is counted over all documents.
2. The places of an item whose pairs most documents hold are not looked for, but only as many as are worth
   half of what a copy needs; the rest must then bring the other half. No copy is lost by this.
3. Where the seeds are worth enough, the item is aligned with the document's words. Edited, cut and
   paraphrased copies keep a score in proportion to the words that they keep.

An item of one or two words has no edited copy: half of it is a common word. It is found where it stands whole,
by the hash of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from batchloom.llm.words import NOT_ALNUM, Words, chunks, mix

SEED = 3  # words that an item has at least to be aligned; shorter ones are found as a whole
SKIPS = (1, 2)
THRESHOLD = 0.4
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
HITS = 1 << 20  # places of items looked at together, or those of one text
_FILTER_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EPS = 1e-6


class Items:
    """A block of test items: their words, and an index from pairs of words to (item, position).

    Items of `SEED` words and more come first in `ids`; `words` are theirs, `short` finds the others.
    """

    def __init__(self, ids: list, words: list[np.ndarray]):
        by_size = sorted(range(len(ids)), key=lambda i: len(words[i]) < SEED)
        self.ids = [ids[i] for i in by_size]
        self.words = [words[i] for i in by_size if len(words[i]) >= SEED]
        self.short = _Short(len(self.words), [words[i] for i in by_size[len(self.words) :]])
        words = self.words
        size = np.array([len(own) for own in words], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        begin, self.skip, grams = _pairs(np.concatenate([*words, np.zeros(0, dtype=np.uint64)]), first)
        self.item = np.searchsorted(first, begin, side="right") - 1
        self.at = begin - first[self.item]
        self.grams, self.gram_of = np.unique(grams, return_inverse=True)
        self.needed = THRESHOLD * MATCH * size - MATCH
        # a copy has the item's words and as many others as its score allows
        self.span = size + (MATCH * size * (1 - THRESHOLD) / -GAP).astype(np.int64) + 1
        self.use(np.ones(len(grams), dtype=bool))

    def use(self, chosen: np.ndarray) -> None:
        """Look for these occurrences only."""
        rows = np.flatnonzero(chosen)
        rows = rows[np.argsort(self.gram_of[rows], kind="stable")]
        self.rows = rows
        self.bounds = np.searchsorted(self.gram_of[rows], np.arange(len(self.grams) + 1))
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self._low(self.grams[self.gram_of[rows]])] = True

    @staticmethod
    def _low(hashes):
        return (hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word, distance and gram of each pair that some item has, in the order of words."""
        begin, skip, hashes = _pairs(words.hash, words.first)
        near = np.flatnonzero(self.filter[self._low(hashes)])
        if not len(near) or not len(self.grams):
            return near[:0], near[:0], near[:0], near[:0]
        gram = np.minimum(np.searchsorted(self.grams, hashes[near]), len(self.grams) - 1)
        hit = self.grams[gram] == hashes[near]
        near, gram = near[hit], gram[hit]
        order = np.argsort(begin[near], kind="stable")
        near, gram = near[order], gram[order]
        return np.searchsorted(words.first, begin[near], side="right") - 1, begin[near], skip[near], gram

    def choose_rare(self, holders: dict[int, int]) -> None:
        """Leave out the places with the most frequent pairs, up to half of what a copy needs."""
        counts = np.array([holders.get(g, 0) for g in range(len(self.grams))], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(np.array([len(own) for own in self.words], dtype=np.int64))))
        place = first[self.item] + self.at
        often = np.bincount(place, counts[self.gram_of], minlength=first[-1])
        item = np.repeat(np.arange(len(self.words)), np.diff(first))
        order = np.lexsort((-often, item))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - first[item[order]]
        spare = np.maximum(self.needed // (2 * MATCH), 0).astype(np.int64)
        self.needed = self.needed - MATCH * spare
        self.use(rank[place] >= spare[self.item])

    def hits(self, texts: pa.Array):
        """(text, item, score, first word, last word) of each aligned copy, the best per text and item."""
        words = Words(texts, fold=True, seps=NOT_ALNUM)
        yield from self.short.hits(words)
        found = self.find(words)
        text, gram = found[0], found[-1]
        if not len(text):
            return
        before = np.concatenate(([0], np.cumsum(self.bounds[gram + 1] - self.bounds[gram])))
        ends = np.concatenate((np.flatnonzero(np.diff(text)) + 1, [len(text)]))
        lo = 0
        while lo < len(text):
            within = ends[(ends > lo) & (before[ends] <= before[lo] + HITS)]
            hi = int(within[-1]) if len(within) else int(ends[np.searchsorted(ends, lo, side="right")])
            yield from self._copies(words, *(column[lo:hi] for column in found))
            lo = hi

    def _copies(self, words, text, begin, skip, gram):
        size = self.bounds[gram + 1] - self.bounds[gram]
        if not size.sum():
            return
        rows = self.rows[np.repeat(self.bounds[gram] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        text, begin, skip = (np.repeat(column, size) for column in (text, begin, skip))
        item, at = self.item[rows], self.at[rows]
        worth = np.where((skip == 1) & (self.skip[rows] == 1), MATCH, MATCH - 1)
        pair, pair_of = np.unique(text * len(self.ids) + item, return_inverse=True)
        enough = np.bincount(pair_of, worth)[pair_of] >= self.needed[item] - _EPS
        pair_of, text, begin, item, at, worth = (
            column[enough] for column in (pair_of, text, begin, item, at, worth)
        )
        # windows of two spans, one span apart: each copy lies whole in one of them
        window = (begin - words.first[text]) // self.span[item]
        both = np.concatenate((np.arange(len(item)), np.flatnonzero(window > 0)))
        window = np.concatenate((window, window[window > 0] - 1))
        pair_of, at, worth = pair_of[both], at[both], worth[both]
        order = np.lexsort((-worth, at, window, pair_of))
        pair_of, window, at, worth = pair_of[order], window[order], at[order], worth[order]
        new_window = _changes(pair_of, window)
        best = new_window | _changes(at)
        group = np.cumsum(new_window) - 1
        points = np.bincount(group[best], worth[best], minlength=int(new_window.sum()))
        pair_of, window = pair_of[new_window], window[new_window]
        text, item = pair[pair_of] // len(self.ids), pair[pair_of] % len(self.ids)
        kept = points >= self.needed[item] - _EPS
        text, item, window = text[kept], item[kept], window[kept]
        starts = np.flatnonzero(_changes(text, item)).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(text)]):
            yield from self._align(words, int(text[lo]), int(item[lo]), window[lo:hi])

    def _align(self, words, text, item, window):
        own, span = self.words[item], self.span[item]
        first, end = int(words.first[text]), int(words.first[text + 1])
        lows = first + window * span
        highs = np.minimum(lows + 2 * span, end)
        cuts = np.flatnonzero(lows[1:] > highs[:-1]) + 1
        best = None
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lows)]):
            low, high = int(lows[a]), int(highs[b - 1])
            score, last = align(own, words.hash[low:high])
            if best is None or score > best[0]:
                best = (score, low, low + last)
        score, low, last = best
        if score >= THRESHOLD * MATCH * len(own):
            _, back = align(own[::-1], words.hash[low : last + 1][::-1])
            yield text, item, score / (MATCH * len(own)), last - back - first, last - first


class _Short:
    """Items of fewer than `SEED` words, numbered from `first`, by size and hash of the whole item."""

    def __init__(self, first: int, words: list[np.ndarray]):
        self.by_size = {}
        for size in range(1, SEED):
            rows = [i for i, own in enumerate(words) if len(own) == size]
            if rows:
                hashes = _hashes(np.stack([words[i] for i in rows], axis=1))
                order = np.argsort(hashes, kind="stable")
                self.by_size[size] = hashes[order], np.array(rows)[order] + first

    def hits(self, words: Words):
        """As `Items.hits`: the first place of each item in each text."""
        for size, (hashes, items) in self.by_size.items():
            room = np.maximum(words.counts() - size + 1, 0)
            begin = np.repeat(words.first[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
            found = _hashes(words.hash[begin + k] for k in range(size))
            text = np.repeat(np.arange(len(words)), room)
            low, high = np.searchsorted(hashes, found), np.searchsorted(hashes, found, side="right")
            held = np.flatnonzero(high > low)
            _, first = np.unique(np.stack((text[held], low[held])), axis=1, return_index=True)
            for at in held[np.sort(first)].tolist():
                place = int(begin[at] - words.first[text[at]])
                for item in items[low[at] : high[at]].tolist():
                    yield int(text[at]), item, 1.0, place, place + size - 1


def _hashes(words) -> np.ndarray:
    """One hash for each sequence, from its first words, its second words and so on."""
    out = np.uint64(0)
    for part in words:
        out = mix(out * _ODD + part)
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before; the first one does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    return out


def align(own: np.ndarray, other: np.ndarray) -> tuple[int, int]:
    """The score of the best local alignment and where it ends in `other` (the earliest)."""
    above = np.zeros(len(other) + 1, dtype=np.int64)
    slope = np.arange(len(other) + 1) * -GAP
    best, last = 0, 0
    for word in own:
        row = np.zeros(len(other) + 1, dtype=np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(other == word, MATCH, MISMATCH), 0)
        row = np.maximum(row, above + GAP)
        # gaps along the row: the best of all earlier places less their distance
        row = np.maximum(np.maximum.accumulate(row + slope) - slope, 0)
        at = int(row.argmax())
        if row[at] > best or row[at] == best > 0 and at - 1 < last:
            best, last = int(row[at]), at - 1
        above = row
    return best, last


def _pairs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, distance and hash of all pairs of words of one text that are `SKIPS` apart."""
    parts = []
    for skip in SKIPS:
        room = np.maximum(np.diff(first) - skip, 0)
        begin = np.repeat(first[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
        hashes = mix(words[begin] * _ODD + words[begin + skip])
        parts.append((begin, np.full(len(begin), skip), hashes))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """The items in blocks of at most about BLOCK_WORDS words, each small enough to send around."""
    texts = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + size // (4 * BLOCK_WORDS)
    for block in range(n):
        part = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block).toArrow()
        found = [(i, t) for i, t in zip(part["id"].to_pylist(), part["text"].to_pylist()) if t]
        found.sort(key=lambda row: (str(row[0]), row[1]))
        words = Words(pa.array([t for _, t in found], pa.string()), fold=True, seps=NOT_ALNUM)
        own = [words.hash[b:e] for b, e in zip(words.first[:-1], words.first[1:])]
        filled = [i for i, w in enumerate(own) if len(w)]
        if filled:
            yield Items([found[i][0] for i in filled], [own[i] for i in filled])


def _ready(docs: DataFrame, text_col: str, items: DataFrame, id_col: str, item_text_col: str):
    """Blocks of items with their seeds chosen, as broadcast values."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    for block in _blocks(items, id_col, item_text_col):
        sent = context.broadcast(block)

        def count(batches, sent=sent):
            for part in chunks(batches, "text"):
                words = Words(part.column("text"), fold=True, seps=NOT_ALNUM)
                text, _, _, gram = sent.value.find(words)
                pairs = np.unique(np.stack((gram, text)), axis=1)
                grams, holders = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(grams), "n": pa.array(holders)})

        # one number for each sequence of the block, however many documents there are
        totals = texts.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        block.choose_rare({row["gram"]: row["n"] for row in totals.collect()})
        sent.unpersist()
        yield context.broadcast(block)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): test items that documents hold a copy of.

    The score is that of the best local alignment, as a share of the item's own: 1 is the whole item
    word for word, and `THRESHOLD` or more is a copy. Of several copies in a text the best counts, then the
    earliest; words count from 0. An item of one or two words is found where all of it stands side by side, with
    score 1. Null and empty texts hold nothing, and items that are null or without a word are in none. A row with an equal id gets rows of its own. Other columns
    are not looked at. Without items or documents the result is empty.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_kind = texts.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema[item_id_col].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, score double, first_word bigint, last_word bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    item_type = to_arrow_schema(found.schema).field("item_id").type
    for sent in _ready(docs, text_col, items, item_id_col, item_text_col):

        def search(batches, sent=sent):
            for part in chunks(batches, "text"):
                rows = list(sent.value.hits(part.column("text")))
                if rows:
                    text, item, score, first, last = zip(*rows)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": part.column("doc_id").take(pa.array(text)),
                            "item_id": pa.array([sent.value.ids[i] for i in item], item_type),
                            "score": pa.array(score, pa.float64()),
                            "first_word": pa.array(first, pa.int64()),
                            "last_word": pa.array(last, pa.int64()),
                        }
                    )

        found = found.unionAll(texts.mapInArrow(search, schema))
    return found


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of `docs` that hold no copy of an item; nothing is shuffled."""
    for sent in _ready(docs, text_col, items, item_id_col, item_text_col):

        def keep(batches, sent=sent):
            for part in chunks(batches, text_col):
                clean = np.ones(part.num_rows, dtype=bool)
                clean[[row[0] for row in sent.value.hits(part.column(text_col))]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
