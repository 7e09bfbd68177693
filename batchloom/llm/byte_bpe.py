"""Byte-level BPE encoding and decoding by merge replay over all distinct matches at once.

The matches of a text are independent, so each distinct match of a slice of the corpus is encoded
once. All of them lie in one array of symbols, first their bytes. An inverted index leads from
each mergeable pair (by the rank of what it makes) to the positions where it stands; merges are applied
lowest rank first, to all matches that hold the pair, and only the neighbours of what was merged get new
pairs and new entries. A merge may make a pair of a lower rank than its own; that pair's rank is
taken next. In each match one merge is done at a time, the leftmost of the lowest rank, as the rank
files define it.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from batchloom.llm.pretokens import CHUNK_BYTES, Encoder, spread
from batchloom.llm.words import chunks

REPLAY_BYTES = 1 << 20
ADDED = ("token_ids", "decoded")
_NONE = -1


class Ranks:
    """The tokens of a rank file: their bytes, the pairs that make them, and the ids of single bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        ids = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.n = 1 + max(ids.values())
        keys, made = [], []
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * (self.n + 1) + right)
                    made.append(rank)
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        by_id = {rank: token for token, rank in ids.items()}
        tokens = [by_id.get(i, b"") for i in range(self.n)]
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair makes; `self.n` stands for the end of a match and makes nothing."""
        keys = left * (self.n + 1) + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], _NONE)

    def replay(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `matches`, and how many each has."""
        sizes = np.array([len(m) for m in matches], dtype=np.int64)
        # one place behind each match, and one before the first, ends all pairs
        data = np.frombuffer(b"\x00" + b"\x00".join(matches) + b"\x00", dtype=np.uint8)
        symbol = self.bytes[data]
        ends = np.concatenate(([0], np.cumsum(sizes + 1)))
        symbol[ends] = self.n
        match = np.repeat(np.arange(len(matches) + 1), np.append(sizes, 0) + 1)
        places = np.arange(len(symbol))
        after, before = places + 1, places - 1
        pair = np.full(len(symbol), _NONE, dtype=np.int64)
        pair[:-1] = self.merged(symbol[:-1], symbol[1:])

        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = pair[at]
            at, rank = at[rank != _NONE], rank[rank != _NONE]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begins = [0, *cuts.tolist(), len(at)]
            for b, e, r in zip(begins, begins[1:], rank[begins[:-1]].tolist()):
                if r in index:
                    index[r].append(at[b:e])
                else:
                    index[r] = [at[b:e]]
                    heapq.heappush(ranks, r)

        enter(places)
        while ranks:
            rank = heapq.heappop(ranks)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            at = np.sort(at)
            first = np.ones(len(at), dtype=bool)
            first[1:] = match[at[1:]] != match[at[:-1]]
            rest, at = at[~first], at[first]
            right = after[at]
            behind = after[right]
            symbol[at] = rank
            pair[right] = _NONE
            after[at] = behind
            before[behind] = at
            pair[at] = self.merged(symbol[at], symbol[behind])
            left = before[at]
            pair[left] = self.merged(symbol[left], symbol[at])
            symbol[right] = _NONE
            enter(np.concatenate((at, left)))
            if len(rest):
                enter(rest)
        kept = (symbol != _NONE) & (symbol != self.n)
        return symbol[kept].astype(np.int32), np.bincount(match[kept], minlength=len(matches) + 1)[:-1]

    def encode(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`replay` over slices of bounded size."""
        coded = [m.encode() for m in matches]
        ends = np.cumsum([len(m) for m in coded])
        found, begin = [], 0
        while begin < len(coded):
            limit = (ends[begin - 1] if begin else 0) + REPLAY_BYTES
            end = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
            found.append(self.replay(coded[begin:end]))
            begin = end
        return np.concatenate([ids for ids, _ in found]), np.concatenate([n for _, n in found])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of the ids ends[i]..ends[i+1], for each i."""
        data = self.data[spread(self.start[ids], self.size[ids])]
        sums = np.concatenate(([0], np.cumsum(self.size[ids])))[ends]
        return pa.Array.from_buffers(
            pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(sums.astype(np.int64)), pa.py_buffer(data)]
        ).cast(pa.binary())


_RANKS: dict[str, Ranks] = {}
_ENCODERS: dict[str, Encoder] = {}


def ranks_of(path: str) -> Ranks:
    if path not in _RANKS:
        _RANKS[path] = Ranks(path)
    return _RANKS[path]


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(ranks_of(path).encode)
    return _ENCODERS[path]


def _passing(out: pa.Schema, made, column: str, limit: int):
    """Rows of `out`: columns as they come in, and those that `made` computes from `column`."""

    def run(batches):
        for part in chunks(batches, column, limit):
            new = made(part.column(column))
            yield pa.RecordBatch.from_arrays(
                [new[f.name] if f.name in new else part.column(f.name) for f in out], names=out.names
            )

    return run


def encode_texts(
    docs: DataFrame, path: str, text_col: str = "text", decode: bool = False
) -> DataFrame:
    """`docs` with `token_ids` (array of int): each whole text by the ranks in `path`.

    A null or empty text has no ids. With `decode` the bytes of the ids are added, as by `decode_ids`, in
    the same pass and the same workers. Input columns of these names are replaced. Special tokens are
    ordinary text. Rows stay as they are and where they are: nothing is shuffled.
    """
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    if decode:
        added.append(T.StructField("decoded", T.BinaryType()))
    docs = docs.drop(*[f.name for f in added])
    kind = T.StructType([*docs.schema.fields, *added])

    def made(texts):
        ids, ends = encoder_of(path)(texts)
        new = {"token_ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))}
        if decode:
            new["decoded"] = ranks_of(path).decode(ids, ends)
        return new

    return docs.mapInArrow(_passing(to_arrow_schema(kind), made, text_col, CHUNK_BYTES), kind)


def decode_ids(docs: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """`docs` with `decoded` (binary): the bytes of the ids; null ids have none. A column of that name is replaced."""
    docs = docs.drop("decoded")
    kind = T.StructType([*docs.schema.fields, T.StructField("decoded", T.BinaryType())])
    out = to_arrow_schema(kind)

    def run(batches):
        ranks = ranks_of(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                lists = part.column(ids_col)
                sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
                ids = np.asarray(lists.flatten(), dtype=np.int64)
                decoded = ranks.decode(ids, np.concatenate(([0], np.cumsum(sizes))))
                yield pa.RecordBatch.from_arrays(
                    [decoded if f.name == "decoded" else part.column(f.name) for f in out], names=out.names
                )

    return docs.mapInArrow(run, kind)


def ids_text(ids: str = "token_ids"):
    """Decimal ids joined by one space, as a column."""
    return F.concat_ws(" ", F.col(ids).cast("array<string>"))
