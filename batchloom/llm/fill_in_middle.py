"""Fill-in-the-middle documents: prefix, middle and suffix in a new order, and back again.

1. Each text is cut into units (a run of ASCII letters, or any other single code point), and two unit counts
   drawn from the id say where its middle lies. The text is read in slices, so memory follows the slice.
2. What goes to the output leaves the document as pieces of up to `UNITS` units, keyed by the row and the place
   in the output. They are partitioned by row and sorted by (row, place), the DataFrame form of
   repartitionAndSortWithinPartitions, so an output streams by piece after piece: into a digest
   or into a text.
3. The stream itself says where prefix, suffix and middle begin. Pieces get their places in the original from
   that, are sorted by them where they lie, without another exchange, and stream by once more as the restored text.

No task holds more of a document than a piece, except where a caller asks for whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.words import flat

# fixed values: the marks before prefix, suffix and middle, and the shares of forms in percent
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
UNITS = 2048
SLICE_BYTES = 1 << 20
TEXT_BYTES = 1 << 22
_MARKS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_ROW = ["row", "id"]


def unit_starts(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Which of the bytes begin..end of a text begin a unit."""
    part = data[max(begin - 1, 0) : end]
    letter = ((part | 0x20) - np.uint8(97)) < 26
    starts = (part & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts[1:] if begin else starts


def _starts(data: np.ndarray, slice_bytes: int):
    """(byte, unit starts from there) for the slices of a text."""
    for at in range(0, len(data), slice_bytes):
        yield at, unit_starts(data, at, min(len(data), at + slice_bytes))


def _offsets(data: np.ndarray, units: list[int], slice_bytes: int) -> list[int]:
    """The bytes at which some units begin, in order; the unit behind the last one is the end."""
    found, seen, at = [], 0, 0
    for begin, starts in _starts(data, slice_bytes):
        starts = np.flatnonzero(starts)
        while at < len(units) and units[at] < seen + len(starts):
            found.append(begin + int(starts[units[at] - seen]))
            at += 1
        seen += len(starts)
    return found + [len(data)] * (len(units) - at)


def _cut(data: np.ndarray, h: tuple[int, ...], marked: bool, size: int, slice_bytes: int):
    """(n, form, prefix_chars, middle_chars, pieces in the order of the output) of one text."""
    n = sum(int(starts.sum()) for _, starts in _starts(data, slice_bytes))
    plain = not len(data) or marked or h[2] % 100 >= PLAIN_FROM
    low, high = (n, n) if plain else sorted((h[0] % (n + 1), h[1] % (n + 1)))
    units = sorted({*range(0, n, size), low, high, n})
    offsets = _offsets(data, units, slice_bytes)
    parts: list[list[tuple[int, int]]] = [[], [], []]
    for unit, a, b in zip(units, offsets, offsets[1:]):
        parts[0 if unit < low else 1 if unit < high else 2].append((a, b))
    if plain:
        return n, "plain", None, None, parts[0]
    points = [
        sum(int(((data[a:b] & 0xC0) != 0x80).sum()) for a, b in part) for part in parts
    ]
    head, middle, tail = parts
    if h[3] % 100 < SPM_BELOW:
        return n, "spm", points[0], points[1], [SUFFIX, *tail, PREFIX, *head, MIDDLE, *middle]
    return n, "psm", points[0], points[1], [PREFIX, *head, SUFFIX, *tail, MIDDLE, *middle]


_PIECE = "row bigint, id bigint, place bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, data binary"
_NAMES = ["row", "id", "place", "n", "form", "prefix_chars", "middle_chars", "data"]
_TYPES = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.binary()]


class _Out:
    """Rows that are given out as Arrow batches of bounded size."""

    def __init__(self, names, types):
        self.names, self.types = names, types
        self.rows, self.size = [], 0

    def add(self, row: tuple, size: int = 64):
        self.rows.append(row)
        self.size += size
        if self.size >= TEXT_BYTES:
            yield from self.flush()

    def flush(self):
        if self.rows:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*self.rows), self.types)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


def _hashes(id_col: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}")
        for i in range(4)
    ]


def output_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    units: int = UNITS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The outputs of all rows of `docs` as pieces, each row's in one partition and in order.

    Columns: row, id, place (from 0), n, form, prefix_chars, middle_chars, data. Place 0 has no data and says
    what a row is, so rows without a text have it, too. `row` tells repeated rows and ids apart.
    """
    text = F.col(f"`{text_col}`")
    marked = F.lit(False)
    for mark in _MARKS:
        marked = marked | F.contains(text, F.lit(mark.decode()))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        *_hashes(F.col(f"`{id_col}`")),
        F.coalesce(marked, F.lit(False)).alias("marked"),
        text.alias("text"),
    )

    def run(batches):
        out = _Out(_NAMES, _TYPES)
        for batch in batches:
            for at in range(batch.num_rows):
                # one text at a time: no copy of a batch of long ones
                row = batch.slice(at, 1)
                data, offsets = flat(row.column("text"))
                keys = [row.column(name)[0].as_py() for name in ("row", "id")]
                h = tuple(row.column(f"h{i}")[0].as_py() for i in range(1, 5))
                data = data[: int(offsets[-1])]
                *what, pieces = _cut(data, h, row.column("marked")[0].as_py(), units, slice_bytes)
                yield from out.add((*keys, 0, *what, None))
                for place, piece in enumerate(pieces, 1):
                    piece = piece if isinstance(piece, bytes) else data[piece[0] : piece[1]].tobytes()
                    yield from out.add((*keys, place, None, None, None, None, piece), 64 + len(piece))
        yield from out.flush()

    pieces = found.mapInArrow(run, _PIECE)
    return pieces.repartition("row").sortWithinPartitions("row", "place")


def _rows(batches: Iterator[pa.RecordBatch]):
    """Pieces, row by row of the documents, as iterators of dicts."""

    def single():
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from batch.slice(at, 256).to_pylist()

    for _, pieces in groupby(single(), key=lambda piece: piece["row"]):
        yield pieces


_BACK = _PIECE + ", part int, output_sha256 string"


def _rekeyed(pieces: DataFrame) -> DataFrame:
    """Pieces of outputs with the part of the original that each belongs to, and the output's digest.

    The parts follow from the output and its form alone: marks are what no text with parts holds.
    """

    def run(batches):
        out = _Out([*_NAMES, "part", "output_sha256"], [*_TYPES, pa.int32(), pa.string()])
        for pieces in _rows(batches):
            head = next(pieces)
            digest, part = hashlib.sha256(), 0
            for piece in pieces:
                data = piece["data"]
                digest.update(data)
                if len(data) == 3 and head["form"] != "plain" and data in _MARKS:
                    part = _MARKS[data]
                else:
                    row = tuple(piece[name] for name in _NAMES)
                    yield from out.add((*row, part, None), 64 + len(data))
            row = tuple(head[name] for name in _NAMES)
            yield from out.add((*row, -1, digest.hexdigest()))
        yield from out.flush()

    return pieces.mapInArrow(run, _BACK).sortWithinPartitions("row", "part", "place")


_DIGESTS = (
    "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
    "output_sha256 string, restored_sha256 string"
)


def output_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for each row of `docs`.

    `n` counts units; lengths are code points, null for plain. A text is plain if it is empty, holds one of the marks
    or is drawn so; null counts as empty, and a row without an id draws from an empty one. The restored
    text is put together from the output and its form. Repeated rows and ids have a row each, an empty table
    none. Other columns are not looked at. `sizes` are those of `output_pieces`.
    """
    names = ["id", "n", "form", "prefix_chars", "middle_chars"]

    def run(batches):
        kinds = [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
        out = _Out([*names, "output_sha256", "restored_sha256"], kinds)
        for pieces in _rows(batches):
            head = next(pieces)
            digest = hashlib.sha256()
            for piece in pieces:
                digest.update(piece["data"])
            row = [head[name] for name in names]
            yield from out.add((*row, head["output_sha256"], digest.hexdigest()))
        yield from out.flush()

    found = _rekeyed(output_pieces(docs, id_col, text_col, **sizes)).mapInArrow(run, _DIGESTS)
    return found.withColumnRenamed("id", id_col)


def _texts(pieces: DataFrame) -> DataFrame:
    def run(batches):
        out = _Out(["id", "form", "text"], [pa.int64(), pa.string(), pa.string()])
        for pieces in _rows(batches):
            head = next(pieces)
            text = b"".join(piece["data"] for piece in pieces)
            yield from out.add((head["id"], head["form"], text.decode()), 64 + len(text))
        yield from out.flush()

    return pieces.mapInArrow(run, "id bigint, form string, text string")


def transform_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int
) -> DataFrame:
    """(id, form, text): the outputs themselves, whole in memory one at a time."""
    found = _texts(output_pieces(docs, id_col, text_col, **sizes))
    return found.withColumnsRenamed({"id": id_col, "text": text_col})


def restored(form: Column, output: Column) -> Column:
    """The original text of an output that is stored as a whole."""
    head, tail, middle = (mark.decode() for mark in (PREFIX, SUFFIX, MIDDLE))
    after = lambda mark: F.substring_index(output, mark, -1)
    mid = after(middle)
    psm = F.concat(
        F.substring_index(after(head), tail, 1), mid, F.substring_index(after(tail), middle, 1)
    )
    spm = F.concat(
        F.substring_index(after(head), middle, 1), mid, F.substring_index(after(tail), head, 1)
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
