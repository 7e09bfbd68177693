"""Substring dedup: Rabin-Karp hashes of all token windows, counted in Spark, cut out as intervals.

1. Each piece of a few megabytes of text hashes all its windows. A window found twice in the piece is
   known to be repeated and leaves it once only, so that a passage that a third of all documents share
   is one entry per piece. The other hashes go, with their document, to the bucket of their
   leading bits.
2. A bucket sorts what all pieces sent and tells the documents which of their windows it saw again;
   its answers to one part of the documents travel in one row.
3. Documents join these short answers by their key; overlapping windows merge into maximal intervals
   of words, which are removed.

Shuffled are about nine bytes a window, the answers, and each text once. Buckets are as many as
`spark.sql.shuffle.partitions`; a bucket holds hashes of its share of all windows. Hashes have 64
bits (two different windows among n meet by chance about n*n / 2**65 times).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from batchloom.llm.pretokens import spread
from batchloom.llm.words import Words, chunks

WINDOW = 35
KEY = "_row_key"
ANSWERS = "_answers"
_KNOWN, _REPEATED_ROW = -1, -(1 << 30)  # in place of a bucket
_SENT_COLUMNS = ("bucket", "keys", "counts", "hashes")
_ANSWER_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_SENT = 7  # bytes of a hash that are sent; the bucket stands for the rest
ADDED = ("n_words", "n_removed", "removed")


def buckets_of_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds values[ends[i-1]:ends[i]]."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * values.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of binary data in one batch")
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(ends), buffers)


def _runs(positions: np.ndarray) -> np.ndarray:
    """Begin and end of each run of consecutive numbers."""
    breaks = np.flatnonzero(np.diff(positions) != 1)
    first = positions[np.concatenate(([0], breaks + 1))]
    last = positions[np.concatenate((breaks, [len(positions) - 1]))]
    return np.stack((first, last + 1), axis=1)


def _send(n_buckets: int, window: int):
    """Windows of each piece, by bucket; windows repeated inside it answered at once (bucket < 0)."""

    def send(batches):
        for part in chunks(batches, "text"):
            words = Words(part.column("text"))
            keys = part.column(KEY).to_numpy()
            begin, hashes = words.windows(window)
            if not len(hashes):
                continue
            doc = np.searchsorted(words.first, begin, side="right") - 1
            order = np.argsort(hashes)
            equal = hashes[order[1:]] == hashes[order[:-1]]
            repeated = np.zeros(len(hashes), dtype=bool)
            repeated[order[1:]] = equal
            repeated[order[:-1]] |= equal
            rows = {"bucket": [], "keys": [], "counts": [], "hashes": []}

            def add(bucket, keys, counts, hashes):
                for name, value in zip(rows, (bucket, keys, counts, hashes)):
                    rows[name].append(value)

            known = np.flatnonzero(repeated)
            if len(known):
                cuts = np.flatnonzero((np.diff(known) != 1) | (np.diff(doc[known]) != 0)) + 1
                begins, ends = np.append(0, cuts), np.append(cuts, len(known))
                of = doc[known[begins]]
                runs = np.stack((known[begins], known[ends - 1] + 1), axis=1)
                runs -= first_windows(words, window)[of][:, None]
                for dest, *packed in _packed(keys[of], np.full(len(of), 2), runs.ravel(), n_buckets):
                    add(_KNOWN - dest, *packed)
            ask = np.flatnonzero(~repeated)
            once = order[1:][equal & np.concatenate(([True], ~equal[:-1]))]
            bucket, seen = buckets_of_hashes(hashes[ask], n_buckets), buckets_of_hashes(hashes[once], n_buckets)
            ask = ask[np.argsort(bucket, kind="stable")]
            once = once[np.argsort(seen, kind="stable")]
            bounds = np.searchsorted(np.sort(bucket), np.arange(n_buckets + 1))
            others = np.searchsorted(np.sort(seen), np.arange(n_buckets + 1))
            for b in range(n_buckets):
                mine = ask[bounds[b] : bounds[b + 1]]
                theirs = once[others[b] : others[b + 1]]
                if not len(mine) and not len(theirs):
                    continue
                docs = doc[mine]
                starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(mine) else mine
                counts = np.diff(np.append(starts, len(mine)))
                sent = np.concatenate((hashes[mine], hashes[theirs])).astype("<u8").view(np.uint8)
                add(
                    b,
                    keys[docs[starts]].astype("<i8").tobytes(),
                    counts.astype("<u4").tobytes(),
                    sent.reshape(-1, 8)[:, :_SENT].tobytes(),
                )
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(rows["bucket"], pa.int32()),
                    **{name: pa.array(rows[name], pa.binary()) for name in ("keys", "counts", "hashes")},
                }
            )

    return send


def first_windows(words: Words, window: int) -> np.ndarray:
    """The index of the first window of each text."""
    room = np.maximum(words.counts() - window + 1, 0)
    return np.cumsum(room) - room


def _packed(keys: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, n: int):
    """(destination, keys, sizes, numbers): what goes to the same part of the documents in one row."""
    dest = np.mod(keys, n)
    order = np.argsort(dest, kind="stable")
    dest, keys, size = dest[order], keys[order], sizes[order]
    numbers = numbers[spread((np.cumsum(sizes) - sizes)[order], size)].astype("<u4")
    ends = np.cumsum(size)
    cuts = np.append(np.flatnonzero(np.diff(dest)) + 1, len(dest))
    for begin, end in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist()):
        part = numbers[ends[begin] - size[begin] : ends[end - 1]]
        yield (
            int(dest[begin]),
            keys[begin:end].astype("<i8").tobytes(),
            size[begin:end].astype("<u4").tobytes(),
            part.tobytes(),
        )


def _answer(n: int):
    """Which windows of which documents a bucket has more than once, packed by destination."""

    def run(batches):
        keys, counts, hashes, is_asked = [], [], [], []
        bucket = 0
        out = []
        for batch in batches:
            for b, k, c, h in zip(*(batch.column(name).to_pylist() for name in _SENT_COLUMNS)):
                if b < 0:
                    out.append((_KNOWN - b, _KNOWN, k, c, h))
                    continue
                bucket = b
                sent = np.frombuffer(h, dtype=np.uint8).reshape(-1, _SENT)
                wide = np.zeros((len(sent), 8), dtype=np.uint8)
                wide[:, :_SENT] = sent
                hashes.append(wide.view("<u8").ravel())
                keys.append(np.frombuffer(k, dtype="<i8"))
                counts.append(np.frombuffer(c, dtype="<u4").astype(np.int64))
                asked = np.zeros(len(sent), dtype=bool)
                asked[: counts[-1].sum()] = True
                is_asked.append(asked)
        if hashes:
            hashes, is_asked = np.concatenate(hashes), np.concatenate(is_asked)
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(hashes)
            equal = hashes[order[1:]] == hashes[order[:-1]]
            again = np.zeros(len(hashes), dtype=bool)
            again[order[1:]] = equal
            again[order[:-1]] |= equal
            found = np.flatnonzero(again[is_asked])
            firsts = np.cumsum(counts) - counts
            of = np.searchsorted(firsts, found, side="right") - 1
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            size = np.diff(np.append(cuts, len(of)))
            for dest, *packed in _packed(keys[of[cuts]], size, found - firsts[of], n) if len(of) else ():
                out.append((dest, bucket, *packed))
            same, asker = hashes[is_asked][found], keys[of]
            order = np.lexsort((asker, same))
            same, asker = same[order], asker[order]
            rows = np.unique(asker[1:][(same[1:] == same[:-1]) & (asker[1:] == asker[:-1])])
            nothing = np.zeros(len(rows), dtype=np.int64)
            for dest, *packed in _packed(rows, nothing, nothing[:0], n) if len(rows) else ():
                out.append((dest, _REPEATED_ROW, *packed))
        for begin in range(0, len(out), 256):
            columns = list(zip(*out[begin : begin + 256]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, _ANSWER_TYPES)],
                names=["dest", "bucket", "keys", "sizes", "at"],
            )

    return run


def _gather(batches):
    """One row for each document that is answered: (row key, array of (bucket, at))."""
    keys, sizes, numbers, buckets = [], [], [], []
    for batch in batches:
        for b, k, c, at in zip(*(batch.column(name).to_pylist() for name in ("bucket", "keys", "sizes", "at"))):
            keys.append(np.frombuffer(k, dtype="<i8"))
            sizes.append(np.frombuffer(c, dtype="<u4").astype(np.int64))
            numbers.append(np.frombuffer(at, dtype="<u4"))
            buckets.append(np.full(len(keys[-1]), b, dtype=np.int32))
    if not keys:
        return
    keys, sizes, numbers, buckets = (np.concatenate(x) for x in (keys, sizes, numbers, buckets))
    order = np.argsort(keys, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    keys, sizes, buckets = keys[order], sizes[order], buckets[order]
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    for begin in range(0, len(firsts), 4096):
        own = firsts[begin : begin + 4096]
        lo = own[0]
        hi = firsts[begin + 4096] if begin + 4096 < len(firsts) else len(keys)
        part = numbers[spread(starts[lo:hi], sizes[lo:hi])].astype("<u4")
        answers = pa.StructArray.from_arrays(
            [pa.array(buckets[lo:hi]), _binary(part, np.cumsum(sizes[lo:hi]))], names=["bucket", "at"]
        )
        offsets = pa.array(np.append(own - lo, hi - lo).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[own]), pa.ListArray.from_arrays(offsets, answers)], names=[KEY, ANSWERS]
        )


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row key, answers) of the rows of (row key, text) with a window that also starts elsewhere."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.mapInArrow(_send(n, window), "bucket int, keys binary, counts binary, hashes binary")
    answers = sent.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).mapInArrow(
        _answer(n), "dest int, bucket int, keys binary, sizes binary, at binary"
    )
    return answers.repartitionById(n, "dest").mapInArrow(
        _gather, f"{KEY} bigint, {ANSWERS} array<struct<bucket:int,at:binary>>"
    )


def _starts(hashes: np.ndarray, answers, n_buckets: int) -> np.ndarray:
    """The repeated windows of one text, from the answers to it.

    Rows that are equal in all columns share their key, and so their answers, and repeat each other.
    """
    found = np.zeros(len(hashes), dtype=bool)
    for answer in answers:
        if answer["bucket"] == _REPEATED_ROW:
            found[:] = True
        elif answer["bucket"] == _KNOWN:
            for begin, end in np.frombuffer(answer["at"], dtype="<u4").reshape(-1, 2):
                found[begin:end] = True
    if found.all():
        return np.flatnonzero(found)
    asked = np.flatnonzero(~found)
    buckets = buckets_of_hashes(hashes[asked], n_buckets)
    order = np.argsort(buckets, kind="stable")
    firsts = np.searchsorted(buckets[order], np.arange(n_buckets))
    for answer in answers:
        if answer["bucket"] >= 0:
            at = np.frombuffer(answer["at"], dtype="<u4")
            found[asked[order[firsts[answer["bucket"]] + at]]] = True
    return np.flatnonzero(found)


def _cut(text_col: str, n_buckets: int, window: int, out: pa.Schema):
    def cut(batches):
        for part in chunks(batches, text_col):
            words = Words(part.column(text_col))
            counts = words.counts()
            removed = np.zeros(len(words.start), dtype=bool)
            spans = [[] for _ in range(len(words))]
            answers = part.column(ANSWERS)
            asked = np.flatnonzero(~np.asarray(answers.is_null()))
            if len(asked):
                _, hashes = words.windows(window)
                first = first_windows(words, window)
                for i in asked.tolist():
                    mine = hashes[first[i] : first[i] + max(0, counts[i] - window + 1)]
                    starts = _starts(mine, answers[i].as_py(), n_buckets)
                    cover = np.zeros(counts[i] + 1, dtype=np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + window, -1)
                    gone = np.flatnonzero(np.cumsum(cover[:-1]))
                    removed[words.first[i] + gone] = True
                    if len(gone):
                        spans[i] = [{"begin": b, "end": e} for b, e in _runs(gone).tolist()]
            kept = joined(words, ~removed)
            sums = np.concatenate(([0], np.cumsum(removed)))
            made = {
                text_col: kept,
                "n_words": pa.array(counts),
                "n_removed": pa.array(sums[words.first[1:]] - sums[words.first[:-1]]),
                "removed": spans,
            }
            columns = [made[f.name] if f.name in made else part.column(f.name) for f in out]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)],
                names=out.names,
            )

    return cut


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    of = np.repeat(np.arange(len(words)), words.counts())
    chosen = np.flatnonzero(keep)
    start, end, of = words.start[chosen], words.end[chosen].copy(), of[chosen]
    if len(of):
        end[:-1] += of[1:] == of[:-1]  # the byte behind a word becomes the space
    size = len(words.data)
    delta = np.zeros(size + 1, dtype=np.int8)
    delta[start] = 1
    delta[end] -= 1  # an end that is also a start cancels out
    inside = np.cumsum(delta[:size], dtype=np.int8).astype(bool)
    data = words.data.copy()
    spaces = end[:-1][of[1:] == of[:-1]] - 1 if len(of) else end
    data[spaces] = 0x20
    lengths = np.bincount(of, weights=end - start, minlength=len(words)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return pa.Array.from_buffers(
        pa.large_string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
    ).cast(pa.string())


def remove_repeats(
    docs: DataFrame, text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """`docs` with each word gone that lies in a window of `window` words found anywhere else too.

    Words are runs without ASCII white space, unchanged; what is kept is joined by one space. Added
    are n_words, n_removed (long) and `removed`, the maximal intervals (word numbers, end excluded);
    input columns of these names are replaced. Windows are judged on the input, also against the same
    text, and all copies go. A null text has no words and becomes empty, as does one that is removed
    whole. Rows are kept as they are, repeated rows and null ids too: a repeated row repeats its
    windows. Texts with fewer words than a window lose nothing. An empty table gives an empty one.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.drop(*[name for name in (*ADDED, KEY, ANSWERS) if name != text_col])
    others = [f"`{name}`" for name in docs.columns]
    keyed = docs.withColumn(KEY, F.xxhash64(*others))
    found = repeated_windows(keyed.select(KEY, F.col(f"`{text_col}`").alias("text")), window)
    kind = T.StructType(
        [f for f in docs.schema.fields]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
        + [
            T.StructField(
                "removed",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]
                    )
                ),
            )
        ]
    )
    out = to_arrow_schema(kind)
    joined_rows = keyed.join(found, KEY, "left").drop(KEY)
    return joined_rows.mapInArrow(_cut(text_col, n, window, out), kind)
