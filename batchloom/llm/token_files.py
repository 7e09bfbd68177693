"""Token ids in binary files: fixed-width bit packing, with block offsets for random access.

A file holds the ids of consecutive documents:

    magic 8 bytes, then as little-endian 64-bit numbers: bits, ids a block, documents, ids, blocks;
    document ids (documents numbers); ends of the documents in ids (documents numbers);
    byte offsets of the blocks in the payload (blocks numbers); the payload.

Every id takes the bits that the largest id of the vocabulary needs. 64 ids fill `bits` whole
64-bit words, so that packing and unpacking are a few shifts over numpy columns for any width, and the
block that holds id i is found from its number alone.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.pretokens import CHUNK_BYTES, Encoder
from batchloom.llm.words import chunks
from batchloom.session import durable, new_folder

MAGIC = b"BLTOKEN1"
BLOCK = 4096
FILE_IDS = 1 << 22
FANOUT = 1024
END_ID = 2
_GROUP = 64
_HEAD = 8 + 5 * 8


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64 ids to `bits` 64-bit words; the last group is filled up with zeros."""
    padded = np.zeros(-(-len(ids) // _GROUP) * _GROUP, dtype=np.uint64)
    padded[: len(ids)] = ids
    columns = padded.reshape(-1, _GROUP).T
    out = np.zeros((bits, columns.shape[1]), dtype=np.uint64)
    for j in range(_GROUP):
        word, shift = divmod(j * bits, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).ravel()


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    columns = words.reshape(-1, bits).T
    out = np.empty((_GROUP, columns.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(_GROUP):
        word, shift = divmod(j * bits, 64)
        value = columns[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (columns[word + 1] << np.uint64(64 - shift))
        out[j] = value & mask
    return np.ascontiguousarray(out.T).ravel()[:n]


def to_bytes(doc_ids: Sequence[int], ends: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = -(-len(ids) // BLOCK)
    block_bytes = BLOCK // _GROUP * bits * 8
    head = np.array([bits, BLOCK, len(doc_ids), len(ids), blocks], dtype="<u8")
    return b"".join(
        (
            MAGIC,
            head.tobytes(),
            np.asarray(doc_ids, dtype="<i8").tobytes(),
            np.asarray(ends, dtype="<u8").tobytes(),
            (np.arange(blocks, dtype="<u8") * np.uint64(block_bytes)).tobytes(),
            pack(ids, bits).astype("<u8").tobytes(),
        )
    )


class TokenFile:
    """One file; reads its head at once and of the payload only the blocks asked for."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(_HEAD, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, n_docs, self.n_ids, blocks = np.frombuffer(head[8:], "<u8").tolist()
        rest = np.frombuffer(file.read_at((2 * n_docs + blocks) * 8, _HEAD), dtype="<u8")
        self.doc_ids = rest[:n_docs].view("<i8")
        self.ends = rest[n_docs : 2 * n_docs].astype(np.int64)
        self.blocks = rest[2 * n_docs :].astype(np.int64)
        self.payload = _HEAD + len(rest) * 8

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids begin..end of the file."""
        if begin >= end:
            return np.zeros(0, dtype=np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        size = self.block // _GROUP * self.bits * 8
        n = min(self.n_ids, (last + 1) * self.block) - first * self.block
        need = (last - first) * size + -(-(n - (last - first) * self.block) // _GROUP) * self.bits * 8
        words = np.frombuffer(self.file.read_at(need, self.payload + self.blocks[first]), dtype="<u8")
        return unpack(words, self.bits, n)[begin - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, first id in the file, ids) of all documents, a span of blocks at a time."""
        i = 0
        while i < len(self.ends):
            begin = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, begin + FILE_IDS, side="right")))
            ids = self.ids(begin, int(self.ends[j - 1]))
            for k in range(i, j):
                at = int(self.ends[k - 1]) if k else 0
                yield int(self.doc_ids[k]), at, ids[at - begin : int(self.ends[k]) - begin]
            i = j


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


class HubEncoder(Encoder):
    """Asks the tokenizers library, once for each distinct match.

    A text that holds one of the tokens added to the vocabulary, which the library looks for before it
    cuts a text, is given to the library as a whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        super().__init__(self._matches)

    def _matches(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a match is a part of a text that holds no added token
        self.tokenizer.encode_special_tokens = True
        return self._flat(self.tokenizer.encode_batch_fast(matches, add_special_tokens=False))

    @staticmethod
    def _flat(found) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in found]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter((i for one in ids for i in one), dtype=np.int32, count=int(size.sum())), size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        holds = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            found = pc.fill_null(pc.match_substring(texts, token), False)
            holds |= found.to_numpy(zero_copy_only=False)
        if not holds.any():
            return super().__call__(texts)
        ids, ends = super().__call__(pc.if_else(pa.array(holds), pa.scalar("", texts.type), texts))
        self.tokenizer.encode_special_tokens = False
        parts = [ids[b:e] for b, e in zip(ends, ends[1:])]
        for row in np.flatnonzero(holds).tolist():
            text = texts[row].as_py()
            parts[row] = self._flat([self.tokenizer.encode(text, add_special_tokens=False)])[0]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_ENCODERS: dict[str, HubEncoder] = {}


def hub_encoder(path: str) -> HubEncoder:
    """The encoder of a worker for a tokenizers file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = HubEncoder(path)
    return _ENCODERS[path]


def _encode(path: str, bits: int, end_id: int, bounds: np.ndarray):
    kind = "<u2" if bits <= 16 else "<u4"

    def run(batches):
        encoder = hub_encoder(path)
        for part in chunks(batches, "text", CHUNK_BYTES):
            ids, ends = encoder(part.column("text"))
            packed = ids.astype(kind)
            end = np.array([end_id], dtype=kind).tobytes()
            doc_ids = part.column("doc_id")
            known = doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(np.searchsorted(bounds, known, side="right").astype(np.int32)),
                    "doc_id": doc_ids,
                    "ids": pa.array(
                        [packed[b:e].tobytes() + end for b, e in zip(ends[:-1], ends[1:])], pa.binary()
                    ),
                }
            )

    return run


def _write(folder: str, bits: int):
    kind = "<u2" if bits <= 16 else "<u4"

    def run(batches):
        system, path = open_folder(folder)
        doc_ids, parts, held, made, bucket = [], [], 0, 0, None

        def rows():
            nonlocal doc_ids, parts, held, made
            ends = np.cumsum([len(p) for p in parts])
            name = f"{path}/{bucket:08d}-{made:06d}.tok"
            draft = f"{name}.{uuid.uuid4().hex}"
            # written aside and renamed: a task that is tried again leaves the same bytes
            with system.open_output_stream(draft) as out:
                out.write(to_bytes(doc_ids, ends, np.concatenate(parts), bits))
            system.move(draft, name)
            row = {
                "bucket": [bucket], "seq": [made], "file": [name],
                "n_docs": [len(doc_ids)], "n_ids": [int(ends[-1])],
            }
            doc_ids, parts, held, made = [], [], 0, made + 1
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema(
            [("bucket", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
        )
        for batch in batches:
            for b, doc_id, ids in zip(*(batch.column(i) for i in range(3))):
                if bucket is not None and b.as_py() != bucket and parts:
                    yield rows()
                    made = 0
                bucket = b.as_py()
                missing = np.iinfo(np.int64).min
                doc_ids.append(missing if doc_id.as_py() is None else doc_id.as_py())
                parts.append(np.frombuffer(ids.as_buffer(), dtype=kind))
                held += len(parts[-1])
                if held >= FILE_IDS:
                    yield rows()
        if parts:
            yield rows()

    return run


def with_starts(manifest: DataFrame, buckets: int) -> DataFrame:
    """`manifest` with the number of ids before each file, by sums over ever larger ranges of buckets.

    No task orders more than FANOUT ranges, or the files of one bucket.
    """
    totals = manifest.groupBy(F.col("bucket").cast("long").alias("at")).agg(F.sum("n_ids").alias("n_ids"))
    levels = [totals]
    while buckets > FANOUT:
        buckets = -(-buckets // FANOUT)
        levels.append(
            levels[-1].groupBy(F.expr(f"at div {FANOUT}").alias("at")).agg(F.sum("n_ids").alias("n_ids"))
        )
    before = None
    for totals in reversed(levels):
        above = F.expr(f"at div {FANOUT}")
        sums = totals.select(
            "at", F.expr(f"coalesce(sum(n_ids) OVER (PARTITION BY at div {FANOUT} ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before")
        )
        if before is not None:
            higher = before.select(F.col("at").alias("above"), F.col("before").alias("more"))
            sums = sums.join(higher, above == F.col("above")).select("at", (F.col("before") + F.col("more")).alias("before"))
        before = sums
    inner = "coalesce(sum(n_ids) OVER (PARTITION BY bucket ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    files = manifest.withColumn("inner", F.expr(inner))
    return files.join(before, files["bucket"] == before["at"]).select(
        *manifest.columns, (F.col("inner") + F.col("before")).alias("start")
    )


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: int,
    end_id: int = END_ID,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of all documents to files in ascending id order; a row per file.

    Columns: bucket, seq, file, n_docs, n_ids, start (ids in all files before it). `path` is a tokenizers
    file, `vocabulary` its number of ids. Each text (null: empty) is encoded whole, without special
    tokens, and `end_id` follows it. Rows without an id come first and are read back without one; rows
    with equal ids stand next to each other, in the order of their ids' bytes. Other columns are not
    looked at. An empty table writes no file. Texts are encoded where they are read; only ids travel, at
    two bytes (four for vocabularies over 65,536), to the range of their document id.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    shares = [i / n for i in range(1, n)]
    bounds = texts.agg(F.percentile_approx("doc_id", shares or [0.5], 100 * n)).first()[0]
    bounds = np.unique(np.array(bounds or [], dtype=np.int64))
    bits = bits_for(vocabulary)
    folder = folder or new_folder(spark, "tokens")
    system, where = open_folder(folder)
    system.create_dir(where)
    encoded = texts.mapInArrow(
        _encode(path, bits, end_id, bounds), "bucket int, doc_id bigint, ids binary"
    )
    placed = encoded.repartitionById(n, F.least("bucket", F.lit(n - 1)))
    manifest = durable(
        placed.sortWithinPartitions("bucket", "doc_id", "ids").mapInArrow(
            _write(folder, bits), "bucket int, seq int, file string, n_docs bigint, n_ids bigint"
        )
    )
    return with_starts(manifest, n).withColumn("folder", F.lit(folder))


def read_tokens(files: DataFrame, schema: str, rows) -> DataFrame:
    """Read files back where Spark places them; `rows(doc_id, start, ids)` makes the tuple of a document."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for folder, name, start in zip(*(batch.column(c) for c in ("folder", "file", "start"))):
                system, _ = open_folder(folder.as_py())
                with system.open_input_file(name.as_py()) as file:
                    found = [
                        rows(None if doc_id == np.iinfo(np.int64).min else doc_id, start.as_py() + at, ids)
                        for doc_id, at, ids in TokenFile(file).documents()
                    ]
                columns = list(zip(*found))
                yield pa.RecordBatch.from_pydict(
                    {name: pa.array(column, type=pa.int64()) for name, column in zip(names, columns)}
                )

    # few bytes that stand for many: not to be put together into few tasks
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("folder", "file", "start").repartition(n, "file").mapInArrow(run, schema)


def document_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return read_tokens(
        files,
        "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
    )
