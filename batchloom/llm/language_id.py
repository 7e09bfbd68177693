"""Language identification by error-correcting output codes over letter n-grams.

Each learned language has a codeword of bits; each bit is a binary classifier that tells the languages
with a 1 from those with a 0, by the log-odds of hashed letter trigrams and single letters (the
languages of a side weigh alike, however many documents they have). A second pass over the training
documents measures how often each bit is right for each language. A text takes the language whose codeword has the
least loss against its bits, each loss weighted by that reliability; a small gap to the second
is flagged as ambiguous.

All training documents are counted, in tasks; what is gathered is one array per language.
"""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.llm import pretokens
from batchloom.llm.gather import SCHEMA, slices, total
from batchloom.llm.pretokens import LETTER
from batchloom.llm.words import _STEP, chunks, flat, mix

UNKNOWN = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
FOLDS, HELD_OUT = 4, 2
SMOOTHING = 0.5
SHARPNESS = 4.0
GAP = 0.5
CHUNK_BYTES, SLICE_BYTES = 1 << 21, 1 << 18
_LOWER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if not _LOWER:
        if not pretokens._KINDS:
            pretokens._KINDS.append(pretokens._kinds())
        table = np.zeros(0x110000, dtype=np.uint32)
        for point in np.flatnonzero(pretokens._KINDS[0] == LETTER).tolist():
            table[point] = ord(chr(point).lower()[0])
        _LOWER.append(table)
    return _LOWER[0]


def _head(data: np.ndarray, at: int) -> int:
    """The first byte from `at` on that begins a code point, or the end."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def feature_slices(texts: pa.Array):
    """(text, bucket) of n-grams: every letter alone, and with what is on both sides of it in its text.

    Taken `SLICE_BYTES` at a time, so a text may have any length.
    """
    data, offsets = flat(texts)
    begin, shift = 0, np.uint64(64 - BUCKET_BITS)
    while begin < len(data):
        end = _head(data, begin + SLICE_BYTES)
        # one code point more on both sides
        low, high = max(begin - 1, 0), _head(data, end + 1)
        while data[low] & 0xC0 == 0x80:
            low -= 1
        part = data[low:high]
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
        places = np.flatnonzero((part & 0xC0) != 0x80) + low
        text = np.searchsorted(offsets, places, side="right") - 1
        own = _letters()[points].astype(np.uint64)
        left, right = np.zeros_like(own), np.zeros_like(own)
        same = text[1:] == text[:-1]
        left[1:][same], right[:-1][same] = own[:-1][same], own[1:][same]
        at = np.flatnonzero((own != 0) & (places >= begin) & (places < end))
        text, own, left, right = text[at], own[at], left[at], right[at]
        three = ((left << np.uint64(42)) | (own << np.uint64(21)) | right) + np.uint64(_STEP)
        one = own + np.uint64(1 << 63)
        buckets = np.concatenate((mix(three) >> shift, mix(one) >> shift)).astype(np.int64)
        yield np.concatenate((text, text)), buckets
        begin = end


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All of `feature_slices`."""
    none = np.zeros(0, dtype=np.int64)
    found = list(feature_slices(texts)) or [(none, none)]
    return tuple(np.concatenate(part) for part in zip(*found))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages.

    All different splits of the languages for up to five; for more, 10 log2(n) bits, the best of some
    drawn sets by the least distance between two rows.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=float).T
    draw = random.Random(n)
    bits = math.ceil(10 * math.log2(n))
    best, distance = None, -1
    for _ in range(50):
        code = np.array([[draw.choice((1, -1)) for _ in range(bits)] for _ in range(n)], dtype=float)
        if (abs(code.sum(axis=0)) == n).any():
            continue
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > distance:
            best, distance = code, apart.min()
    return best


class Model:
    """Languages, their codewords, one weight vector per bit, and the reliability of each bit."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
        sides = [
            [shares[self.code[:, b] == side].mean(axis=0) if (self.code[:, b] == side).any() else None for side in (1, -1)]
            for b in range(self.code.shape[1])
        ]
        flat = np.zeros(counts.shape[1])
        self.weights = np.stack(
            [flat if one is None or zero is None else np.log(one / zero) for one, zero in sides], axis=1
        ).astype(np.float32)
        self.reliable = np.ones_like(self.code)

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The mean log-odds of each bit for each text, and the number of n-grams."""
        n = len(texts)
        size, sums = np.zeros(n, dtype=np.int64), np.zeros((n, self.weights.shape[1]))
        weights = np.ascontiguousarray(self.weights.T)
        for text, bucket in feature_slices(texts):
            size += np.bincount(text, minlength=n)
            for bit, own in enumerate(weights):
                sums[:, bit] += np.bincount(text, weights=own[bucket], minlength=n)
        return sums / np.maximum(size, 1)[:, None], size

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each row, its score, and whether the second is close."""
        weights = self.reliable / self.reliable.sum(axis=1, keepdims=True)
        z = np.clip(margins[:, None, :] * self.code[None] * SHARPNESS, -8, 8)
        loss = (np.logaddexp(0, -z) * weights[None]).sum(axis=2)
        best = loss.argmin(axis=1)
        ordered = np.sort(loss, axis=1)
        near = np.exp(-SHARPNESS * (loss - ordered[:, :1]))
        close = ordered[:, 1] - ordered[:, 0] < GAP / SHARPNESS if loss.shape[1] > 1 else near[:, 0] < 0
        return best, 1 / near.sum(axis=1), close


def learn(docs: DataFrame, text_col: str, lang_col: str, train) -> Model | None:
    """A model of the languages of the rows where `train` holds; None if there are none."""
    rows = docs.where(train & F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    )

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part in chunks(batches, "text", CHUNK_BYTES):
            coded = part.column("lang").dictionary_encode()
            names, langs = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
            for text, bucket in feature_slices(part.column("text")):
                found = np.bincount(langs[text] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                for i, name in enumerate(names):
                    own = found[i * BUCKETS : (i + 1) * BUCKETS]
                    sums[name] = sums[name] + own if name in sums else own
        for name, values in sums.items():
            yield from slices(name, values)

    counts = total(rows.mapInArrow(count, SCHEMA))
    languages = sorted(name for name in counts if counts[name].any())
    if not languages:
        return None
    model = Model(languages, np.stack([counts[name] for name in languages]))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    width = 1 + model.code.shape[1]

    def measure(batches):
        model = sent.value
        at = {name: i for i, name in enumerate(model.languages)}
        sums = np.zeros((len(model.languages), width))
        for part in chunks(batches, "text", CHUNK_BYTES):
            margins, size = model.margins(part.column("text"))
            lang = np.array([at.get(name, -1) for name in part.column("lang").to_pylist()])
            used = (size > 0) & (lang >= 0)
            right = margins[used] * model.code[lang[used]] > 0
            np.add.at(sums, lang[used], np.column_stack((np.ones(used.sum()), right)))
        yield from slices("right", sums.ravel())

    sums = total(rows.mapInArrow(measure, SCHEMA))["right"].reshape(-1, width)
    model.reliable = (sums[:, 1:] + 1) / (sums[:, :1] + 2)
    return model


def predict_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """`docs` with held_out, lang_pred, score and ambiguous; columns of these names are replaced.

    Learnt from text and language of the rows with an id and a language whose crc32(id as text) modulo
    `FOLDS` is not `HELD_OUT` (held_out tells which are; false without an id). `score` is the share of the
    chosen language in the exponentials of the weighted losses; ties go to the first in alphabetical order.
    A text that is null or has no letter, or if nothing was learnt, is `und` with score 0. Whole texts are
    read. Rows stay as they are.
    """
    docs = docs.drop(
        *[c for c in ("held_out", "lang_pred", "score", "ambiguous") if c not in (id_col, text_col, lang_col)]
    )
    fold = F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS
    held = F.coalesce(fold == HELD_OUT, F.lit(False))
    model = learn(docs, text_col, lang_col, F.coalesce(fold != HELD_OUT, F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.withColumn("held_out", held)
    columns = docs.columns

    def predict(batches):
        model = sent.value
        for part in chunks(batches, text_col, CHUNK_BYTES):
            n = part.num_rows
            names, score, close = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
            if model is not None:
                margins, size = model.margins(part.column(text_col))
                best, sure, near = model.decode(margins)
                known = size > 0
                names[known] = np.array(model.languages, dtype=object)[best[known]]
                score[known], close[known] = sure[known], near[known]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in columns),
                    pa.array(names, pa.string()),
                    pa.array(score),
                    pa.array(close),
                ],
                names=[*columns, "lang_pred", "score", "ambiguous"],
            )

    kind = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
        ]
    )
    return docs.mapInArrow(predict, kind)
