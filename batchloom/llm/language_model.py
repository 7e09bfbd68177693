"""Language-model scores: a class-factored log-bilinear model trained with noise-contrastive estimation.

1. Texts become blocks of token numbers, written once; a block lists its distinct tokens by hash.
2. All tokens are counted: blocks send their distinct tokens with counts to buckets of hashes, which add
   them up and answer each block. Counts are combined per block, so a token that is everywhere is
   one entry per block.
3. Every token that is at least one in `SHARE` is a word of its own: the vocabulary follows the corpus,
   and there cannot be more than `SHARE` of them however large it is. A full block holds each of them about
   16 times, so every task has learnt all of them when parameters are averaged. The other tokens share one
   word, in which a token's probability comes from its count. Words are put into classes by the
   frequent words that stand next to them.
4. A log-bilinear model predicts the class of a word, and the word in its class, from the two before:
   r = C1 r(w-1) + C2 r(w-2), logit = r . vector + bias. Every task trains through all of its blocks from
   the same start, over all training tokens, classes against noise from the class frequencies and words
   against noise from their class; the parameters are averaged by the number of tokens, `ROUNDS` times.
5. Each block is scored: both softmaxes are batched matrix products over its distinct contexts and events,
   so the log-probabilities are normalised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.gather import SCHEMA, slices, total
from batchloom.llm.substring_dedup import buckets_of_hashes
from batchloom.llm.words import Words, chunks
from batchloom.session import durable

SHARE = 1 << 16  # a word of its own is at least one token in so many: there are no more such words
LEAST = 3  # and occurs at least so often
SINGLE = 64  # most frequent words: classes of their own, and the neighbours by which others are told apart
SMOOTH = 4.0
WIDTH = 24
START = 1.0
ROUNDS = 2
BATCH = 4096  # contexts normalised at once
STEP = 1024  # distinct events that one step of the training looks at
PASSES = 1
NOISE = 64
INNER_NOISE = 4
RATE = 0.2
SEED = 7
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x8000000000000001)  # stands for the hash of the end of a text
_CODEC = "zstd"

_BLOCKS = "block bigint, docs array<bigint>, held array<boolean>, ends binary, tokens binary, hashes binary"


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec=_CODEC, asbytes=True)


def _expand(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.decompress(data, decompressed_size=n * size, codec=_CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def _encode(batches):
    """Texts as blocks: token numbers, where documents end, and the hashes of the distinct tokens."""
    made = 0
    for part in chunks(batches, "text"):
        words = Words(part.column("text"), fold=True)
        counts = words.counts() + 1
        ends = np.cumsum(counts)
        hashes = np.full(int(ends[-1]), END, dtype=np.uint64)
        inner = np.ones(len(hashes), dtype=bool)
        inner[ends - 1] = False
        hashes[inner] = words.hash
        distinct, tokens = np.unique(hashes, return_inverse=True)
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([(TaskContext.get().partitionId() << 33) + made], pa.int64()),
                "docs": pa.array([part.column("id")], pa.list_(pa.int64())),
                "held": pa.array([part.column("held")], pa.list_(pa.bool_())),
                "ends": pa.array([ends.astype("<i8").tobytes()], pa.binary()),
                "tokens": pa.array([_squeeze(tokens.astype("<u4"))], pa.binary()),
                "hashes": pa.array([distinct.astype("<u8").tobytes()], pa.binary()),
            }
        )
        made += 1


class Block:
    def __init__(self, row: dict):
        self.id, self.docs = row["block"], row["docs"]
        self.held = np.array(row["held"], dtype=bool)
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.tokens = _expand(row["tokens"], int(self.ends[-1]), "<u4").astype(np.int64)
        self.hashes = np.frombuffer(row["hashes"], "<u8")

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def trained(self) -> np.ndarray:
        """Which tokens are learnt from."""
        return np.repeat(~self.held, self.sizes())

    def contexts(self, classes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """The classes one and two tokens before each token; `start` before the text."""
        one = np.full(len(classes), start)
        one[1:] = classes[:-1]
        begins = np.concatenate(([0], self.ends[:-1]))
        one[begins] = start
        two = np.full(len(classes), start)
        two[1:] = one[:-1]
        two[begins] = start
        return one, two


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _send(n_buckets: int):
    """(bucket, block, hashes, counts): the distinct tokens of each block, with training counts."""

    def run(batches):
        for row in _rows(batches):
            block = Block(row)
            counts = np.bincount(block.tokens[block.trained()], minlength=len(block.hashes))
            buckets = buckets_of_hashes(block.hashes, n_buckets)  # ascending, as the hashes are
            bounds = np.searchsorted(buckets, np.arange(n_buckets + 1))
            used = np.flatnonzero(np.diff(bounds)).tolist()
            parts = [slice(bounds[b], bounds[b + 1]) for b in used]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(used, pa.int32()),
                    "block": pa.array([block.id] * len(used), pa.int64()),
                    "hashes": pa.array([block.hashes[p].tobytes() for p in parts], pa.binary()),
                    "counts": pa.array([_squeeze(counts[p].astype("<u8")) for p in parts], pa.binary()),
                }
            )

    return run


_COUNTED = "block bigint, bucket int, n int, counts binary, tokens bigint, distinct bigint, top array<struct<hash:bigint,count:bigint>>"


def _count():
    """Totals of a bucket: an answer to each block, and one row (block null) of sums and frequent tokens."""

    def run(batches):
        hashes, counts, blocks, bucket = [], [], [], 0
        for batch in batches:
            for b, block, h, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                bucket = b
                blocks.append(block)
                hashes.append(np.frombuffer(h, "<u8"))
                counts.append(_expand(c, len(hashes[-1]), "<u8"))
        if not blocks:
            return
        distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(sums, at, np.concatenate(counts).astype(np.int64))
        seen = np.flatnonzero(sums)
        # of a share of the tokens, so all that have a share of all tokens are among them
        top = seen[sums[seen] >= max(LEAST, int(sums.sum()) / SHARE)]
        candidates = pa.StructArray.from_arrays(
            [pa.array(distinct[top].view(np.int64)), pa.array(sums[top])], names=["hash", "count"]
        )
        offsets = pa.array([0] * (len(blocks) + 1) + [len(top)], pa.int32())
        ends = np.cumsum([len(h) for h in hashes])
        answers = [_squeeze(sums[a].astype("<u8")) for a in np.split(at, ends[:-1])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*blocks, None], pa.int64()),
                pa.array([bucket] * (len(blocks) + 1), pa.int32()),
                pa.array([*map(len, hashes), 0], pa.int32()),
                pa.array([*answers, None], pa.binary()),
                pa.array([None] * len(blocks) + [int(sums.sum())], pa.int64()),
                pa.array([None] * len(blocks) + [len(seen)], pa.int64()),
                pa.ListArray.from_arrays(offsets, candidates),
            ],
            names=["block", "bucket", "n", "counts", "tokens", "distinct", "top"],
        )

    return run


class Vocabulary:
    """Words of their own, in classes; one word stands for all others and one before a text.

    The `SINGLE` most frequent words and the others' word are classes of their own. The rest is halved again and
    again, by the main direction in which the neighbours of the words differ, until a class has about
    as many words as there are classes. Words are numbered in the order of their classes.
    """

    def __init__(self, top: list[tuple[int, int]], tokens: int, distinct: int, near: np.ndarray | None = None):
        top = sorted(top, key=lambda t: (-t[1], t[0]))
        hashes = np.array([h for h, _ in top], dtype=np.int64).view(np.uint64)
        counts = np.array([c for _, c in top], dtype=np.int64)
        self.n = len(top)
        self.other, self.start = self.n, self.n + 1
        self.frequent = min(SINGLE, self.n)
        cells = [np.array([i]) for i in range(self.frequent)]
        if self.n > self.frequent:
            near = np.zeros((self.n, SINGLE)) if near is None else near
            cells += _halved(np.arange(self.frequent, self.n), _profiles(near))
        cells.append(np.array([self.n]))
        order = np.concatenate(cells)
        self.order = order[:-1]  # the rank by frequency of each word
        self.first = np.concatenate(([0], np.cumsum([len(c) for c in cells])))
        self.class_of = np.repeat(np.arange(len(cells)), np.diff(self.first))
        self.tokens, self.distinct = tokens, distinct
        self.rest, self.rest_distinct = tokens - int(counts.sum()), distinct - self.n
        self.counts = np.append(counts, self.rest)[order]
        by = np.argsort(hashes[self.order])
        self.hashes, self.words = hashes[self.order][by], by

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word."""
        if not self.n:
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        return np.where(self.hashes[at] == hashes, self.words[at], self.other)

    def log_shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each class among all, and of each word in its class."""
        shares = self.counts + 1.0
        sums = np.add.reduceat(shares, self.first[:-1])
        return np.log(sums / sums.sum()), np.log(shares / sums[self.class_of])


def _profiles(near: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the neighbours of each word; few neighbours say little."""
    usual = (near.sum(axis=0) + 1) / (near.sum() + near.shape[1])
    return np.sqrt((near + SMOOTH * usual) / (near.sum(axis=1, keepdims=True) + SMOOTH))


def _halved(words: np.ndarray, profiles: np.ndarray) -> list[np.ndarray]:
    size = max(2.0, len(words) ** 0.5)
    cells = [words]
    while len(cells[0]) > size:
        halves = []
        for cell in cells:
            apart = profiles[cell] - profiles[cell].mean(axis=0)
            along = apart @ np.linalg.eigh(apart.T @ apart)[1][:, -1]
            halves += np.array_split(cell[np.argsort(along, kind="stable")], 2)
        cells = halves
    return cells


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


class LogBilinear:
    """Parameters as one vector: vectors of context words, of words and of classes, two matrices, biases.

    log P(word) = log P(class) + log P(word in its class), each a softmax of r . vector + bias.
    """

    def __init__(self, vocabulary: Vocabulary, values: np.ndarray | None = None):
        self.vocabulary, self.squares = vocabulary, None
        n, classes = vocabulary.n, len(vocabulary.first) - 1
        self.class_noise, self.word_noise = (x.astype(np.float32) for x in vocabulary.log_shares())
        shapes = (
            (n + 2, WIDTH), (n + 1, WIDTH), (classes, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (n + 1,), (classes,)
        )
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        fresh = values is None
        self.values = np.zeros(int(ends[-1]), np.float32) if fresh else values.astype(np.float32)
        parts = np.split(self.values, ends[:-1])
        self.r, self.q, self.u, self.c1, self.c2, self.bias, self.class_bias = (
            p.reshape(s) for p, s in zip(parts, shapes)
        )
        if fresh:
            self.r[:] = np.random.default_rng(SEED).normal(0, WIDTH**-0.5, self.r.shape)
            self.q[:] = self.r[:-1]
            self.u[:] = np.add.reduceat(self.q, vocabulary.first[:-1]) / np.diff(vocabulary.first)[:, None]
            self.c1[:] = self.c2[:] = START * np.eye(WIDTH)
            self.bias[:], self.class_bias[:] = self.word_noise, self.class_noise

    def predicted(self, one, two):
        return self.r[one] @ self.c1 + self.r[two] @ self.c2

    def log_probabilities(self, one, two, words) -> np.ndarray:
        """Normalised log-probabilities (base e) of the words after their contexts."""
        size, vocabulary = len(self.r), self.vocabulary
        events, back = np.unique((one * size + two) * size + words, return_inverse=True)
        context, word = events // size, events % size
        kind = vocabulary.class_of[word]
        firsts = np.flatnonzero(np.diff(context, prepend=-1))
        of = np.cumsum(np.diff(context, prepend=-1) != 0) - 1
        out = np.empty(len(events))
        for begin in range(0, len(firsts), BATCH):
            own = firsts[begin : begin + BATCH]
            last = firsts[begin + BATCH] if begin + BATCH < len(firsts) else len(events)
            part = slice(own[0], last)
            vectors = self.predicted(context[own] // size, context[own] % size)
            at = of[part] - begin
            logits = vectors @ self.u.T + self.class_bias
            out[part] = (logits[at, kind[part]] - _log_sums(logits)[at]).astype(np.float64)
        inner = np.flatnonzero(np.diff(vocabulary.first)[kind] > 1)
        inner = inner[np.argsort(kind[inner], kind="stable")]
        bounds = np.searchsorted(kind[inner], np.arange(len(vocabulary.first)))
        for c in np.unique(kind[inner]).tolist():
            lo, hi = vocabulary.first[c], vocabulary.first[c + 1]
            for begin in range(bounds[c], bounds[c + 1], BATCH):
                mine = inner[begin : min(begin + BATCH, bounds[c + 1])]
                logits = self.predicted(context[mine] // size, context[mine] % size) @ self.q[lo:hi].T
                logits += self.bias[lo:hi]
                out[mine] += logits[np.arange(len(mine)), word[mine] - lo] - _log_sums(logits)
        return out[back]

    def train(self, one, two, words, seed: int) -> None:
        """Passes over all events in shuffled batches (Adagrad): classes against noise shared inside a batch,
        words against noise from their own class."""
        draw = np.random.default_rng(seed)
        size, vocabulary = len(self.r), self.vocabulary
        events, weight = np.unique((one * size + two) * size + words, return_counts=True)
        order = np.concatenate([draw.permutation(len(events)) for _ in range(PASSES)])
        # an event counts as often as it occurs, in whichever step it comes
        weight = (weight / (weight.sum() * min(1.0, STEP / len(events)))).astype(np.float32)
        chances = np.exp(self.class_noise.astype(np.float64))
        chances /= chances.sum()
        mass = np.concatenate(([0.0], np.cumsum(vocabulary.counts + 1.0)))
        below, above = mass[vocabulary.first[:-1]], mass[vocabulary.first[1:]]
        many = np.diff(vocabulary.first) > 1
        names = ("r", "q", "u", "c1", "c2", "bias", "class_bias")
        if self.squares is None:
            self.squares = {name: np.full_like(getattr(self, name), 1e-3) for name in names}
        squares = self.squares

        narrow = np.min_scalar_type(size)  # two bytes, where they do, are sorted by radix

        def move(name, gradient, at=slice(None)):
            square = squares[name][at] + gradient * gradient
            squares[name][at] = square
            getattr(self, name)[at] -= RATE * gradient / np.sqrt(square)

        def step(rows, **gradients):
            by = np.argsort(rows.astype(narrow), kind="stable")
            ordered = rows[by]
            starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
            for name, gradient in gradients.items():
                move(name, np.add.reduceat(gradient[by], starts, axis=0), ordered[starts])

        for begin in range(0, len(order), STEP):
            pick = order[begin : begin + STEP]
            event, share = events[pick], weight[pick]
            word, context = event % size, event // size
            a, b = context // size, context % size
            kind = vocabulary.class_of[word]
            ra, rb = self.r[a], self.r[b]
            vector = ra @ self.c1 + rb @ self.c2
            noise = draw.choice(len(chances), NOISE, p=chances)
            shift = np.float32(np.log(NOISE)) + self.class_noise
            good = np.einsum("ij,ij->i", vector, self.u[kind]) + self.class_bias[kind] - shift[kind]
            bad = vector @ self.u[noise].T + self.class_bias[noise] - shift[noise]
            d_good, d_bad = -share * _sigmoid(-good), share[:, None] * _sigmoid(bad)
            d_vector = d_good[:, None] * self.u[kind] + d_bad @ self.u[noise]
            d_class = np.concatenate((d_good[:, None] * vector, d_bad.T @ vector))
            d_class_bias = np.concatenate((d_good, d_bad.sum(axis=0)))
            inner = np.flatnonzero(many[kind])
            if len(inner):
                v, target, of, own = vector[inner], word[inner], kind[inner], share[inner]
                u = below[of, None] + draw.random((len(of), INNER_NOISE)) * (above - below)[of, None]
                drawn = np.searchsorted(mass, u, side="right") - 1
                drawn = np.clip(drawn, vocabulary.first[of, None], vocabulary.first[of + 1, None] - 1)
                shift = np.float32(np.log(INNER_NOISE)) + self.word_noise
                q, qn = self.q[target], self.q[drawn]
                good = np.einsum("ij,ij->i", v, q) + self.bias[target] - shift[target]
                bad = np.einsum("ij,ikj->ik", v, qn) + self.bias[drawn] - shift[drawn]
                g_good, g_bad = -own * _sigmoid(-good), own[:, None] * _sigmoid(bad)
                d_vector[inner] += g_good[:, None] * q + np.einsum("ik,ikj->ij", g_bad, qn)
                rows = np.concatenate((target, drawn.ravel()))
                d_words = (g_bad[:, :, None] * v[:, None, :]).reshape(-1, WIDTH)
                step(
                    rows,
                    q=np.concatenate((g_good[:, None] * v, d_words)),
                    bias=np.concatenate((g_good, g_bad.ravel())),
                )
            step(np.concatenate((kind, noise)), u=d_class, class_bias=d_class_bias)
            d_r = np.concatenate((d_vector @ self.c1.T, d_vector @ self.c2.T))
            move("c1", ra.T @ d_vector)
            move("c2", rb.T @ d_vector)
            step(np.concatenate((a, b)), r=d_r)


def _log_sums(logits: np.ndarray) -> np.ndarray:
    high = logits.max(axis=1)
    return high + np.log(np.exp(logits - high[:, None]).sum(axis=1))


def _near(vocabulary: Vocabulary):
    """How often each word, by its rank, stands next to each of the `SINGLE` most frequent ones."""
    ranks = np.append(vocabulary.order, [vocabulary.n, vocabulary.n])

    def run(batches):
        sums, found = np.zeros((vocabulary.n + 1) * SINGLE), False
        for row in _rows(batches):
            block = Block(row)
            words = ranks[vocabulary.classes(block.hashes)][block.tokens]
            before, _ = block.contexts(words, vocabulary.n)
            used = block.trained()
            for word, other in ((words, before), (before, words)):
                at = used & (other < vocabulary.frequent)
                pairs, n = np.unique(word[at] * SINGLE + other[at], return_counts=True)
                sums[pairs] += n
            found = True
        if found:
            yield from slices("near", sums)

    return run


def _train(vocabulary: Vocabulary, values: np.ndarray):
    def run(batches):
        model, weight = LogBilinear(vocabulary, values), 0
        for row in _rows(batches):
            block = Block(row)
            used = block.trained()
            if not used.any():
                continue
            words = vocabulary.classes(block.hashes)[block.tokens]
            one, two = block.contexts(words, vocabulary.start)
            model.train(one[used], two[used], words[used], SEED + block.id % (1 << 31))
            weight += int(used.sum())
        if weight:
            yield from slices("parameters", np.append(model.values.astype(np.float64) * weight, weight))

    return run


def _score(vocabulary: Vocabulary, values: np.ndarray):
    def run(batches):
        model = LogBilinear(vocabulary, values)
        unit = np.log10(vocabulary.tokens + vocabulary.distinct + 1)
        rest = np.log10(vocabulary.rest + vocabulary.rest_distinct + 1)
        for row in _rows(batches):
            block = Block(row)
            answers = sorted(row["answers"], key=lambda a: a["bucket"])
            counts = np.concatenate([_expand(a["counts"], a["n"], "<u8") for a in answers])
            logs = np.log10(counts.astype(np.float64) + 1)
            classes = vocabulary.classes(block.hashes)
            inside = np.where(classes == vocabulary.other, logs - rest, 0.0)
            of_token = classes[block.tokens]
            one, two = block.contexts(of_token, vocabulary.start)
            model_logs = model.log_probabilities(one, two, of_token) / np.log(10) + inside[block.tokens]
            begins = np.concatenate(([0], block.ends[:-1]))
            add = lambda x: np.add.reduceat(x, begins)  # noqa: E731  every text has its end at least
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array(block.docs, pa.int64()),
                    "held_out": pa.array(block.held),
                    "n_tokens": pa.array(block.sizes()),
                    "n_known": pa.array(add((counts > 0).astype(np.int64)[block.tokens])),
                    "train_tokens": pa.array(np.full(len(block.docs), vocabulary.tokens)),
                    "base_score": pa.array(add((logs - unit)[block.tokens])),
                    "score": pa.array(add(model_logs)),
                }
            )

    return run


def _fit(blocks: DataFrame, sums: DataFrame, n_tasks: int) -> tuple[Vocabulary, np.ndarray]:
    """Words, classes and parameters. A task gives one array, so blocks are read by at most `n_tasks` tasks."""
    tokens, distinct = (x or 0 for x in sums.agg(F.sum("tokens"), F.sum("distinct")).first())
    top = (
        sums.select(F.explode("top").alias("top"))
        .where(F.col("top.count") >= F.lit(max(LEAST, tokens / SHARE)))
        .select("top.*")
        .collect()  # `SHARE` rows at most
    )
    top = [(r["hash"], r["count"]) for r in top]
    blocks = blocks.coalesce(n_tasks)
    vocabulary = Vocabulary(top, tokens, distinct)
    if vocabulary.n > vocabulary.frequent:
        near = total(blocks.mapInArrow(_near(vocabulary), SCHEMA))["near"].reshape(-1, SINGLE)
        vocabulary = Vocabulary(top, tokens, distinct, near[:-1])
    values = LogBilinear(vocabulary).values
    for _ in range(ROUNDS):
        found = total(blocks.mapInArrow(_train(vocabulary, values), SCHEMA)).get("parameters")
        if found is not None:
            values = (found[:-1] / found[-1]).astype(np.float32)
    return vocabulary, values


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are runs without ASCII white space, A-Z lower-cased, and one end per text; a null or empty text is
    its end alone. Learnt from documents with an id whose crc32(id as text) modulo `FOLDS` is not `HELD_OUT`;
    held_out is false without an id, and such rows are not learnt from either. base_score: the sum of
    log10((c + 1) / (N + V + 1)) over the tokens, c their training counts, N all of them (train_tokens), V the
    distinct ones; n_known: tokens with c > 0. score: log10 of the model's probability of the text. Without
    training documents N and V are 0 and both scores 0. A row per row, repeated ones and equal
    ids too. Frequent tokens of equal counts are ranked in the order of their hashes.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.col(f"`{id_col}`")
    texts = docs.select(
        ids.cast("long").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        (F.crc32(ids.cast("string")) % FOLDS).alias("fold"),
    ).withColumn("held", F.coalesce(F.col("fold") == HELD_OUT, F.lit(True)))
    blocks = durable(texts.select("id", "text", "held").mapInArrow(_encode, _BLOCKS))
    sent = blocks.mapInArrow(_send(n), "bucket int, block bigint, hashes binary, counts binary")
    counted = durable(sent.repartitionById(n, "bucket").mapInArrow(_count(), _COUNTED))
    vocabulary, values = _fit(blocks, counted.where("block IS NULL"), n)
    answers = (
        counted.where("block IS NOT NULL")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "n", "counts")).alias("answers"))
    )
    scored = blocks.join(answers, "block").mapInArrow(
        _score(vocabulary, values),
        "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    known = F.when(F.col("id").isNull(), F.lit(False)).otherwise(F.col("held_out"))
    return scored.withColumn("held_out", known).withColumnRenamed("id", id_col)
