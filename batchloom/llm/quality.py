"""Quality rules: fixed rules on counts, and a log-likelihood ratio of hashed n-grams.

A text is written as the shapes of its words (runs of small letters are `a`, of capitals `A`, of digits
`0`, repeated other characters one), so that `the,` and `und,` are alike and `TH!!` and `on%%%` are not. Pairs of
neighbouring shapes are hashed into `BUCKETS` buckets, counted over all documents (the raw corpus) and
over those labelled good (the trusted target). A text's score is the mean of
log(p target / p raw) over its pairs; at `THRESHOLD` or above it is kept. Both multinomials cover
all their documents, and every document is judged by the same threshold.

DataFrame functions only. Texts stay where they are read: what is shuffled are the shapes of texts
(to meet the labels) and one count per bucket and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
THRESHOLD = -0.5
PRIOR = 100.0
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
_SPACE = r"[\x20\x09-\x0D]+"
_NO_SYMBOL = r"[^#*$%&|<>]+"

ADDED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept",
)


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def shapes_of(text: Column) -> Column:
    """The shapes of the words of a text, with marks for its ends, as one string."""
    shape = F.coalesce(text, F.lit(""))
    for pattern, mark in (
        (r"[\p{Ll}\p{Lo}]+", "a"),
        (r"[\p{Lu}\p{Lt}]+", "A"),
        (r"\p{N}+", "0"),
        (r"([^\sA0a])\1+", "$1"),
        (_SPACE, " "),
    ):
        shape = F.regexp_replace(shape, pattern, mark)
    return F.concat(F.lit("^ "), F.btrim(shape), F.lit(" $"))


def buckets_of(shapes: Column) -> Column:
    """The bucket of each pair of neighbours."""

    def pairs(s):
        return F.zip_with(
            F.slice(s, 1, F.size(s) - 1),
            F.slice(s, 2, F.size(s)),
            lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"),
        )

    return _let(F.split(shapes, " "), pairs)


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in `width`-word windows that stand twice or more in the text.

    Windows are sorted by hash; the lower bits of each number tell where it stands, and neighbours of equal
    upper bits are compared word by word.
    """
    n = F.size(words) - (width - 1)

    def count(hashes):
        bits = F.length(F.bin(F.size(hashes).cast("long")))

        def covered(bits):
            low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            marked = F.array_sort(
                F.transform(
                    hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))
                )
            )

            def found(s):
                place = lambda x: x.bitwiseAND(low).cast("int")

                def same(k):
                    a, b = F.get(s, k - 1), F.get(s, k)
                    equal = a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(low)) == 0
                    for j in range(width):
                        equal = equal & (F.get(words, place(a) + j) == F.get(words, place(b) + j))
                    return equal

                twice = F.filter(F.sequence(F.lit(1), F.size(s) - 1), same)
                return F.flatten(
                    F.transform(
                        twice,
                        lambda k: F.concat(
                            *[
                                F.array(place(F.get(s, k - 1)) + j, place(F.get(s, k)) + j)
                                for j in range(width)
                            ]
                        ),
                    )
                )

            return F.size(F.array_distinct(_let(marked, found)))

        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), _let(bits, covered)
        ).otherwise(0)

    hashes = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]),
    )
    return F.when(n >= 2, _let(hashes, count)).otherwise(0).cast("long")


def ratio_weights(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> list[float]:
    """log(p target / p raw) of each bucket, over all documents and those with quality 1."""
    good = (
        labels.groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
    )
    shapes = docs.select(
        F.col(f"`{id_col}`").alias("_id"), shapes_of(F.col(f"`{text_col}`")).alias("shapes")
    )
    pairs = shapes.join(good, "_id", "left").select(
        F.col("quality").isNotNull().alias("trusted"), F.explode(buckets_of(F.col("shapes"))).alias("bucket")
    )
    counted = pairs.groupBy("bucket").agg(
        F.count("*").alias("raw"), F.count_if(F.col("trusted")).alias("target")
    )
    # one row per bucket
    rows = {row["bucket"]: (row["raw"], row["target"]) for row in counted.collect()}
    raw_sum = sum(raw for raw, _ in rows.values())
    target_sum = sum(target for _, target in rows.values())
    weights = []
    for bucket in range(BUCKETS):
        raw, target = rows.get(bucket, (0, 0))
        p_raw = (raw + 1) / (raw_sum + BUCKETS)
        # drawn towards the raw corpus, so that without trusted text all ratios are 1
        p_target = (target + PRIOR * p_raw) / (target_sum + PRIOR)
        weights.append(math.log(p_target / p_raw))
    return weights


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with the counts of the fixed rules, `score` and `kept`; columns of these names are replaced.

    Words are runs without ASCII white space. word_chars: code points in words; n_symbols: characters of
    `#*$%&|<>`; n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in 3-word windows
    found twice or more; base_failed: under 50 words, or over half of them repeated so. `labels` has
    doc_id and quality; a document counts as trusted if all its labels say 1. Without labels the
    score is 0 and only the fixed rules decide. A null or empty text has no words and fails. Rows
    stay as they are, repeated ones too; an empty table gives an empty one.
    """
    docs = docs.drop(*[c for c in ADDED if c not in (id_col, text_col)])
    columns = docs.columns
    weights = ratio_weights(docs, labels, id_col, text_col)
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    weighed = F.transform(buckets_of(F.col("_shapes")), lambda b: F.get(table, b))
    mean = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / F.size(w)

    def counts(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    judged = docs.select(
        *[F.col(f"`{c}`") for c in columns],
        _let(words_of(text), counts).alias("_counts"),
        F.length(F.regexp_replace(text, _NO_SYMBOL, "")).cast("long").alias("_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("_dup_lines"),
        shapes_of(text).alias("_shapes"),
    ).withColumn("_score", _let(weighed, mean))
    failed = (F.col("_counts.n_words") < MIN_WORDS) | (
        F.col("_counts.n_repeat_words") * 100 > F.col("_counts.n_words") * MAX_REPEATED_PERCENT
    )
    return judged.select(
        *[F.col(f"`{c}`") for c in columns],
        "_counts.n_words",
        "_counts.word_chars",
        F.col("_symbols").alias("n_symbols"),
        F.col("_dup_lines").alias("n_dup_lines"),
        "_counts.n_repeat_words",
        failed.alias("base_failed"),
        F.col("_score").alias("score"),
        (~failed & (F.col("_score") >= THRESHOLD)).alias("kept"),
    )
