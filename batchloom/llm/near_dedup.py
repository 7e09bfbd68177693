"""Near-duplicate documents by bottom-k sketches of their shingle sets, verified on the full sets.

1. One hash function maps every shingle of a document to a number; the set is kept as a fingerprint,
   its size and its k smallest numbers. Documents with equal sets form a class, and only one
   document of each class goes on, so copies cost one row each.
2. Inverted lists of the retained values find classes that overlap. Two sets with a Jaccard index of 0.8
   share at least `SHARED` of the `SKETCH` smallest values of their union, but for 3.4 of 100 million pairs at
   exactly 0.8 (a binomial number with a mean of 38) and fewer above it, so a class whose sketch meets fewer
   shared values has no partner, and each class may leave out its `SHARED` - 1 most
   frequent values: two that fit still meet in a rarer one. That keeps boilerplate out of the lists.
3. Lists of up to `SHORT` classes give their pairs. Longer lists are large groups of near copies: those with one
   lowest member are a bucket, which is compared with a few pivots, which joins most of it, and what is
   apart from the largest component still is compared with all members, block by block. So no link
   between components is lost, and pairs inside one are not written out.
4. Pairs are filtered by the bottom k of their union, with the same `SHARED` of `SKETCH`, then verified on the
   full sets; connected components are joins (see graph.py).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.graph import components
from batchloom.llm.pretokens import spread
from batchloom.llm.stored import stored
from batchloom.llm.words import Words, chunks

PERCENT = 80
SKETCH = 48
SHARED = 22
SHORT = 32
PIVOTS = 3
QUERIES, MEMBERS = 128, 512


def shingle_sets(words: Words, width: int):
    """The sorted shingle hashes (63 bits) of each text; a shorter text is one shingle."""
    counts = words.counts()
    room = np.maximum(counts - width + 1, 0)
    _, hashes = words.windows(width)
    ends = np.cumsum(room)
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = dict(
        zip(short.tolist(), words.spans(words.first[short], words.first[short + 1]) >> np.uint64(1))
    )
    hashes = (hashes >> np.uint64(1)).astype(np.int64)
    none = np.zeros(0, dtype=np.int64)
    for i, (n, end) in enumerate(zip(room.tolist(), ends.tolist())):
        if n:
            yield np.unique(hashes[end - n : end])
        else:
            yield np.array([whole[i]], dtype=np.int64) if i in whole else none


def _lists(arrays) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _sketches(width: int):
    def run(batches):
        for part in chunks(batches, "text"):
            sets = list(shingle_sets(Words(part.column("text"), fold=True), width))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id"),
                    "mark": part.column("mark"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "print": pa.array(
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()
                    ),
                    "sketch": _lists([s[:SKETCH] for s in sets]),
                }
            )

    return run


def _sets(width: int):
    def run(batches):
        for part in chunks(batches, "text"):
            sets = list(shingle_sets(Words(part.column("text"), fold=True), width))
            yield pa.RecordBatch.from_pydict({"class": part.column("id"), "set": _lists(sets)})

    return run


def _keys(classes: DataFrame) -> DataFrame:
    """(value, class, n): the retained values in which partners must meet."""
    postings = classes.select("class", "n", F.explode("sketch").alias("value"))
    frequency = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    met = postings.join(frequency, "value").groupBy("class", "n")
    met = met.agg(F.sort_array(F.collect_list(F.struct("df", "value")), asc=False).alias("met"))
    needed = F.least(F.lit(SHARED), F.ceil(F.col("n") * PERCENT / 100)).cast("int")
    return (
        met.withColumn("needed", needed)
        .where(F.size("met") >= F.col("needed"))
        .select("class", "n", F.explode(F.expr("slice(met, needed, size(met))")).alias("key"))
        .select("key.value", "class", "n")
    )


def _fit(n, m):
    """Sizes that allow the similarity."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT)


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")
    ).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda name: sets.select(F.col("class").alias(name), F.col("set").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    low = lambda name: F.slice(f"set_{name}", 1, SKETCH)
    union = F.slice(F.array_sort(F.array_union(low("a"), low("b"))), 1, SKETCH)
    common = F.array_intersect(union, F.array_intersect(low("a"), low("b")))
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    union_size = F.size("set_a") + F.size("set_b") - F.col("overlap")
    return (
        both.where(F.size(common) * SKETCH >= F.size(union) * SHARED)
        .withColumn("overlap", overlap)
        .where(F.col("overlap") * 100 >= union_size * PERCENT)
        .select("a", "b")
    )


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("class"), "component")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components `found` after some links between them; classes without one are their own."""
    ends = links
    for end in ("a", "b"):
        own = found.select(F.col("class").alias(end), F.col("component").alias(f"of_{end}"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce(f"of_{end}", end))
    joined = components(ends.select("a", "b"))
    joined = stored(joined.select(F.col("node").alias("component"), F.col("component").alias("to")))
    moved = found.join(joined, "component", "left").select(
        "class", F.coalesce("to", "component").alias("component")
    )
    alone = joined.join(found, joined["component"] == found["class"], "left_anti")
    return stored(
        moved.unionAll(alone.select(F.col("component").alias("class"), F.col("to").alias("component")))
    )


def _members(long: DataFrame) -> DataFrame:
    """(bucket, class, n, often): long lists by their lowest member in hash order.

    Lists of one group of copies mostly have it in common, so the group is one bucket or a few, and a
    member is in a bucket once, however many values brought it there. `often` says in how many long lists it is.
    """
    lowest = F.min_by("class", F.xxhash64("class", F.lit(0))).alias("bucket")
    buckets = stored(long.groupBy("value").agg(lowest))
    often = long.groupBy("class").agg(F.count("*").alias("often"))
    members = long.join(buckets, "value").select("bucket", "class", "n").distinct()
    return stored(members.join(often, "class"))


def _pivots(members: DataFrame) -> DataFrame:
    """Pairs of the members of each bucket with a few of them: the first in some hash orders, and the one that
    is in most long lists, which is close to what the others were copied from."""
    marks = [F.xxhash64("class", F.lit(turn)) for turn in range(PIVOTS)]
    marks.append(F.struct(-F.col("often"), F.xxhash64("class")))
    names = [f"p{i}" for i in range(len(marks))]
    found = members.groupBy("bucket").agg(
        *[F.min_by(F.struct("class", "n"), mark).alias(name) for mark, name in zip(marks, names)]
    )
    pivots = found.select("bucket", F.explode(F.array(*names)).alias("pivot"))
    pivots = pivots.select("bucket", F.col("pivot.class").alias("other"), F.col("pivot.n").alias("m"))
    return members.join(stored(pivots.distinct()), "bucket").where(
        (F.col("class") != F.col("other")) & _fit(F.col("n"), F.col("m"))
    )


def _left_apart(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components inside buckets, one per class and component at least.

    What is apart from a bucket's largest component is a set of queries against all its members: blocks of
    queries meet blocks of members, and each pair of blocks is a task of bounded size, in which
    intersections are counted over an index of the queries' shingles.
    """
    members = members.select("bucket", "class")
    members = stored(
        members.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    )
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    top = F.max(F.struct("size", "component")).alias("top")
    sizes = sizes.groupBy("bucket").agg(F.sum("size").alias("all"), top).select(
        "bucket",
        F.col("top.component").alias("largest"),
        F.ceil(F.col("all") / MEMBERS).alias("m"),
        F.ceil((F.col("all") - F.col("top.size")) / QUERIES).alias("q"),
    )
    members = members.join(stored(sizes.where("q > 0")), "bucket").join(sets, "class")
    block = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    kept = ["bucket", "class", "component", "set"]
    queries = members.where("component <> largest").select(
        *kept, F.lit(True).alias("asked"), block("q", 1).alias("i"), each("m").alias("j")
    )
    rows = members.select(
        *kept, F.lit(False).alias("asked"), each("q").alias("i"), block("m", 2).alias("j")
    )
    return queries.unionAll(rows).groupBy("bucket", "i", "j").applyInArrow(_compare, "a bigint, b bigint")


def _compare(table: pa.Table) -> pa.Table:
    """Queries and members that are similar and in different components."""
    table = table.combine_chunks()
    asked = table.column("asked").to_numpy()
    name, component = table.column("class").to_numpy(), table.column("component").to_numpy()
    lists = table.column("set").combine_chunks()
    size = lists.value_lengths().to_numpy()
    values, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
    queries = np.flatnonzero(asked)
    place = np.zeros(len(size), dtype=np.int64)
    place[queries] = np.arange(len(queries))
    mine = asked[of]
    order = np.argsort(values[mine], kind="stable")
    index, owner = values[mine][order], place[of[mine]][order]
    links = set()
    for row in np.flatnonzero(~asked).tolist():
        own = lists[row].values.to_numpy()
        low, high = np.searchsorted(index, own), np.searchsorted(index, own, side="right")
        both = np.bincount(owner[spread(low, high - low)], minlength=len(queries))
        union = size[queries] + size[row] - both
        near = (both * 100 >= union * PERCENT) & (component[queries] != component[row])
        for q in queries[near].tolist():
            # one link to a component is as good as all
            links.add((name[q], component[row]))
    pairs = sorted(links)
    return pa.table(
        {
            "a": pa.array([a for a, _ in pairs], pa.int64()),
            "b": pa.array([b for _, b in pairs], pa.int64()),
        }
    )


def _text_mark(text_col: str):
    return F.coalesce(F.md5(F.col(f"`{text_col}`")), F.lit(""))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5
) -> DataFrame:
    """(id, n_shingles, component_id, kept): the group of each document, and whether it stands for it.

    A document's set are its distinct `width`-word shingles (words: runs without ASCII white space,
    A-Z lower-cased); with fewer words the whole sequence is one. Documents are linked if
    their sets have a Jaccard index of 0.8 or more; a group is what links connect, and its smallest id
    is kept. A text without words, or null, has an empty set and is linked with nothing. Rows with
    the same id are one document with the links of all of them; each gets a row. A row without an id
    is in no group: its component is null and it is kept. Ids are integers. Other columns are not
    looked at.
    """
    return _judged(docs, id_col, text_col, width).drop("mark")


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """`near_duplicates` with a mark of each row's text."""
    texts = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        _text_mark(text_col).alias("mark"),
        F.col(f"`{text_col}`").alias("text"),
    )
    prints = stored(
        texts.mapInArrow(
            _sketches(width),
            "id bigint, mark string, n bigint, print binary, sketch array<bigint>",
        )
    )
    classes = stored(
        prints.where("n > 0 AND id IS NOT NULL")
        .groupBy("print")
        .agg(F.min("id").alias("class"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    keys = stored(_keys(classes))
    sizes = keys.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    keys = stored(keys.join(sizes, "value"))
    candidates = keys.select(F.col("class").alias("id")).distinct()
    sets = stored(
        texts.join(candidates, "id", "left_semi").mapInArrow(
            _sets(width), "class bigint, set array<bigint>"
        )
    )
    short = keys.where(F.col("size") <= SHORT).drop("size")
    long = _members(keys.where(F.col("size") > SHORT).drop("size"))
    others = short.select("value", F.col("class").alias("other"), F.col("n").alias("m"))
    pairs = short.join(others, "value").where(
        (F.col("class") < F.col("other")) & _fit(F.col("n"), F.col("m"))
    )
    names = ["class", "other"]
    pairs = _pairs(pairs.select(*names).unionAll(_pivots(long).select(*names)))
    found = stored(_named(components(_verified(pairs, sets))))
    links = stored(_left_apart(long, found, sets))
    if not links.isEmpty():
        found = _merged(found, links)
    named = stored(
        classes.select("print", "class")
        .join(found, "class", "left")
        .select("print", F.coalesce("component", "class").alias("component"))
    )
    return (
        prints.select("id", "mark", "n", "print")
        .join(named, "print", "left")
        .select(
            F.col("id").alias(id_col),
            "mark",
            F.col("n").alias("n_shingles"),
            F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id"))
            .otherwise(F.col("component"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5
) -> DataFrame:
    """`docs` with one row of each group of near duplicates; rows without an id stay.

    Of several rows with the id that stands for its group, the one whose text has the least MD5 stays; of
    rows equal in id and text any one.
    """
    kept = _judged(docs, id_col, text_col, width).where("kept")
    kept = kept.where(F.col(f"`{id_col}`").isNotNull()).groupBy(id_col).agg(F.min("mark").alias("_mark"))
    marked = docs.withColumn("_mark", _text_mark(text_col))
    keys = [id_col, "_mark"]
    one = marked.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
    return one.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
