"""Shards of near equal size that keep equal texts together: minimax contiguous partition.

1. Rows with equal texts are a group, which no cut divides. Groups are ordered by a hash of their text,
   and running sums of their bytes say where each one ends. The order is cut into as many buckets as the
   first digits of the hash have values, so the sums need a window per bucket and one over the buckets.
2. A group of at least the average shard leaves nothing to balance: it has a shard of its own, and the
   others are partitioned over the shards that are left.
3. The smallest feasible capacity is found by binary search; a capacity is feasible if taking as many groups
   as fit, shard by shard, ends within the number of shards. Checks read a directory of at most about
   `CELLS` ends. What it holds gives a capacity that is certainly enough, what it might hide one that is certainly
   needed; both bound where each cut can be, and only there the directory is made finer by the next pass over
   the groups, until both bounds are equal and the cuts are ends of groups themselves.
4. Cuts are at most one hash per shard, so the shard of a row follows from its own text, without a join.

Only DataFrame functions touch rows. What the driver sees are directories, whose size does not grow.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.stored import stored

CELLS = 1 << 14
_KEY_DIGITS, _BUCKET_DIGITS, _SLOT_DIGITS = 15, 4, 3
_IN_BUCKET = 16 ** (_KEY_DIGITS - _BUCKET_DIGITS)


def text_key(text_col: str = "text") -> Column:
    """60 bits of the text's MD5: the place of its group in the order. A null text is like an empty one."""
    digits = F.substring(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 1, _KEY_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint")


@dataclass(frozen=True)
class ShardPlan:
    """Shards 0, 1, .. are the groups `alone`; after them each shard ends with the next key in `cuts`."""

    n_shards: int
    capacity: int
    alone: tuple[int, ...]
    cuts: tuple[int, ...]

    def shard(self, key: Column) -> Column:
        """The shard of a row from the key of its text."""
        place = F.lit(len(self.alone))
        for cut in self.cuts[:-1]:
            place = place + F.when(key > cut, 1).otherwise(0)
        own = F.lit(None).cast("int")
        for i, of in enumerate(self.alone):
            own = F.when(key == of, i).otherwise(own)
        return F.coalesce(own, place).cast("int")


class Directory:
    """Some of the ends of groups in order: cells as (least end, largest end, key of the largest, ends)."""

    def __init__(self, cells: list[tuple[int, int, int, int]]):
        self.cells = sorted(cells)
        self.least = [cell[0] for cell in self.cells]
        self.most = [cell[1] for cell in self.cells]
        self.known = sorted({*self.least, *self.most})
        self.key_of = {cell[1]: cell[2] for cell in self.cells}

    def surely(self, limit: int) -> int:
        """The largest known end up to `limit`."""
        at = bisect_right(self.known, limit)
        return self.known[at - 1] if at else 0

    def perhaps(self, limit: int) -> int:
        """No end up to `limit` is larger than this."""
        at = bisect_right(self.least, limit) - 1
        if at < 0:
            return 0
        least, most, _, ends = self.cells[at]
        return most if limit >= most else least if ends <= 2 else limit

    def walk(self, capacity: int, shards: int, end_of) -> list[int]:
        """Where the shards end if each takes as much as fits."""
        ends, at = [], 0
        for _ in range(shards):
            at = max(at, end_of(at + capacity))
            ends.append(at)
        return ends

    def smallest(self, total: int, shards: int, end_of) -> int:
        low, high = -(-total // shards), total
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, end_of)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def unclear(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Stretches that hide ends at which a shard of a capacity from `low` to `high` could end.

        At most one per shard: from its first such cell to its last.
        """
        found = []
        for a, b in zip(self.walk(low, shards, self.surely), self.walk(high, shards, self.perhaps)):
            at = bisect_left(self.most, a)
            hiding = []
            while at < len(self.cells) and self.least[at] <= b:
                if self.cells[at][3] > 2:
                    hiding.append(at)
                at += 1
            if hiding:
                found.append([self.least[hiding[0]], self.most[hiding[-1]]])
        joined: list[list[int]] = []
        for a, b in sorted(found):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        return [(a, b) for a, b in joined]

    def refined(self, stretches: list[tuple[int, int]], cells) -> Directory:
        kept = [c for c in self.cells if not any(a <= c[0] and c[1] <= b for a, b in stretches)]
        return Directory(kept + cells)


def _cells(ends: DataFrame, stretches: list[tuple[int, int]], cells: int) -> list[tuple]:
    """The ends in some stretches, about `cells` of them at most, those between counted."""
    width = max(1, -(-sum(b - a + 1 for a, b in stretches) // cells))
    inside = F.lit(False)
    for a, b in stretches:
        inside = inside | F.col("end").between(a, b)
    found = (
        ends.where(inside)
        .groupBy(F.expr(f"end div {width}").alias("cell"))
        .agg(F.min("end"), F.max("end"), F.max_by("key", "end"), F.count("*"))
        .drop("cell")
    )
    return [tuple(row) for row in found.collect()]


def _group_ends(groups: DataFrame, alone: tuple[int, ...]) -> DataFrame:
    """(key, end): the bytes of all groups up to and with this one, without those that stand alone."""
    left = groups.where(~F.col("key").isin(*alone)) if alone else groups
    left = left.withColumn("bucket", F.expr(f"key div {_IN_BUCKET}"))
    buckets = left.groupBy("bucket").agg(F.sum("bytes").alias("all"))
    # one row for each of the 65,536 values of the first digits at most
    before = F.sum("all").over(Window.orderBy("bucket")) - F.col("all")
    buckets = buckets.select("bucket", before.alias("before"))
    inside = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("key"))
    return (
        left.withColumn("inside", inside)
        .join(buckets, "bucket")
        .select("key", (F.col("before") + F.col("inside")).alias("end"))
    )


def plan_of(rows: DataFrame, n_shards: int, cells: int = CELLS) -> ShardPlan:
    """The plan for `rows` with the columns `key` and `size`."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    # four cells for each stretch that may have to be made finer, so each pass gets further
    cells = max(cells, 4 * n_shards)
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0]
    if not total:
        return ShardPlan(n_shards, 0, (), ())
    alone, capacity, left, shards = [], 0, total, n_shards
    for key, size in groups.orderBy(F.desc("bytes"), "key").limit(n_shards - 1).collect():
        if size * shards < left:
            break
        alone.append(key)
        capacity, left, shards = max(capacity, size), left - size, shards - 1
    if not left:
        return ShardPlan(n_shards, capacity, tuple(alone), ())
    ends = stored(_group_ends(groups, tuple(alone)))
    directory = Directory(_cells(ends, [(1, left)], cells))
    while True:
        low = directory.smallest(left, shards, directory.perhaps)
        high = directory.smallest(left, shards, directory.surely)
        stretches = directory.unclear(low, high, shards)
        if not stretches:
            break
        directory = directory.refined(stretches, _cells(ends, stretches, cells))
    cuts = sorted(set(directory.walk(high, shards, directory.surely)))
    keys = dict(ends.where(F.col("end").isin(*cuts)).select("end", "key").collect())
    return ShardPlan(n_shards, max(capacity, high), tuple(alone), tuple(keys[cut] for cut in cuts))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        text_key(text_col).alias("key"),
    )


def plan_shards(
    docs: DataFrame, n_shards: int = 16, text_col: str = "text", cells: int = CELLS
) -> ShardPlan:
    """Which texts go to which shard; see `assign_shards`."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("bigint").alias("size")
    return plan_of(docs.select(size, text_key(text_col).alias("key")), n_shards, cells)


def assign_shards(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    cells: int = CELLS,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of `docs`.

    A row's size is the UTF-8 bytes of its text plus 1; null counts as an empty text and has the checksum of
    no bytes. Equal texts share a shard, and so, as a group, do two texts whose hash of 60 bits is the same.
    The largest shard is as small as the order of the groups allows; shards may be empty if there are fewer
    groups. Slots count from 0 in each shard, in the order of a hash of the id (rows without an
    id like those with an empty one), ties by text and id; repeated rows have a slot each. An empty table has no rows. Other
    columns are not looked at.
    """
    rows = stored(_rows(docs, id_col, text_col))
    plan = plan_of(rows, n_shards, cells)
    mark = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    placed = rows.withColumns({"shard": plan.shard(F.col("key")), "mark": mark}).withColumn(
        "part", F.substring("mark", 1, _SLOT_DIGITS)
    )
    cell = ["shard", "part"]
    # a row for each of 4,096 parts of a shard at most
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    sizes = sizes.select(*cell, before.alias("before"))
    inside = F.row_number().over(
        Window.partitionBy(*cell).orderBy("mark", "key", "size", "text_crc32", "id")
    )
    return (
        placed.withColumn("inside", inside)
        .join(sizes, cell)
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            "shard",
            (F.col("before") + F.col("inside") - 1).cast("bigint").alias("slot"),
        )
    )


def write_shards(docs: DataFrame, plan: ShardPlan, path: str, text_col: str = "text") -> None:
    """All columns of `docs` as files below `path`/shard=N; one pass, in which no row is moved."""
    shard = plan.shard(text_key(text_col))
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
