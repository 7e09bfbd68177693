"""Ranges of an order that no batch crosses, so that wide rows are moved once.

Batches lie side by side in (job, order, id). Cuts at some of their first items divide that order into ranges;
a row finds its range by binary search among the cuts, where it lies. Narrow queue and wide payload are then
spread by range: the join with the payload and the grouping by batch both happen within one, without another
exchange. How many cuts there are follows the number of partitions, not the data, and never exceeds `MOST_RANGES`
by more than chance, so they travel as one literal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES_PER_PARTITION = 8
MOST_RANGES = 1 << 15
RANGE = "_range"

# values that stay what they are when cuts are written as JSON
_EXACT = (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.DecimalType)


def orderable(schema: T.StructType, columns: Sequence[str]) -> bool:
    """Can cuts be made on these columns? Not on fractions, times of day, binary or nested values."""
    return all(isinstance(schema[name].dataType, (*_EXACT, T.TimestampType)) for name in columns)


def _key(df: DataFrame, columns: Sequence[str]) -> Column:
    """The columns as one value that compares as the order does; nulls come first."""
    parts = []
    for i, name in enumerate(columns):
        value = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, T.TimestampType):
            value = F.unix_micros(value)
        parts.append(value.alias(f"k{i}"))
    return F.struct(*parts)


def find_cuts(
    queue: DataFrame, order_cols: Sequence[str], partitions: int | None = None, place: str = "queue_pos"
) -> tuple[Column, int]:
    """The first items of about evenly many batches each, sorted, as an array literal, and their number.

    `queue` has an item per row, `pos` 0 for the first one of a batch, and `place` counts the batches of a job. Every
    so many batches of a job one is taken, from a place that its hash gives, so a job with most batches gets most
    cuts, and a million jobs of one batch as many as their share.
    """
    spark = queue.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = queue.where("pos = 0")
    step = -(-starts.count() // min(RANGES_PER_PARTITION * partitions, MOST_RANGES)) or 1
    key = _key(queue, order_cols)
    turn = F.pmod(F.pmod(F.xxhash64("job_id"), F.lit(step)) + F.col(place), F.lit(step))
    chosen = starts.where(turn == 0).select(key.alias("key")).orderBy("key")
    kind = chosen.schema["key"].dataType
    texts = [row[0] for row in chosen.select(F.to_json("key")).collect()]
    return F.from_json(F.lit(f"[{','.join(texts)}]"), T.ArrayType(kind)), len(texts)


def range_of(df: DataFrame, order_cols: Sequence[str], cuts: Column, n: int) -> Column:
    """How many of the `n` cuts come at or before each row."""
    key = _key(df, order_cols)
    steps = F.array(*(F.lit(1 << bit) for bit in reversed(range(max(n, 1).bit_length()))))
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.try_element_at(cuts, at + step) <= key, at + step).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))  # never null, so joins need not look it up twice


def join_in_ranges(
    queue: DataFrame,
    payload: DataFrame,
    order_cols: Sequence[str],
    payload_order: Sequence[str],
    keys: Sequence[str] = ("job_id", "work_item_id"),
    partitions: int | None = None,
) -> DataFrame:
    """`queue` with the payload of each item, spread by the column `RANGE`; batches lie whole in a range.

    `order_cols` of the queue and `payload_order` of the payload are the same values for the same item; an item whose
    payload says otherwise gets none. Plan it within `joined_by_range`. The order columns of both are dropped.
    """
    keys = list(keys)
    job, item = keys
    payload = payload.withColumns({name: F.col(name).cast(queue.schema[name].dataType) for name in keys})
    payload = payload.withColumns(
        {
            f"_order{i}": F.col(f"`{name}`").cast(queue.schema[own].dataType)
            for i, (own, name) in enumerate(zip(order_cols, payload_order, strict=True))
        }
    )
    own = [job, *order_cols, item]
    cuts, n = find_cuts(queue, own, partitions)
    theirs = [job, *(f"_order{i}" for i in range(len(order_cols))), item]
    spread = (partitions, RANGE) if partitions else (RANGE,)
    queue = queue.withColumn(RANGE, range_of(queue, own, cuts, n)).drop(*order_cols).repartition(*spread)
    payload = payload.withColumn(RANGE, range_of(payload, theirs, cuts, n))
    payload = payload.drop(*theirs[1:-1], *(c for c in payload_order if c not in keys)).repartition(*spread)
    return queue.join(payload, [RANGE, *keys], "left")


@contextmanager
def joined_by_range(spark: SparkSession) -> Iterator[None]:
    """Lets a join on (range, job, item) use rows that are spread by range only."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
