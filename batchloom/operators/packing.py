"""Pack ordered items into token-bounded batches, exactly, for jobs of any size.

Plan: one range shuffle of the narrow item columns by (job, order), written as a table of sorted
pieces, then three steps on the pieces as they lie, none of which moves rows again:

1. each piece reports, for every row its first batch could begin at, what it leaves open;
2. the reports, each about the size of one batch, are combined level by level, and the batch open
   where each piece begins is handed down the same levels (see `ordered.piece_entries`);
3. each piece assigns batch numbers from there.

A job may span any number of pieces and a piece may hold any number of jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.operators import pack_kernel as kernel
from batchloom.operators.ordered import (
    PIECE_ROWS,
    entry_of,
    group_breaks,
    group_key,
    map_pieces,
    output_schema,
    piece_entries,
    sorted_runs,
    with_columns,
    with_entries,
)
from batchloom.schemas import PackLimits


def checked_tokens(token_col: str, id_col: str, limits: PackLimits) -> Column:
    """The token column; a job with an item that fits no batch fails with the item's id."""
    tokens = F.col(token_col).cast("bigint")
    message = F.format_string(
        f"work item %s has %s tokens, allowed are 1 to {limits.hard}",
        F.col(id_col).cast("string"),
        F.coalesce(tokens.cast("string"), F.lit("null")),
    )
    fits = F.coalesce((tokens > 0) & (tokens <= limits.hard), F.lit(False))
    return F.when(fits, tokens).otherwise(F.raise_error(message).cast("bigint"))


def pack_items(
    items: DataFrame,
    order_cols: Sequence[str],
    limits: PackLimits,
    *,
    group_cols: Sequence[str] = (),
    id_col: str = "work_item_id",
    token_col: str = "estimated_input_tokens",
    keep: Sequence[str] = (),
    start_index: int = 1,
    prefix: str = "batch",
    partitions: int | None = None,
    piece_rows: int = PIECE_ROWS,
    fanout: int | None = None,
) -> DataFrame:
    """One row per item with `batch_seq`, `batch_id` and `pos` (0-based position in the batch).

    Items are taken in the order of `order_cols`, ties by id. The result has the group, order, id
    and token columns and those in `keep`; they are shuffled and stored, so join texts and metadata
    back by id instead. The sort runs when this is called, as with `DataFrame.checkpoint`.
    """
    group_cols, order_cols = list(group_cols), list(dict.fromkeys([*order_cols, id_col]))
    kept = [name for name in [*group_cols, *order_cols, *keep] if name != token_col]
    kept = list(dict.fromkeys(kept))
    narrow = items.select(*kept, checked_tokens(token_col, id_col, limits).alias(token_col))
    runs = sorted_runs(narrow, group_cols, order_cols, partitions, piece_rows)
    runs = with_entries(runs, _entries(runs, group_cols, token_col, limits, fanout))
    schema = output_schema(runs, {"batch_seq": T.LongType(), "pos": T.LongType()})

    def assign(piece, batches):
        for batch, _, seq, pos in _packed(batches, group_cols, token_col, limits):
            yield with_columns(batch, [seq, pos], schema)

    return _numbered(map_pieces(runs, assign, schema), start_index, prefix)


def pack_totals(
    items: DataFrame,
    order_cols: Sequence[str],
    limits: PackLimits,
    *,
    group_cols: Sequence[str] = (),
    id_col: str = "work_item_id",
    token_col: str = "estimated_input_tokens",
    with_ids: bool = False,
    start_index: int = 1,
    prefix: str = "batch",
    partitions: int | None = None,
    piece_rows: int = PIECE_ROWS,
    fanout: int | None = None,
) -> DataFrame:
    """`batch_totals` of `pack_items`, for plans and reports; `with_ids` as `collect_batches`.

    Each task adds its batches up itself and gives out one row per batch instead of one per item;
    only batches that lie in two pieces, or two Arrow batches, have parts to put together.
    """
    group_cols, order_cols = list(group_cols), list(dict.fromkeys([*order_cols, id_col]))
    kept = list(dict.fromkeys(name for name in [*group_cols, *order_cols] if name != token_col))
    narrow = items.select(*kept, checked_tokens(token_col, id_col, limits).alias(token_col))
    stored = list(dict.fromkeys([*group_cols, token_col, *([id_col] if with_ids else [])]))
    runs = sorted_runs(narrow, group_cols, order_cols, partitions, piece_rows, stored)
    runs = with_entries(runs, _entries(runs, group_cols, token_col, limits, fanout))
    names = [*group_cols, "batch_seq", "tokens", "items"]
    schema = T.StructType(
        [runs.schema[name] for name in group_cols]
        + [T.StructField(name, T.LongType()) for name in names[len(group_cols) :]]
    )
    if with_ids:
        names += ["pos", "ids"]
        schema.add("pos", T.LongType()).add("ids", T.ArrayType(runs.schema[id_col].dataType))

    def add_up(piece, batches):
        for batch, breaks, seq, pos in _packed(batches, group_cols, token_col, limits):
            changes = breaks.copy()
            changes[1:] |= seq[1:] != seq[:-1]
            changes[0] = True
            begins = np.flatnonzero(changes)
            sums = np.add.reduceat(batch.column(token_col).to_numpy(), begins)
            groups = [batch.column(name).take(pa.array(begins)) for name in group_cols]
            counts = np.diff(np.append(begins, batch.num_rows))
            columns = [*groups, *(pa.array(values) for values in (seq[begins], sums, counts))]
            if with_ids:
                ends = pa.array(np.append(begins, batch.num_rows), pa.int32())
                columns += [
                    pa.array(pos[begins]),
                    pa.ListArray.from_arrays(ends, batch.column(id_col)),
                ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    totals = [F.sum("tokens").alias("estimated_input_tokens"), F.sum("items").alias("n_items")]
    if with_ids:
        in_order = F.array_sort(F.collect_list(F.struct("pos", "ids")))
        ids = F.flatten(F.transform(in_order, lambda part: part["ids"]))
        totals = [ids.alias("work_item_ids"), *totals, F.lit("queued").alias("status")]
    parts = _numbered(map_pieces(runs, add_up, schema), start_index, prefix)
    return parts.groupBy(*group_cols, "batch_seq", "batch_id").agg(*totals)


def _packed(batches, group_cols, token_col, limits):
    """(batch, breaks, batch numbers, positions) for the Arrow batches of a piece."""
    packer = key = None
    for batch in batches:
        packer = packer or kernel.Packer(limits, *entry_of(batch))
        breaks = group_breaks(batch, group_cols, key)
        key = group_key(batch, group_cols, batch.num_rows - 1)
        yield batch, breaks, *packer.assign(batch.column(token_col).to_numpy(), breaks)


def _numbered(packed: DataFrame, start_index: int, prefix: str) -> DataFrame:
    number = F.col("batch_seq") + F.lit(start_index - 1).cast("bigint")
    return packed.withColumn("batch_seq", number).withColumn(
        "batch_id", batch_id("batch_seq", prefix)
    )


def pack_items_by(
    items: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    limits: PackLimits,
    **options,
) -> DataFrame:
    """`pack_items` with numbering that begins anew in each group."""
    return pack_items(items, order_cols, limits, group_cols=group_cols, **options)


def batch_id(seq_col: str, prefix: str = "batch") -> Column:
    return F.format_string(prefix + "_%03d", F.col(seq_col))


def _entries(runs, group_cols, token_col, limits, fanout=None) -> DataFrame:
    """Batch that is open (number, tokens, items) at the beginning of each piece."""

    def report(batches):
        first = key = None
        tokens, breaks = [], []
        for batch in batches:
            breaks.append(group_breaks(batch, group_cols, key))
            if first is None:
                first = group_key(batch, group_cols, 0)
            key = group_key(batch, group_cols, batch.num_rows - 1)
            tokens.append(batch.column(token_col).to_numpy())
        return kernel.Report.of(first, key, np.concatenate(tokens), np.concatenate(breaks), limits)

    return piece_entries(
        runs,
        [*group_cols, token_col],
        kernel.Report,
        report,
        lambda one, two: one.then(two, limits),
        lambda job, state, found: found.after(job, *map(np.int64, state), limits),
        (0, 0, 0),
        fanout,
    )


def collect_batches(
    packed: DataFrame,
    group_cols: Sequence[str] = (),
    id_col: str = "work_item_id",
    token_col: str = "estimated_input_tokens",
) -> DataFrame:
    """One row per batch: ordered item ids, token sum, item count. At most `max_items` ids each."""
    ids = F.array_sort(F.collect_list(F.struct("pos", F.col(id_col).alias("id"))))
    return (
        packed.groupBy(*group_cols, "batch_seq", "batch_id")
        .agg(
            F.transform(ids, lambda pair: pair["id"]).alias("work_item_ids"),
            F.sum(token_col).alias("estimated_input_tokens"),
            F.count("*").alias("n_items"),
        )
        .withColumn("status", F.lit("queued"))
    )


def batch_totals(
    packed: DataFrame,
    group_cols: Sequence[str] = (),
    token_col: str = "estimated_input_tokens",
) -> DataFrame:
    """`collect_batches` without the ids: sums that are combined before the shuffle."""
    return packed.groupBy(*group_cols, "batch_seq", "batch_id").agg(
        F.sum(token_col).alias("estimated_input_tokens"), F.count("*").alias("n_items")
    )


def explode_batches(batches: DataFrame, *keep: str) -> DataFrame:
    """One row per (batch, item) with the 0-based position."""
    return batches.select(*keep, F.posexplode("work_item_ids").alias("pos", "work_item_id"))


def batch_fill(
    batches: DataFrame, limits: PackLimits, group_cols: Sequence[str] = ()
) -> DataFrame:
    """How near batches come to the safe target, and how many exceed the hard cap."""
    tokens = F.col("estimated_input_tokens")
    return batches.groupBy(*group_cols).agg(
        F.count("*").alias("n_batches"),
        F.min(tokens).alias("min_tokens"),
        F.max(tokens).alias("max_tokens"),
        F.round(F.avg(tokens / F.lit(float(limits.safe))), 6).alias("avg_fill"),
        F.count_if(tokens >= limits.safe).alias("at_target"),
        F.count_if(tokens > limits.hard).alias("over_cap"),
    )
