"""Order-sensitive work without one task per group.

`Window.partitionBy(group).orderBy(..)` sorts each group in one task, which fails when a group
holds a large part of the table. Here rows are range-partitioned by (group, order), so that any
group spreads over as many tasks as it needs, and written once as a table of sorted pieces. Each
piece reports what it does to what comes before it. Reports combine associatively: `FANOUT`
neighbours become one, level by level, until one is left; on the way back each block hands its
entry down to its members. Every level is a table, no task sees more than `FANOUT` reports of a
block, and a piece gets its entry by a join, so nothing is carried through the driver.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.session import durable, new_folder

ROW = "_row"
ENTRY = "_entry_"
PIECE_ROWS = 1 << 19
# smaller pieces share a file of about so many rows
FILE_ROWS = 1 << 16
FANOUT = 64
_NEVER = (1 << 63) - 1
_ROW_GROUP_BYTES = 1 << 29
# monotonically_increasing_id: partition number above, position in the partition below
PARTITION_SHIFT = 33
_POSITION = (1 << PARTITION_SHIFT) - 1


def order_items(df: DataFrame, *order_cols: str, partitions: int | None = None) -> DataFrame:
    """Total order over all partitions: ranges across them, sorted inside each."""
    if not order_cols:
        raise ValueError("give the columns that order the rows")
    ranges = [partitions] if partitions else []
    return df.repartitionByRange(*ranges, *order_cols).sortWithinPartitions(*order_cols)


def sorted_runs(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    partitions: int | None = None,
    piece_rows: int = PIECE_ROWS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows in (group, order) order as a table in the shared folder, a file for one piece or for
    several small ones, so that the number of files follows the rows and not the pieces.

    Written, because range boundaries come from sampling and a recomputed stage could draw others.
    A file is one row group, which a scan never divides, and holds whole pieces, so a piece is read
    whole and in order by one task however the scan is split. `ROW` increases over the whole table.
    Only `columns` are stored, if given.
    """
    columns = list(columns or df.columns)
    ordered = order_items(df, *group_cols, *order_cols, partitions=partitions)
    folder = new_folder(df.sparkSession, "runs")
    (
        ordered.select(*columns, F.monotonically_increasing_id().alias(ROW))
        .write.option("maxRecordsPerFile", piece_rows * max(1, FILE_ROWS // piece_rows))
        .option("parquet.block.size", _ROW_GROUP_BYTES)
        .parquet(folder)
    )
    runs = df.sparkSession.read.schema(
        T.StructType([*(df.schema[name] for name in columns), T.StructField(ROW, T.LongType())])
    ).parquet(folder)
    return runs.withMetadata(ROW, {"piece_rows": piece_rows})


def group_breaks(batch: pa.RecordBatch, group_cols: Sequence[str], before: str | None):
    """Flags for rows whose group differs from the row above; `before` is the last row's key."""
    n = batch.num_rows
    breaks = np.zeros(n, dtype=bool)
    for name in group_cols:
        column = batch.column(name)
        below, above = column.slice(1), column.slice(0, n - 1)
        same = pc.fill_null(pc.equal(below, above), False)
        both_null = pc.and_(pc.is_null(below), pc.is_null(above))
        breaks[1:] |= ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
    breaks[0] = before is not None and before != group_key(batch, group_cols, 0)
    return breaks


def group_key(batch: pa.RecordBatch, group_cols: Sequence[str], row: int) -> str:
    """The group of a row as text that can be compared and shipped."""
    return json.dumps([batch.column(name)[row].as_py() for name in group_cols], default=str)


def map_pieces(
    runs: DataFrame, fn: Callable[[int, Iterator[pa.RecordBatch]], Iterator], schema: T.StructType
) -> DataFrame:
    """Run `fn(piece, batches)` over each piece of `sorted_runs`; pieces are numbered in order."""
    piece_rows = runs.schema[ROW].metadata["piece_rows"]

    def slices(batches):
        last = None
        for batch in batches:
            rows = batch.column(ROW).to_numpy()
            pieces = rows - (rows & _POSITION) % piece_rows
            cuts = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(rows)]
            for begin, end in zip(cuts, cuts[1:]):
                if end == begin:
                    continue
                piece = int(pieces[begin])
                if piece != last and rows[begin] != piece:
                    raise RuntimeError("a piece was read in parts; use fewer rows per piece")
                last = piece
                yield piece, batch.slice(begin, end - begin)

    def run(batches):
        for piece, part in groupby(slices(batches), key=lambda pair: pair[0]):
            yield from fn(piece, (batch for _, batch in part))

    return runs.mapInArrow(run, schema)


def output_schema(runs: DataFrame, added: Mapping[str, T.DataType]) -> T.StructType:
    hidden = {ROW, *entry_columns(runs.columns)}
    kept = [field for field in runs.schema.fields if field.name not in hidden]
    return T.StructType(kept + [T.StructField(name, kind) for name, kind in added.items()])


def with_columns(batch: pa.RecordBatch, added: Sequence[np.ndarray], schema: T.StructType):
    """`batch` without the row number and with `added` behind it."""
    names = schema.fieldNames()
    kept = names[: len(names) - len(added)]
    arrays = [batch.column(name) for name in kept] + [pa.array(values) for values in added]
    return pa.RecordBatch.from_arrays(arrays, names=names)


_NODE = "part bigint, place bigint, report binary"
_STATE = "part bigint, place bigint, job string, state array<bigint>"


def piece_entries(
    runs: DataFrame,
    columns: Sequence[str],
    kind: type,
    report: Callable[[Iterator[pa.RecordBatch]], object],
    combine: Callable[[object, object], object],
    after: Callable[[str | None, list[int], object], list[int]],
    start: Sequence[int],
    fanout: int | None = None,
) -> DataFrame:
    """The state that holds where each piece begins: `piece` and a long column per field of the state.

    `report(batches)` describes a piece, read with `columns` only, as a `kind` (a class made from its
    fields by name); it has the groups it begins and ends with as `first` and `last`. `combine` describes two neighbours as one, and `after(group,
    state, report)` is the state behind a report when `state` held for `group` before it. Where a
    group begins, the state is `start`.
    """
    fanout = fanout or FANOUT
    piece_rows = runs.schema[ROW].metadata["piece_rows"]
    start = list(start)

    def describe(piece, batches):
        found = pickle.dumps(vars(report(batches)))
        part, place = piece >> PARTITION_SHIFT, (piece & _POSITION) // piece_rows
        yield pa.RecordBatch.from_pydict({"part": [part], "place": [place], "report": [found]})

    level = durable(map_pieces(runs.select(*dict.fromkeys(columns), ROW), describe, _NODE))
    parts, places = level.agg(F.max("part"), F.max("place")).first()
    # pieces of one partition come together first, then neighbouring partitions
    levels, parts, places = [level], parts or 0, places or 0
    while parts or places:
        across = not places
        parts, places = (parts // fanout, 0) if across else (parts, places // fanout)
        block = F.expr(f"part div {fanout}") if across else F.col("part")
        block_place = F.lit(0).cast("bigint") if across else F.expr(f"place div {fanout}")
        level = level.withColumns({"block": block, "block_place": block_place})
        levels[-1] = level
        level = durable(_by_block(level).mapInArrow(_combined(kind, combine), _NODE))
        levels.append(level)
    states = levels.pop().select(
        "part",
        "place",
        F.lit(None).cast("string").alias("job"),
        F.array(*[F.lit(x).cast("bigint") for x in start]).alias("state"),
    )
    for level in reversed(levels):
        above = states.select(
            F.col("part").alias("block"), F.col("place").alias("block_place"), "job", "state"
        )
        # no join: Spark may read its shuffle by mapper, and would then take the blocks apart, as it
        # leaves out a repartition by the columns of the join
        both = level.unionByName(above, allowMissingColumns=True)
        states = _by_block(both).mapInArrow(_walked(kind, after, start), _STATE)
    piece = F.shiftleft("part", PARTITION_SHIFT) + F.col("place") * piece_rows
    # as files, whose size the planner knows when it joins them to the pieces
    folder = new_folder(runs.sparkSession, "entries")
    fields = [F.col("state")[i].alias(f"{ENTRY}{i}") for i in range(len(start))]
    found = states.select(piece.alias("piece"), *fields)
    found.write.parquet(folder)
    return runs.sparkSession.read.schema(found.schema).parquet(folder)


def _by_block(level: DataFrame) -> DataFrame:
    block = ["block", "block_place"]
    return level.repartition(*block).sortWithinPartitions(*block, "part", "place")


def _members(batches):
    """(block, members in order) as dicts."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: (row["block"], row["block_place"]))


def _combined(kind, combine):
    def run(batches):
        for (part, place), members in _members(batches):
            found = None
            for row in members:
                own = kind(**pickle.loads(row["report"]))
                found = own if found is None else combine(found, own)
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "place": [place], "report": [pickle.dumps(vars(found))]}
            )

    return run


def _walked(kind, after, start):
    schema = pa.schema(
        [("part", pa.int64()), ("place", pa.int64()), ("job", pa.string()), ("state", pa.list_(pa.int64()))]
    )

    def run(batches):
        for block, members in _members(batches):
            # what holds where the block begins has no part and is sorted before its members
            entry = next(members)
            if entry["part"] is not None:
                raise RuntimeError(f"block {block} has no entry")
            job, state = entry["job"], entry["state"]
            found_states = []
            for row in members:
                found = kind(**pickle.loads(row["report"]))
                if found.first != job:
                    state = start
                place = {"part": row["part"], "place": row["place"]}
                found_states.append({**place, "job": found.first, "state": state})
                state = [int(x) for x in after(job, state, found)]
                job = found.last
            yield pa.RecordBatch.from_pylist(found_states, schema=schema)

    return run


def entry_columns(names: Sequence[str]) -> list[str]:
    return [name for name in names if name.startswith(ENTRY) and name[len(ENTRY) :].isdigit()]


def with_entries(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """`runs` with the entry of each piece in its first row; pieces stay whole and sorted.

    An outer join, so that Spark may send the entries around, if they are small, but never the rows.
    The fields of an entry are longs, null in all other rows: an array in each row would cost Arrow
    many times what the rows themselves do.
    """
    piece_rows = runs.schema[ROW].metadata["piece_rows"]
    position = F.col(ROW).bitwiseAND(F.lit(_POSITION))
    joined = runs.withColumn("_piece", F.col(ROW) - position % piece_rows).join(
        entries.withColumnRenamed("piece", "_piece"), "_piece", "left"
    )
    is_first = F.col(ROW) == F.col("_piece")
    fields = [F.when(is_first, F.col(name)).alias(name) for name in entry_columns(entries.columns)]
    kept = joined.select(*runs.columns, *fields).sortWithinPartitions(ROW)
    return kept.withMetadata(ROW, {"piece_rows": piece_rows})


def entry_of(batch: pa.RecordBatch) -> list[int]:
    """The entry of a piece, from its first batch."""
    names = entry_columns(batch.schema.names)
    return [batch.column(f"{ENTRY}{i}")[0].as_py() for i in range(len(names))]


@dataclass
class Totals:
    """Groups that a stretch of rows begins and ends with, if they are one run, and what the last
    group's rows come to: `n_sums` sums, then minima."""

    first: str
    last: str
    whole: bool
    values: list[int]
    n_sums: int

    def _added(self, before: list[int], more: list[int]) -> list[int]:
        pairs = list(zip(before, more))
        return [a + b for a, b in pairs[: self.n_sums]] + [min(p) for p in pairs[self.n_sums :]]

    def then(self, other: Totals) -> Totals:
        same = other.whole and self.last == other.first
        values = self._added(self.values, other.values) if same else other.values
        return Totals(self.first, other.last, self.whole and same, values, self.n_sums)

    def after(self, group: str | None, state: list[int]) -> list[int]:
        """Values of the last group, if `state` holds those of `group` before these rows."""
        if self.whole and group == self.first:
            return self._added(state, self.values)
        return self.values


def running(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    count_col: str = "rn",
    sums: Mapping[str, str] | None = None,
    partitions: int | None = None,
    piece_rows: int = PIECE_ROWS,
    fanout: int | None = None,
    minima: Mapping[str, str] | None = None,
) -> DataFrame:
    """1, 2, .. and running sums (`sums` = {new column: long column}) inside each group.

    `order_cols` must order the rows of a group totally. Nulls count as 0 in sums. `minima` are running
    minima in the same way, null until a value was seen.
    """
    sums, minima = dict(sums or {}), dict(minima or {})
    group_cols = list(group_cols)
    inputs, lows = list(sums.values()), list(minima.values())
    n_sums = 1 + len(inputs)
    runs = sorted_runs(df, group_cols, order_cols, partitions, piece_rows)
    schema = output_schema(
        runs, {name: T.LongType() for name in [count_col, *sums, *minima]}
    )

    start = [0] * n_sums + [_NEVER] * len(lows)

    def totals(batches):
        first = key = None
        whole, last = True, list(start)
        for batch in batches:
            breaks = group_breaks(batch, group_cols, key)
            if first is None:
                first = group_key(batch, group_cols, 0)
            key = group_key(batch, group_cols, batch.num_rows - 1)
            begin = 0
            if breaks.any():
                whole, begin = False, int(np.flatnonzero(breaks)[-1])
                last = list(start)
            last[0] += batch.num_rows - begin
            for i, name in enumerate(inputs, 1):
                last[i] += pc.sum(batch.column(name).slice(begin), min_count=0).as_py()
            for i, name in enumerate(lows, n_sums):
                low = pc.min(batch.column(name).slice(begin)).as_py()
                last[i] = last[i] if low is None else min(last[i], low)
        return Totals(first, key, whole, last, n_sums)

    entries = piece_entries(
        runs,
        [*group_cols, *inputs, *lows],
        Totals,
        totals,
        Totals.then,
        lambda group, state, found: found.after(group, state),
        start,
        fanout,
    )

    def number(piece, batches):
        key = carried = None
        for batch in batches:
            carried = carried or entry_of(batch)
            n = batch.num_rows
            breaks = group_breaks(batch, group_cols, key)
            key = group_key(batch, group_cols, n - 1)
            begins = np.flatnonzero(breaks)
            run = np.searchsorted(begins, np.arange(n), side="right")
            values = [np.ones(n, dtype=np.int64)] + [
                pc.fill_null(batch.column(name).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                for name in inputs
            ]
            added = []
            for i, value in enumerate(values):
                total = np.cumsum(value)
                earlier = np.concatenate(([-carried[i]], total[begins] - value[begins]))
                added.append(total - earlier[run])
            for i, name in enumerate(lows, n_sums):
                low = pc.fill_null(batch.column(name).cast(pa.int64()), _NEVER)
                low = low.to_numpy(zero_copy_only=False).copy()
                if not breaks[0]:
                    low[0] = min(low[0], carried[i])
                added.append(pd.Series(low).groupby(run).cummin().to_numpy())
            carried = [int(column[-1]) for column in added]
            yield with_columns(batch, added, schema)

    found = map_pieces(with_entries(runs, entries), number, schema)
    seen = {name: F.nullif(F.col(name), F.lit(_NEVER)) for name in minima}
    return found.withColumns(seen) if seen else found


def number_rows(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], name: str = "rn", **kw
) -> DataFrame:
    """`row_number()` per group that also works when one group holds most rows."""
    return running(df, group_cols, order_cols, count_col=name, **kw)
