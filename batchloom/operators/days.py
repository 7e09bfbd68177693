"""Spread queues over days under two limits, so many batches and so many tokens a day, for queues of any size.

The same plan as packing (see `packing`): a day is a batch of batches. Here the limits belong to the queue, so
each piece reports with those of its first queue, and rows carry their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.operators import pack_kernel as kernel
from batchloom.operators.ordered import (
    PIECE_ROWS,
    entry_of,
    group_breaks,
    group_key,
    map_pieces,
    piece_entries,
    sorted_runs,
    with_columns,
    with_entries,
)
from batchloom.schemas import PackLimits

NO_LIMIT = 1 << 60
_TOKENS, _REQUESTS = "_day_tokens", "_day_requests"


@dataclass
class DayReport(kernel.Report):
    """A report with the limits of its first run, which are all that two neighbours share."""

    day_tokens: int = NO_LIMIT
    day_requests: int = NO_LIMIT

    def limits(self) -> PackLimits:
        return PackLimits(self.day_tokens, self.day_tokens, self.day_requests, False)

    @classmethod
    def of_rows(cls, first, last, tokens, breaks, limits: kernel.RowLimits) -> DayReport:
        begins = np.flatnonzero(breaks)
        whole = len(begins) == 0
        first_run = tokens if whole else tokens[: begins[0]]
        last_run = tokens if whole else tokens[begins[-1] :]
        own, of_last = limits.at(0), limits.at(len(tokens) - 1)
        head, entries = kernel.head_of(first_run, own)
        ends = kernel.outcomes(last_run, entries if whole else 1, of_last)
        return cls(first, last, whole, len(first_run), head, *ends, own.safe, own.max_items)

    def followed_by(self, other: DayReport) -> DayReport:
        found = self.then(other, other.limits())
        return DayReport(**vars(found), day_tokens=self.day_tokens, day_requests=self.day_requests)


def number_days(
    queues: DataFrame,
    queue_cols: Sequence[str],
    order_cols: Sequence[str],
    *,
    token_col: str = "estimated_input_tokens",
    token_limit_col: str = "daily_token_limit",
    request_limit_col: str = "daily_request_limit",
    partitions: int | None = None,
    piece_rows: int = PIECE_ROWS,
    fanout: int | None = None,
) -> DataFrame:
    """`queues` with `day` and `day_pos`, both 0-based: a day takes what comes next while it fits both limits.

    The limits are the same in all rows of a queue, positive, and null where there is none; tokens are positive and
    no row has more than its queue's limit. `order_cols` order a queue totally.
    """
    queue_cols = list(queue_cols)
    no_limit = F.lit(NO_LIMIT).cast("bigint")
    rows = queues.withColumns(
        {
            token_col: F.col(token_col).cast("bigint"),
            _TOKENS: F.coalesce(F.col(token_limit_col).cast("bigint"), no_limit),
            _REQUESTS: F.coalesce(F.col(request_limit_col).cast("bigint"), no_limit),
        }
    )
    runs = sorted_runs(rows, queue_cols, order_cols, partitions, piece_rows)

    def read(batch):
        limits = kernel.RowLimits(batch.column(_TOKENS).to_numpy(), batch.column(_REQUESTS).to_numpy())
        return batch.column(token_col).to_numpy(), limits

    def report(batches):
        first = key = None
        tokens, breaks, limits = [], [], []
        for batch in batches:
            breaks.append(group_breaks(batch, queue_cols, key))
            if first is None:
                first = group_key(batch, queue_cols, 0)
            key = group_key(batch, queue_cols, batch.num_rows - 1)
            own, limit = read(batch)
            tokens.append(own)
            limits.append(limit)
        limits = kernel.RowLimits(
            np.concatenate([x.safe for x in limits]), np.concatenate([x.max_items for x in limits])
        )
        return DayReport.of_rows(first, key, np.concatenate(tokens), np.concatenate(breaks), limits)

    entries = piece_entries(
        runs,
        [*queue_cols, token_col, _TOKENS, _REQUESTS],
        DayReport,
        report,
        DayReport.followed_by,
        lambda queue, state, found: found.after(queue, *map(np.int64, state), found.limits()),
        (0, 0, 0),
        fanout,
    )
    kept = [rows.schema[name] for name in queues.columns]
    schema = T.StructType(kept + [T.StructField(name, T.LongType()) for name in ("day", "day_pos")])

    def assign(piece, batches):
        packer = key = None
        for batch in batches:
            packer = packer or kernel.Packer(None, *entry_of(batch))
            breaks = group_breaks(batch, queue_cols, key)
            key = group_key(batch, queue_cols, batch.num_rows - 1)
            seq, pos = packer.assign(*read_in(batch, breaks))
            yield with_columns(batch, [seq - 1, pos], schema)

    def read_in(batch, breaks):
        tokens, limits = read(batch)
        return tokens, breaks, limits

    return map_pieces(with_entries(runs, entries), assign, schema)
