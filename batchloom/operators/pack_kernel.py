"""Array arithmetic behind the packing operator.

A batch is closed by what it holds and by the next item, so its end follows from its first item
alone. With prefix sums of the tokens that end is one binary search, done for all rows at once.
All functions work on the rows of one task; see `packing` for how tasks are put together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from batchloom.schemas import PackLimits


class RowLimits:
    """Limits that differ by row, but not within a run; nothing is taken beyond either of them."""

    allow_overflow = False

    def __init__(self, tokens: np.ndarray, items: np.ndarray):
        self.safe = self.hard = tokens
        self.max_items = items

    def at(self, row: int) -> PackLimits:
        tokens = int(self.safe[row])
        return PackLimits(tokens, tokens, int(self.max_items[row]), False)


def limits_at(limits: PackLimits | RowLimits, row: int) -> PackLimits:
    return limits.at(row) if isinstance(limits, RowLimits) else limits


def prefix_sums(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.cumsum(tokens, out=out[1:])
    return out


def run_ends(breaks: np.ndarray) -> np.ndarray:
    """For each row the end (exclusive) of its run; `breaks[i]` says row i begins a new run."""
    n = len(breaks)
    begins = np.flatnonzero(breaks)
    ends = np.append(begins, n)
    return ends[np.searchsorted(begins, np.arange(n), side="right")]


def _takes_crossing_item(total, before, limits: PackLimits):
    """May a batch holding `before` take the item that lifts it to `total` >= safe?"""
    fits = total == limits.safe
    if limits.allow_overflow:
        fits |= (total <= limits.hard) & (before < limits.underfilled_below)
    return fits


def next_starts(prefix: np.ndarray, ends: np.ndarray, limits: PackLimits) -> np.ndarray:
    """Where the batch after the one that begins at row i begins, for every i."""
    n = len(ends)
    rows = np.arange(n)
    base = prefix[:-1]
    reach = np.searchsorted(prefix, base + limits.safe, side="left")
    stop = np.minimum(rows + limits.max_items, ends)
    at = np.minimum(reach, n)
    take = (at == rows + 1) | _takes_crossing_item(prefix[at] - base, prefix[at - 1] - base, limits)
    return np.where(reach > stop, stop, np.where(take, reach, reach - 1))


def joining_rows(prefix: np.ndarray, length: int, tokens, items, limits: PackLimits):
    """How many of the first `length` rows still go into an open batch of `tokens` / `items`."""
    if length == 0:
        return np.zeros_like(items)
    room = np.minimum(limits.max_items - items, length)
    reach = np.searchsorted(prefix[: length + 1], limits.safe - tokens, side="left")
    at = np.minimum(reach, length)
    take = _takes_crossing_item(tokens + prefix[at], tokens + prefix[at - 1], limits)
    return np.where(reach > room, room, np.where(take, reach, reach - 1))


def still_open(tokens, items, limits: PackLimits):
    """Open state of the last batch; a full batch leaves nothing open."""
    full = (tokens >= limits.safe) | (items >= limits.max_items)
    return np.where(full, 0, tokens), np.where(full, 0, items)


def head_of(tokens: np.ndarray, limits: PackLimits) -> tuple[np.ndarray, int]:
    """The rows that decide where a batch left open before them ends, and how many rows of the run
    the next batch could begin at. Both are about the size of one batch, however long the run."""
    head = tokens[: limits.max_items]
    prefix = prefix_sums(head)
    entries = min(len(head), int(np.searchsorted(prefix[1:], limits.hard, side="left")) + 1)
    return head[: int(np.searchsorted(prefix, limits.safe, side="left"))], entries


def outcomes(tokens: np.ndarray, entries: int, limits: PackLimits):
    """Pack one run of rows once for each first start 0 .. entries-1.

    Returns per entry the number of batches begun and the tokens and items left open at the end.
    """
    n = len(tokens)
    prefix = prefix_sums(tokens)
    after = next_starts(prefix, np.full(n, n), limits)
    # follow all chains at once by doubling; the last start of a chain points to itself
    jump = np.where(after < n, after, np.arange(n))
    steps = (after < n).astype(np.int64)
    while True:
        head = jump[:entries]
        if (jump[head] == head).all():
            break
        steps = steps + steps[jump]
        jump = jump[jump]
    last = jump[:entries]
    open_tokens, open_items = still_open(prefix[n] - prefix[last], n - last, limits)
    return steps[:entries] + 1, open_tokens, open_items


@dataclass
class Report:
    """What a stretch of rows does to the batches of the job that runs through it.

    `first` and `last` are the jobs it begins and ends with; `whole` says they are one run. `head`
    and `n_rows` describe its first run. `begun`, `open_tokens` and `open_items` are `outcomes` of
    its last run, for each entry if it is whole.
    """

    first: str
    last: str
    whole: bool
    n_rows: int
    head: np.ndarray
    begun: np.ndarray
    open_tokens: np.ndarray
    open_items: np.ndarray

    @classmethod
    def of(cls, first: str, last: str, tokens: np.ndarray, breaks: np.ndarray, limits: PackLimits):
        begins = np.flatnonzero(breaks)
        whole = len(begins) == 0
        first_run = tokens if whole else tokens[: begins[0]]
        last_run = tokens if whole else tokens[begins[-1] :]
        head, entries = head_of(first_run, limits)
        # a later run begins with a new batch; the only run may begin anywhere in its head
        ends = outcomes(last_run, entries if whole else 1, limits)
        return cls(first, last, whole, len(first_run), head, *ends)

    def after(self, job, seq, tokens, items, limits: PackLimits):
        """Batches begun in the last job, and tokens and items left open, after these rows.

        The arguments say the same of the rows before; they may be arrays of possibilities.
        """
        if not self.whole or job != self.first:
            return self.begun[0], self.open_tokens[0], self.open_items[0]
        prefix = prefix_sums(self.head)
        joined = joining_rows(prefix, len(self.head), tokens, items, limits)
        start = np.where(items > 0, joined, 0)
        all_joined = start == self.n_rows
        entry = np.where(all_joined, 0, start)
        open_tokens, open_items = still_open(tokens + prefix[-1], items + len(self.head), limits)
        return (
            seq + np.where(all_joined, 0, self.begun[entry]),
            np.where(all_joined, open_tokens, self.open_tokens[entry]),
            np.where(all_joined, open_items, self.open_items[entry]),
        )

    def then(self, other: Report, limits: PackLimits) -> Report:
        """The report of these rows followed by those of `other`."""
        goes_on = self.whole and other.first == self.last
        n_rows, head = self.n_rows, self.head
        if goes_on:
            n_rows += other.n_rows
            if len(head) == self.n_rows:
                head, _ = head_of(np.concatenate((head, other.head)), limits)
        own = (self.begun, self.open_tokens, self.open_items)
        if goes_on and other.whole:
            ends = other.after(self.last, *own, limits)
            if len(self.begun) == self.n_rows:
                theirs = (other.begun, other.open_tokens, other.open_items)
                ends = tuple(np.concatenate(pair) for pair in zip(ends, theirs))
        else:
            ends = other.after(self.last, *(part[0] for part in own), limits)
            ends = tuple(np.array([value]) for value in ends)
        return Report(
            self.first, other.last, goes_on and other.whole, n_rows, head, *map(np.asarray, ends)
        )


class Packer:
    """Assign batch numbers to rows that arrive in order, piece by piece."""

    def __init__(self, limits: PackLimits | None, seq: int = 0, tokens: int = 0, items: int = 0):
        self.limits = limits
        self.seq, self.tokens, self.items = seq, tokens, items

    def assign(
        self, tokens: np.ndarray, breaks: np.ndarray, limits: RowLimits | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Batch number (1, 2, .. in each run) and position in the batch for every row."""
        n = len(tokens)
        limits = self.limits if limits is None else limits
        prefix = prefix_sums(tokens)
        if breaks[0]:
            self.seq = self.tokens = self.items = 0
        begins = np.flatnonzero(breaks)
        ends = run_ends(breaks)
        joined = 0
        if self.items:
            joined = int(
                joining_rows(
                    prefix,
                    int(ends[0]),
                    np.int64(self.tokens),
                    np.int64(self.items),
                    limits_at(limits, 0),
                )
            )
        after = next_starts(prefix, ends, limits).tolist()
        starts = []
        row = joined
        while row < n:
            starts.append(row)
            row = after[row]

        starts = np.array(starts, dtype=np.int64)
        is_start = np.zeros(n, dtype=np.int64)
        is_start[starts] = 1
        begun = np.cumsum(is_start)
        # batches begun before each run: numbering restarts with it
        run = np.searchsorted(begins, np.arange(n), side="right")
        earlier = np.concatenate(([-self.seq], begun[begins] - 1))
        seq = begun - earlier[run]
        rows = np.arange(n)
        position = np.where(
            begun > 0, rows - np.append(starts, 0)[begun - 1], rows + self.items
        )

        if len(starts):
            open_tokens, open_items = prefix[n] - prefix[starts[-1]], n - starts[-1]
        else:
            open_tokens, open_items = self.tokens + prefix[n], self.items + n
        open_tokens, open_items = still_open(open_tokens, open_items, limits_at(limits, n - 1))
        self.seq, self.tokens, self.items = int(seq[-1]), int(open_tokens), int(open_items)
        return seq, position
