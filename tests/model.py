"""One-item-at-a-time model of packing, to compare the array kernel with."""

from __future__ import annotations

import random


def one_by_one(tokens, limits):
    """(batch number, position) per item."""
    placed, seq, held = [], 0, []
    for t in tokens:
        total = sum(held) + t
        if held:
            too_big = total > limits.hard or len(held) == limits.max_items
            past_target = total > limits.safe and (
                not limits.allow_overflow or sum(held) >= limits.underfilled_below
            )
            if too_big or past_target or sum(held) >= limits.safe:
                held = []
        seq += not held
        placed.append((seq, len(held)))
        held.append(t)
    return placed


def sizes(tokens, limits):
    """(items, tokens) per batch."""
    batches = {}
    for t, (seq, _) in zip(tokens, one_by_one(tokens, limits)):
        n, total = batches.get(seq, (0, 0))
        batches[seq] = (n + 1, total + t)
    return [batches[seq] for seq in sorted(batches)]


def seeded_tokens(seed, low, high, n):
    rng = random.Random(seed)
    return [rng.randint(low, high) for _ in range(n)]


DEMO_JOB = (42, 517, 862, 9_800)
SMALL_JOB = (123, 621, 759, 700)
