"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ERROR_CODE = "BATCH_FAILED"
RETRY_PREFIX = "retry"


def text_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as lower-case hex."""
    return F.sha2(text, 256)


def token_estimate(n_chars: Column) -> Column:
    """Four characters per token, at least one token; for tables that bring no estimate."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n_chars / F.lit(4.0)).cast("bigint"))


def work_item_id(ordinal: Column) -> Column:
    return F.format_string("work_%06d", ordinal)


def numbered_id(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "_%03d", number)


def is_retry_id(batch_id: Column) -> Column:
    return batch_id.startswith(RETRY_PREFIX + "_")


def error_code_or_default(error_code: Column) -> Column:
    return F.coalesce(error_code, F.lit(DEFAULT_ERROR_CODE))


def minute_window(ts: Column, start: datetime) -> Column:
    """Number of the minute since `start` (UTC)."""
    origin = int((start - datetime(1970, 1, 1)).total_seconds())
    return F.floor((F.unix_seconds(ts) - F.lit(origin)) / F.lit(60)).cast("bigint")


def capacity() -> Column:
    """The tokens of the largest batch that a row of the lane table can take now, null if none.

    A lane takes a batch if `can_accept`: exactly those up to this size.
    """
    used = lambda name: F.coalesce(F.col(name), F.lit(0))
    minute = F.col("input_tokens_per_minute") - used("input_tokens_used_current_window")
    day = F.col("daily_token_limit") - used("input_tokens_used_today")
    open_now = (
        (F.col("state") == "ready")
        & (used("requests_used_current_window") + 1 <= F.col("requests_per_minute"))
        & F.coalesce(used("requests_used_today") + 1 <= F.col("daily_request_limit"), F.lit(True))
        & F.col("hard_input_token_cap").isNotNull()
        & minute.isNotNull()
    )
    return F.when(open_now, F.least("hard_input_token_cap", minute, day).cast("bigint"))


def can_accept(lane: Column, tokens: Column) -> Column:
    """May a lane (struct with the lane columns) take a batch of `tokens` now?

    A day limit of null means no limit.
    """

    def within(used: str, extra: Column, limit: str) -> Column:
        return F.coalesce(lane[used], F.lit(0)) + extra <= lane[limit]

    one = F.lit(1)
    return (
        (lane["state"] == F.lit("ready"))
        & (tokens <= lane["hard_input_token_cap"])
        & within("requests_used_current_window", one, "requests_per_minute")
        & within("input_tokens_used_current_window", tokens, "input_tokens_per_minute")
        & F.coalesce(within("requests_used_today", one, "daily_request_limit"), F.lit(True))
        & F.coalesce(within("input_tokens_used_today", tokens, "daily_token_limit"), F.lit(True))
    )
