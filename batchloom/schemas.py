"""Table layouts, allowed values and packing limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Statuses and states, as stored.
WORK_STATUSES = ("pending", "batched", "processing", "completed", "failed", "missing")
BATCH_STATUSES = (
    "pending",
    "queued",
    "processing",
    "completed",
    "failed",
    "partially_completed",
    "retry_pending",
)
LANE_STATES = ("ready", "processing", "cooldown", "quota_exhausted", "failed", "disabled")
JOB_STATUSES = ("pending", "running", "completed", "failed", "partially_completed")
ATTEMPT_STATUSES = ("succeeded", "failed", "partially_succeeded")

OPEN_BATCH_STATUSES = ("queued", "pending", "retry_pending", "processing")
TERMINAL_BATCH_STATUSES = ("completed", "failed", "partially_completed")

DEFAULT_MAX_ATTEMPTS = 3


@dataclass(frozen=True)
class PackLimits:
    """Token and item limits of one batch."""

    safe: int = 225_000
    hard: int = 240_000
    max_items: int = 500
    allow_overflow: bool = True

    def __post_init__(self) -> None:
        if self.safe <= 0 or self.hard <= 0 or self.max_items <= 0:
            raise ValueError("safe, hard and max_items must be positive")
        if self.safe > self.hard:
            raise ValueError("safe must be <= hard")

    @property
    def underfilled_below(self) -> int:
        """A batch with fewer tokens may still take an item that crosses the safe target."""
        return int(self.safe * 0.90)


def struct_type(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()

JOBS = struct_type(
    job_id=_S,
    job_type=_S,
    status=_S,
    total_work_items=_L,
    completed_work_items=_L,
    failed_work_items=_L,
    missing_outputs=_L,
    total_estimated_input_tokens=_L,
    created_at=_TS,
    updated_at=_TS,
)
WORK_ITEMS = struct_type(
    job_id=_S,
    work_item_id=_S,
    ord=_L,
    external_id=_S,
    input_text_hash=_S,
    estimated_input_tokens=_L,
    metadata_json=_S,
    status=_S,
    attempt_count=_I,
    created_at=_TS,
    updated_at=_TS,
)
BATCHES = struct_type(
    job_id=_S,
    batch_id=_S,
    batch_seq=_L,
    lane_id=_S,
    work_item_ids=T.ArrayType(_S),
    estimated_input_tokens=_L,
    n_items=_L,
    status=_S,
    attempt_count=_I,
    parent_batch_id=_S,
    error_code=_S,
    created_at=_TS,
    started_at=_TS,
    completed_at=_TS,
)
LANES = struct_type(
    lane_id=_S,
    provider=_S,
    model=_S,
    api_key_env_name=_S,
    requests_per_minute=_L,
    input_tokens_per_minute=_L,
    safe_input_token_target=_L,
    hard_input_token_cap=_L,
    daily_request_limit=_L,
    daily_token_limit=_L,
    state=_S,
    cooldown_until_window=_L,
    requests_used_current_window=_L,
    input_tokens_used_current_window=_L,
    requests_used_today=_L,
    input_tokens_used_today=_L,
    last_request_window=_L,
    failure_count=_L,
)
ATTEMPTS = struct_type(
    attempt_id=_L,
    job_id=_S,
    batch_id=_S,
    lane_id=_S,
    attempt_number=_I,
    virtual_window=_L,
    status=_S,
    error_code=_S,
    input_tokens=_L,
    created_at=_TS,
)
EVENT_LOG = struct_type(
    event_id=_L,
    job_id=_S,
    event_type=_S,
    message=_S,
    lane_id=_S,
    batch_id=_S,
    virtual_window=_L,
    details_json=_S,
    details_unparsed=T.BooleanType(),
    created_at=_TS,
)
# A checkpoint is one row of counts per job plus one row per batch; the ids of a big job would
# not fit into one array.
CHECKPOINTS = struct_type(
    checkpoint_id=_L,
    job_id=_S,
    virtual_window=_L,
    queued_batches=_L,
    terminal_batches=_L,
    completed_work_items=_L,
    failed_work_items=_L,
    missing_outputs=_L,
    created_at=_TS,
)
CHECKPOINT_BATCHES = struct_type(checkpoint_id=_L, job_id=_S, batch_id=_S, kind=_S)

TABLES = {
    "jobs": JOBS,
    "work_items": WORK_ITEMS,
    "batches": BATCHES,
    "lanes": LANES,
    "batch_attempts": ATTEMPTS,
    "scheduler_events": EVENT_LOG,
    "checkpoints": CHECKPOINTS,
    "checkpoint_batches": CHECKPOINT_BATCHES,
}

# The columns an upsert changes in rows that exist; the others keep the first value.
UPDATE_COLS = {
    "jobs": (
        "status",
        "total_work_items",
        "completed_work_items",
        "failed_work_items",
        "missing_outputs",
        "total_estimated_input_tokens",
        "updated_at",
    ),
    "work_items": (
        "estimated_input_tokens",
        "metadata_json",
        "status",
        "attempt_count",
        "updated_at",
    ),
    "batches": (
        "lane_id",
        "work_item_ids",
        "estimated_input_tokens",
        "n_items",
        "status",
        "attempt_count",
        "parent_batch_id",
        "error_code",
        "started_at",
        "completed_at",
    ),
    "lanes": (
        "state",
        "cooldown_until_window",
        "requests_used_current_window",
        "input_tokens_used_current_window",
        "requests_used_today",
        "input_tokens_used_today",
        "last_request_window",
        "failure_count",
    ),
}


def as_table(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table in its types; those `df` lacks are null, unknown ones an error."""
    schema = TABLES[table]
    unknown = set(df.columns) - set(schema.fieldNames())
    if unknown:
        raise ValueError(f"{table} has no columns {sorted(unknown)}")
    return df.select(
        *(
            (F.col(field.name) if field.name in df.columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in schema.fields
        )
    )
