"""What became of batches and items, and what has to run again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.columns import (
    RETRY_PREFIX,
    error_code_or_default,
    is_retry_id,
    numbered_id,
)
from batchloom.operators.ordered import number_rows
from batchloom.schemas import DEFAULT_MAX_ATTEMPTS, OPEN_BATCH_STATUSES
from batchloom.session import durable

JOB = ("job_id",)
ITEM_KEYS = ("job_id", "work_item_id")
BATCH_KEYS = ("job_id", "batch_id")


# -- status marks ---------------------------------------------------------------------------


def set_status(df: DataFrame, status: str, now: Column, increment: bool = False) -> DataFrame:
    marks = {"status": F.lit(status), "updated_at": now}
    if increment:
        marks["attempt_count"] = F.col("attempt_count") + 1
    return df.withColumns(marks)


def assign_batches(batches: DataFrame, lane_id: Column, now: Column) -> DataFrame:
    return batches.withColumns(
        {
            "lane_id": lane_id,
            "status": F.lit("processing"),
            "started_at": now,
            "attempt_count": F.col("attempt_count") + 1,
        }
    )


def complete_batches(batches: DataFrame, now: Column) -> DataFrame:
    return batches.withColumns(
        {
            "status": F.lit("completed"),
            "completed_at": now,
            "error_code": F.lit(None).cast("string"),
        }
    )


def fail_batches(batches: DataFrame, error_code: Column, now: Column) -> DataFrame:
    return batches.withColumns(
        {
            "status": F.lit("failed"),
            "completed_at": now,
            "error_code": error_code_or_default(error_code),
        }
    )


def apply_status(
    items: DataFrame,
    updates: DataFrame,
    keys: Sequence[str] = ITEM_KEYS,
    increment: bool = False,
) -> DataFrame:
    """Set the status of the named items (`updates`: keys and `status`, one row per key)."""
    new = updates.select(*keys, F.col("status").alias("new_status"))
    touched = F.col("new_status").isNotNull()
    changed = items.join(new, list(keys), "left").withColumn(
        "status", F.coalesce("new_status", "status")
    )
    if increment:
        changed = changed.withColumn(
            "attempt_count", F.col("attempt_count") + F.when(touched, 1).otherwise(0)
        )
    return changed.select(*items.columns)


# -- results --------------------------------------------------------------------------------


def missing_outputs(
    sent: DataFrame, returned: DataFrame, keys: Sequence[str] = ITEM_KEYS
) -> DataFrame:
    """Items that were sent and did not come back."""
    return sent.join(returned.select(*keys), list(keys), "left_anti")


def attach_results(
    batches: DataFrame,
    attempts: DataFrame,
    keys: Sequence[str] = BATCH_KEYS,
    how: str = "inner",
) -> DataFrame:
    """Attempts with the columns of their batch. A batch with very many attempts is split by AQE."""
    return attempts.join(batches, list(keys), how)


def split_retry(
    failed: DataFrame, max_attempts: int = DEFAULT_MAX_ATTEMPTS
) -> tuple[DataFrame, DataFrame]:
    """Failed batches to queue again, and those whose attempts are used up."""
    again = F.col("attempt_count") < max_attempts
    requeued = failed.where(again).withColumns(
        {"status": F.lit("queued"), "lane_id": F.lit(None).cast("string")}
    )
    return requeued, failed.where(~again)


def number_retries(
    df: DataFrame,
    order_cols: Sequence[str],
    group_cols: Sequence[str] = JOB,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Adds `retry_no` and `retry_batch_id`; counting continues after the `existing` batches.

    The retries there are are sorted before the new rows of their job and counted with them, so no
    join by job is needed, whose biggest key could hold most rows.
    """
    rows, order_cols = df, list(order_cols)
    if existing is not None:
        used = existing.where(is_retry_id(F.col("batch_id"))).select(
            *group_cols, F.lit(0).alias("_new")
        )
        rows = df.withColumn("_new", F.lit(1)).unionByName(used, allowMissingColumns=True)
        order_cols = ["_new", *order_cols]
    numbered = number_rows(rows, group_cols, order_cols, "retry_no")
    if existing is not None:
        numbered = numbered.where("_new = 1").drop("_new")
    return numbered.withColumn("retry_batch_id", numbered_id(RETRY_PREFIX, F.col("retry_no")))


def retry_batches(
    missing: DataFrame,
    items: DataFrame | None,
    parents: DataFrame,
    order_cols: Sequence[str] = ("batch_seq",),
    existing: DataFrame | None = None,
) -> DataFrame:
    """A batch of the missing items for each parent batch.

    `missing` has job, batch, item, `pos` and the token estimate, as packed rows do; without the estimate
    it is looked up in `items`, which costs a shuffle of these. The child keeps the parent's
    `attempt_count`, so retries stay bounded over generations of children.

    What is missing is found once, when this is called, and the children are stored without their numbers.
    """
    if items is not None and "estimated_input_tokens" not in missing.columns:
        tokens = items.select(*ITEM_KEYS, "estimated_input_tokens")
        missing = missing.join(tokens, list(ITEM_KEYS))
    ids = F.array_sort(F.collect_list(F.struct("pos", "work_item_id")))
    children = durable(
        missing.groupBy(*BATCH_KEYS).agg(
            F.transform(ids, lambda pair: pair["work_item_id"]).alias("work_item_ids"),
            F.sum("estimated_input_tokens").alias("estimated_input_tokens"),
            F.count("*").alias("n_items"),
        )
    )
    # only the keys of the parents go through the numbering, not the id arrays
    affected = parents.join(children.select(*BATCH_KEYS), list(BATCH_KEYS), "left_semi").select(
        *BATCH_KEYS, *order_cols, "attempt_count"
    )
    numbered = number_retries(affected, order_cols, existing=existing)
    return children.join(numbered, list(BATCH_KEYS)).select(
        "job_id",
        F.col("retry_batch_id").alias("batch_id"),
        F.col("batch_id").alias("parent_batch_id"),
        *order_cols,
        "work_item_ids",
        "estimated_input_tokens",
        "n_items",
        "attempt_count",
        F.lit("queued").alias("status"),
    )


def next_round(untouched: DataFrame, requeued: DataFrame, children: DataFrame) -> DataFrame:
    """The queue after a round: what did not run (`queue_part` 0), then what has to run again (1).

    All three need `queue_pos`, for children that of the parent: a result puts either its failed
    batch or its missing items at the tail, so these two interleave in the order of the results.
    Order by `queue_part`, `queue_pos`. A batch queued twice with one attempt count appears once, at
    its first place.
    """
    parts = [
        part.withColumn("queue_part", F.lit(number))
        for part, number in ((untouched, 0), (requeued, 1), (children, 1))
    ]
    queue = parts[0].unionByName(parts[1], allowMissingColumns=True)
    queue = queue.unionByName(parts[2], allowMissingColumns=True)
    keys = [*BATCH_KEYS, "attempt_count"]
    first = F.min_by(
        F.struct(*[name for name in queue.columns if name not in keys]),
        F.struct("queue_part", "queue_pos"),
    )
    return queue.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*queue.columns)


# -- resume ---------------------------------------------------------------------------------


def split_resumable(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches to run again after a restart, and finished ones."""
    unfinished = F.col("status").isin(*OPEN_BATCH_STATUSES)
    return batches.where(unfinished), batches.where(~unfinished)


def skip_completed(
    items: DataFrame, completed: DataFrame, keys: Sequence[str] = ITEM_KEYS
) -> DataFrame:
    return items.join(completed.select(*keys), list(keys), "left_anti")


def reconcile_by_hash(
    stored: DataFrame, resubmitted: DataFrame, keys: Sequence[str] = ITEM_KEYS
) -> DataFrame:
    """Compare resubmitted records with stored items: match, changed, new or absent."""
    keys = list(keys)
    left = stored.select(*keys, F.col("input_text_hash").alias("stored_hash"), F.lit(1).alias("s"))
    right = resubmitted.select(
        *keys, F.col("input_text_hash").alias("resubmitted_hash"), F.lit(1).alias("r")
    )
    verdict = (
        F.when(F.col("r").isNull(), "absent")
        .when(F.col("s").isNull(), "new")
        .when(F.col("stored_hash").eqNullSafe(F.col("resubmitted_hash")), "match")
        .otherwise("changed")
    )
    return left.join(right, keys, "full_outer").select(
        *keys, "stored_hash", "resubmitted_hash", verdict.alias("verdict")
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    small_source: bool = False,
) -> DataFrame:
    """Insert rows of `source`, and for known keys update only `update_cols`.

    Both sides have one row per key and the same columns. Write the result to a new version.
    One full outer join, which shuffles both sides once. With `small_source` it becomes a left join
    plus the new rows: Spark then broadcasts the source, if its size allows, and leaves a big
    target where it is; the result is the same whatever the size.
    """
    keys = list(keys)
    others = [name for name in target.columns if name not in keys]
    s = source.select(
        *keys, F.lit(True).alias("_given"), *(F.col(name).alias(f"_new_{name}") for name in others)
    )

    def merged(name: str, known: Column | None) -> Column:
        take_new = F.col("_given").isNotNull()
        if name not in update_cols:
            take_new = F.lit(False) if known is None else take_new & known.isNull()
        return F.when(take_new, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    if not small_source:
        t = target.withColumn("_known", F.lit(True))
        joined = t.join(s, keys, "full_outer")
        return joined.select(*keys, *(merged(name, F.col("_known")) for name in others)).select(
            *target.columns
        )
    updated = target.join(s, keys, "left").select(*keys, *(merged(name, None) for name in others))
    known = target.select(*keys).join(source.select(*keys), keys, "left_semi")
    new = source.join(known, keys, "left_anti")
    return updated.select(*target.columns).unionByName(new.select(*target.columns))


def latest_per_key(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The row with the highest `by` per key; rows are combined before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.col(by)).alias("row")).select("row.*")


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    return latest_per_key(checkpoints, JOB, "checkpoint_id")
