"""Counts, quota use and reports over items, batches, attempts and the event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.operators.ordered import number_rows, running
from batchloom.schemas import OPEN_BATCH_STATUSES, TERMINAL_BATCH_STATUSES, as_table

JOB = ("job_id",)


def _with_status(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def job_totals(items: DataFrame, group_cols: Sequence[str] = JOB) -> DataFrame:
    return items.groupBy(*group_cols).agg(
        F.count("*").alias("total_work_items"),
        F.sum("estimated_input_tokens").alias("total_estimated_input_tokens"),
    )


def new_jobs(items: DataFrame, job_type: str, now: Column) -> DataFrame:
    """A running row of the job table for each job that has items."""
    start = {
        "job_type": F.lit(job_type),
        "status": F.lit("running"),
        "completed_work_items": F.lit(0),
        "failed_work_items": F.lit(0),
        "missing_outputs": F.lit(0),
        "created_at": now,
        "updated_at": now,
    }
    return as_table(job_totals(items).withColumns(start), "jobs")


def item_status_counts(items: DataFrame, group_cols: Sequence[str] = JOB) -> DataFrame:
    return items.groupBy(*group_cols).agg(
        _with_status("completed").alias("completed_work_items"),
        _with_status("failed").alias("failed_work_items"),
        _with_status("missing").alias("missing_outputs"),
    )


def batch_status_counts(batches: DataFrame, group_cols: Sequence[str] = JOB) -> DataFrame:
    return (
        batches.groupBy(*group_cols, "status")
        .agg(F.count("*").alias("n_batches"))
        .orderBy(*group_cols, "status")
    )


def outcome_status(completed: Column, failed: Column, open_work: Column) -> Column:
    """failed if nothing but failures, completed if no failure and nothing open, else partial."""
    return (
        F.when((failed > 0) & (completed == 0), "failed")
        .when((failed == 0) & (open_work == 0), "completed")
        .otherwise("partially_completed")
    )


def job_outcome(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Final status of each job from its items and the batches still queued."""
    queued = batches.groupBy("job_id").agg(
        F.count_if(F.col("status").isin(*OPEN_BATCH_STATUSES)).alias("n_open")
    )
    joined = item_status_counts(items).join(queued, "job_id", "left")
    n_open = F.coalesce("n_open", F.lit(0).cast("bigint"))
    return joined.select(
        "job_id",
        "completed_work_items",
        "failed_work_items",
        "missing_outputs",
        n_open.alias("open_batches"),
        outcome_status(F.col("completed_work_items"), F.col("failed_work_items"), n_open).alias(
            "status"
        ),
    )


def job_dashboard(items: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One row per job in one pass over the items: status, progress, failures, tokens.

    With the job table the status is the stored one, so that a job in progress shows as running, and
    its type is there too; without it the status is what the items come to.
    """
    completed, failed = _with_status("completed"), _with_status("failed")
    unfinished = F.count_if(~F.col("status").isin("completed", "failed", "missing"))
    counted = items.groupBy("job_id").agg(
        outcome_status(completed, failed, unfinished).alias("status"),
        F.concat(completed.cast("string"), F.lit("/"), F.count("*").cast("string")).alias(
            "progress"
        ),
        failed.alias("failed_work_items"),
        _with_status("missing").alias("missing_outputs"),
        F.sum("estimated_input_tokens").alias("total_estimated_input_tokens"),
    )
    if jobs is None:
        return counted
    stored = jobs.select("job_id", "job_type", F.col("status").alias("stored"))
    return (
        counted.join(stored, "job_id", "left")
        .withColumn("status", F.coalesce("stored", "status"))
        .drop("stored")
    )


def job_type_totals(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts and tokens per job, per job type (job null) and over all (both null)."""
    counted = item_status_counts(items).join(job_totals(items), "job_id")
    counted = counted.join(jobs.select("job_id", "job_type"), "job_id", "left")
    sums = [
        F.sum(name).alias(name)
        for name in (
            "completed_work_items",
            "failed_work_items",
            "missing_outputs",
            "total_work_items",
            "total_estimated_input_tokens",
        )
    ]
    return counted.rollup("job_type", "job_id").agg(*sums, F.grouping_id().alias("level"))


def checkpoint_snapshot(items: DataFrame, batches: DataFrame, window: int) -> DataFrame:
    """Counts per job that a checkpoint stores; the ids are in `checkpoint_batches`."""
    queue = batches.groupBy("job_id").agg(
        F.count_if(F.col("status").isin(*OPEN_BATCH_STATUSES)).alias("queued_batches"),
        F.count_if(F.col("status").isin(*TERMINAL_BATCH_STATUSES)).alias("terminal_batches"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        item_status_counts(items)
        .join(queue, "job_id", "left")
        .select(
            "job_id",
            F.lit(window).cast("bigint").alias("virtual_window"),
            F.coalesce("queued_batches", zero).alias("queued_batches"),
            F.coalesce("terminal_batches", zero).alias("terminal_batches"),
            "completed_work_items",
            "failed_work_items",
            "missing_outputs",
        )
    )


def checkpoint_batches(batches: DataFrame) -> DataFrame:
    """Batch ids of a checkpoint, one row each: `queued` or `terminal`."""
    kind = F.when(F.col("status").isin(*OPEN_BATCH_STATUSES), "queued").otherwise("terminal")
    return batches.select("job_id", "batch_id", kind.alias("kind"))


# -- quota use ------------------------------------------------------------------------------


def lane_keys(attempts: DataFrame, shared: bool = False) -> list[str]:
    """A lane is named by its id within its job, unless jobs share the lanes."""
    return ["lane_id"] if shared or "job_id" not in attempts.columns else ["job_id", "lane_id"]


def _with_limits(used: DataFrame, lanes: DataFrame, keys: Sequence[str], *limits: str) -> DataFrame:
    on = [key for key in keys if key in lanes.columns]
    return used.join(lanes.select(*on, *limits), on, "left")


def rpm_usage(attempts: DataFrame, lanes: DataFrame, shared: bool = False) -> DataFrame:
    """Requests per lane and window against the lane's limit; `shared`: over all jobs together."""
    keys = lane_keys(attempts, shared)
    used = attempts.groupBy(*keys, "virtual_window").agg(F.count("*").alias("requests"))
    limit = F.col("requests_per_minute")
    return _with_limits(used, lanes, keys, "requests_per_minute").withColumn(
        "over_limit", F.coalesce(F.col("requests") > limit, F.lit(False))
    )


def tpm_usage(attempts: DataFrame, lanes: DataFrame, shared: bool = False) -> DataFrame:
    """Input tokens per lane and window against the lane's limit; `shared`: over all jobs."""
    keys = lane_keys(attempts, shared)
    used = attempts.groupBy(*keys, "virtual_window").agg(F.sum("input_tokens").alias("tokens"))
    limit = F.col("input_tokens_per_minute")
    return _with_limits(used, lanes, keys, "input_tokens_per_minute").withColumn(
        "over_limit", F.coalesce(F.col("tokens") > limit, F.lit(False))
    )


def lane_totals(attempts: DataFrame, shared: bool = False) -> DataFrame:
    return attempts.groupBy(*lane_keys(attempts, shared)).agg(
        F.count("*").alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.max("virtual_window").alias("last_request_window"),
        _with_status("failed").alias("failure_count"),
    )


def _batch_keys(attempts: DataFrame, keys: Sequence[str] | None) -> list[str]:
    """A batch is named by its id within its job, where attempts have one."""
    if keys is not None:
        return list(keys)
    return [key for key in ("job_id", "batch_id") if key in attempts.columns]


def attempts_per_batch(attempts: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    keys = _batch_keys(attempts, keys)
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("n_attempts"),
        F.count_if(F.col("status") == "succeeded").alias("n_succeeded"),
    )


def attempt_history(
    attempts: DataFrame,
    keys: Sequence[str] | None = None,
    order_cols: Sequence[str] = ("attempt_id",),
) -> DataFrame:
    """The statuses of each batch in order, one row per attempt, so that any number fits."""
    keys = _batch_keys(attempts, keys)
    narrow = attempts.select(*dict.fromkeys([*keys, *order_cols, "status"]))
    return number_rows(narrow, keys, order_cols, "attempt_number")


def day_quota(
    attempts: DataFrame,
    lanes: DataFrame,
    order_cols: Sequence[str] = ("created_at", "attempt_id"),
    shared: bool = False,
    **pieces,
) -> DataFrame:
    """Requests and tokens a lane has used so far on the (UTC) day, against its day limits."""
    keys = lane_keys(attempts, shared)
    narrow = attempts.select(
        *keys, F.to_date("created_at").alias("day"), *order_cols, "input_tokens"
    )
    used = running(
        narrow,
        [*keys, "day"],
        order_cols,
        count_col="requests_today",
        sums={"tokens_today": "input_tokens"},
        **pieces,
    )
    over = F.coalesce(F.col("requests_today") > F.col("daily_request_limit"), F.lit(False))
    over |= F.coalesce(F.col("tokens_today") > F.col("daily_token_limit"), F.lit(False))
    limited = _with_limits(used, lanes, keys, "daily_request_limit", "daily_token_limit")
    return limited.withColumn("over_limit", over)


def wave_stats(plan: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Lanes used in the fullest wave, number of waves, and minutes (one per wave)."""
    per_wave = plan.groupBy(*group_cols, "wave").agg(F.count("*").alias("n"))
    return per_wave.groupBy(*group_cols).agg(
        F.max("n").alias("parallel_lanes"),
        F.count("*").alias("n_waves"),
        F.count("*").alias("elapsed_minutes"),
    )


# -- lists ----------------------------------------------------------------------------------


def recent_events(log: DataFrame, job_id: str | None = None, n: int = 50) -> DataFrame:
    chosen = log if job_id is None else log.where(F.col("job_id") == job_id)
    return chosen.orderBy(F.col("event_id").desc()).limit(n)


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), "job_id")


def list_batches(batches: DataFrame) -> DataFrame:
    """By creation, then by number: as text, batch_1000 would come before batch_999."""
    return batches.orderBy("created_at", "batch_seq")


def list_lanes(lanes: DataFrame) -> DataFrame:
    """By id as text: lane_1, lane_10, lane_2."""
    return lanes.orderBy("lane_id")
