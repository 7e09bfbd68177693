from pyspark.sql import functions as F

from batchloom.functions.columns import DEFAULT_ERROR_CODE, minute_window
from batchloom.operators import audit, outcomes
from batchloom.plans.lanes import lane_state_asof
from batchloom.queries import views
from batchloom.queries.registry import query
from batchloom.queries.views import (
    ATTEMPTS,
    EPOCH,
    ITEM_STATES,
    JOB_LANES,
    LANES,
    MAX_ATTEMPTS,
    TRIED,
    attempts,
    table,
    tried_batches,
)
from batchloom.session import new_folder
from batchloom.sources.lane_days import lane_state_from_days, put_lane_attempts


@query(
    "batch_status_counts",
    f"WITH {TRIED} SELECT job_id, status, count(*) AS n_batches FROM tried GROUP BY ALL",
)
def batch_status_counts(spark, sf):
    return audit.batch_status_counts(tried_batches(spark, sf))


@query(
    "rpm_usage",
    f"""WITH {ATTEMPTS}, {LANES}
    SELECT lane_id, virtual_window, count(*) AS requests, CAST(rpm AS BIGINT) AS requests_per_minute,
           count(*) > rpm AS over_limit
    FROM attempts LEFT JOIN lanes USING (lane_id) GROUP BY lane_id, virtual_window, rpm""",
)
def rpm_usage(spark, sf):
    return audit.rpm_usage(attempts(spark, sf), views.equal_lanes(spark), shared=True)


@query(
    "rpm_usage_by_job",
    f"""WITH {ATTEMPTS}, {JOB_LANES}
    SELECT job_id, lane_id, virtual_window, count(*) AS requests,
           CAST(rpm AS BIGINT) AS requests_per_minute, count(*) > rpm AS over_limit
    FROM attempts LEFT JOIN lanes USING (job_id, lane_id)
    GROUP BY job_id, lane_id, virtual_window, rpm""",
)
def rpm_usage_by_job(spark, sf):
    return audit.rpm_usage(attempts(spark, sf), views.job_lanes(spark, sf))


@query(
    "tpm_usage",
    f"""WITH {ATTEMPTS}, {LANES}
    SELECT lane_id, virtual_window, CAST(sum(input_tokens) AS BIGINT) AS tokens,
           CAST(tpm AS BIGINT) AS input_tokens_per_minute, sum(input_tokens) > tpm AS over_limit
    FROM attempts LEFT JOIN lanes USING (lane_id) GROUP BY lane_id, virtual_window, tpm""",
)
def tpm_usage(spark, sf):
    return audit.tpm_usage(attempts(spark, sf), views.equal_lanes(spark), shared=True)


@query(
    "tpm_usage_by_job",
    f"""WITH {ATTEMPTS}, {JOB_LANES}
    SELECT job_id, lane_id, virtual_window, CAST(sum(input_tokens) AS BIGINT) AS tokens,
           CAST(tpm AS BIGINT) AS input_tokens_per_minute, sum(input_tokens) > tpm AS over_limit
    FROM attempts LEFT JOIN lanes USING (job_id, lane_id) GROUP BY job_id, lane_id, virtual_window, tpm""",
)
def tpm_usage_by_job(spark, sf):
    return audit.tpm_usage(attempts(spark, sf), views.job_lanes(spark, sf))


@query(
    "lane_totals",
    f"""WITH {ATTEMPTS}
    SELECT lane_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
           max(virtual_window) AS last_request_window,
           count(*) FILTER (status = 'failed') AS failure_count
    FROM attempts GROUP BY lane_id""",
)
def lane_totals(spark, sf):
    return audit.lane_totals(attempts(spark, sf), shared=True)


@query(
    "lane_totals_by_job",
    f"""WITH {ATTEMPTS}
    SELECT job_id, lane_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
           max(virtual_window) AS last_request_window,
           count(*) FILTER (status = 'failed') AS failure_count
    FROM attempts GROUP BY job_id, lane_id""",
)
def lane_totals_by_job(spark, sf):
    return audit.lane_totals(attempts(spark, sf))


@query(
    "attempts_per_batch",
    f"""WITH {ATTEMPTS}
    SELECT job_id, batch_id, count(*) AS n_attempts,
           count(*) FILTER (status = 'succeeded') AS n_succeeded
    FROM attempts GROUP BY job_id, batch_id""",
)
def attempts_per_batch(spark, sf):
    return audit.attempts_per_batch(attempts(spark, sf))


@query(
    "attempt_history",
    f"""WITH {ATTEMPTS}
    SELECT job_id, batch_id, attempt_id, status,
           row_number() OVER (PARTITION BY job_id, batch_id ORDER BY attempt_id) AS attempt_number
    FROM attempts""",
)
def attempt_history(spark, sf):
    return audit.attempt_history(attempts(spark, sf))


@query(
    "day_quota",
    f"""WITH {ATTEMPTS}, used AS (
      SELECT attempt_id, lane_id, input_tokens,
             count(*) OVER w AS requests_today, CAST(sum(input_tokens) OVER w AS BIGINT) AS tokens_today
      FROM attempts WINDOW w AS (PARTITION BY lane_id, CAST(created_at AS DATE)
                                 ORDER BY created_at, attempt_id
                                 ROWS UNBOUNDED PRECEDING))
    SELECT *, requests_today > 80 OR tokens_today > 400000 AS over_limit FROM used""",
)
def day_quota(spark, sf):
    lanes = views.equal_lanes(spark).withColumns(
        {
            "daily_request_limit": F.lit(80).cast("bigint"),
            "daily_token_limit": F.lit(400_000).cast("bigint"),
        }
    )
    return audit.day_quota(attempts(spark, sf), lanes, shared=True).select(
        "attempt_id", "lane_id", "input_tokens", "requests_today", "tokens_today", "over_limit"
    )


@query(
    "day_quota_pieces",
    f"""WITH {ATTEMPTS}, {JOB_LANES}, used AS (
      SELECT attempt_id, job_id, lane_id,
             count(*) OVER w AS requests_today, CAST(sum(input_tokens) OVER w AS BIGINT) AS tokens_today
      FROM attempts WINDOW w AS (PARTITION BY job_id, lane_id, CAST(created_at AS DATE)
                                 ORDER BY created_at, attempt_id
                                 ROWS UNBOUNDED PRECEDING))
    SELECT used.*, requests_today > day_requests OR tokens_today > day_tokens AS over_limit
    FROM used JOIN lanes USING (job_id, lane_id)""",
)
def day_quota_pieces(spark, sf):
    """Lanes by job; small pieces, which are put together over several levels."""
    used = audit.day_quota(
        attempts(spark, sf), views.job_lanes(spark, sf), partitions=7, piece_rows=97, fanout=4
    )
    return used.select(
        "attempt_id", "job_id", "lane_id", "requests_today", "tokens_today", "over_limit"
    )


# a lane per user and an hour per window, so that lanes are in different states
USER_LANES = """user_attempts AS (
  SELECT 'lane_' || CAST(user_id AS VARCHAR) AS lane_id,
         CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS virtual_window,
         CASE WHEN event_type = 'error' AND value > 120 THEN 'failed' ELSE 'succeeded' END AS status,
         CAST(floor(value * 100) AS BIGINT) AS input_tokens
  FROM events)"""


def user_attempts(spark, sf):
    hour = F.floor(minute_window(F.col("ts").cast("timestamp"), EPOCH) / 60).cast("bigint")
    bad = (F.col("event_type") == "error") & (F.col("value") > 120)
    return table(spark, sf, "events").select(
        F.concat(F.lit("lane_"), F.col("user_id").cast("string")).alias("lane_id"),
        hour.alias("virtual_window"),
        F.when(bad, "failed").otherwise("succeeded").alias("status"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
    )


@query(
    "lane_state_asof",
    f"""WITH {USER_LANES}, used AS (
      SELECT lane_id, max(virtual_window) AS last, count(*) FILTER (status = 'failed') AS failures,
             count(*) FILTER (virtual_window = 360) AS requests,
             CAST(coalesce(sum(input_tokens) FILTER (virtual_window = 360), 0) AS BIGINT) AS tokens
      FROM user_attempts WHERE virtual_window <= 360 GROUP BY lane_id)
    SELECT lane_id,
           CASE WHEN failures > 0 THEN 'failed' WHEN last = 360 THEN 'cooldown' ELSE 'ready' END
             AS state,
           CAST(CASE WHEN coalesce(failures, 0) = 0 AND last = 360 THEN 361 END AS BIGINT)
             AS cooldown_until_window,
           coalesce(requests, 0) AS requests_used_current_window,
           coalesce(tokens, 0) AS input_tokens_used_current_window, last AS last_request_window,
           coalesce(failures, 0) AS failure_count
    FROM (SELECT DISTINCT lane_id FROM user_attempts) LEFT JOIN used USING (lane_id)""",
)
def lane_state(spark, sf):
    tried = user_attempts(spark, sf)
    return lane_state_asof(tried, tried.select("lane_id").distinct(), 360).drop(
        "requests_used_today", "input_tokens_used_today"
    )


STATE_SQL = f"""WITH {ATTEMPTS}, {JOB_LANES}, used AS (
      SELECT job_id, lane_id, max(virtual_window) AS last, count(*) FILTER (status = 'failed') AS failures,
             count(*) FILTER (virtual_window >= 7200) AS requests,
             CAST(sum(input_tokens) FILTER (virtual_window >= 7200) AS BIGINT) AS tokens
      FROM attempts WHERE virtual_window <= 8000 GROUP BY job_id, lane_id)
    SELECT job_id, lane_id,
           CASE WHEN lane_id = 'lane_2' THEN 'disabled' WHEN failures > 0 THEN 'failed'
                WHEN last = 8000 THEN 'cooldown' ELSE 'ready' END AS state,
           coalesce(requests, 0) AS requests_used_today,
           coalesce(tokens, 0) AS input_tokens_used_today,
           CAST(day_requests AS BIGINT) AS daily_request_limit
    FROM lanes LEFT JOIN used USING (job_id, lane_id)"""
STATE_COLUMNS = [
    "job_id",
    "lane_id",
    "state",
    "requests_used_today",
    "input_tokens_used_today",
    "daily_request_limit",
]


def lanes_with_own_state(spark, sf):
    state = F.when(F.col("lane_id") == "lane_2", "disabled").otherwise("ready")
    return views.job_lanes(spark, sf).withColumn("state", state)


@query("lane_state_by_job", STATE_SQL)
def lane_state_by_job(spark, sf):
    """Lanes keep what disables them, and bring their use of the day and their limits."""
    lanes = lanes_with_own_state(spark, sf)
    return lane_state_asof(attempts(spark, sf), lanes, 8_000).select(*STATE_COLUMNS)


@query("lane_state_from_days", STATE_SQL)
def lane_state_from_days_query(spark, sf):
    """The same from a log by day, which came in two parts, one of them twice."""
    path, tried = new_folder(spark, "lane-days"), attempts(spark, sf)
    late = F.col("attempt_id") % 3 == 0
    put_lane_attempts(tried.where(~late), path, "r", 1)
    for _ in range(2):
        put_lane_attempts(tried.where(late), path, "r", 2)
    lanes = lanes_with_own_state(spark, sf)
    return lane_state_from_days(spark, path, lanes, 8_000).select(*STATE_COLUMNS)


@query(
    "results_attach",
    f"""WITH {TRIED}
    SELECT a.attempt_id, job_id, batch_id, a.status AS attempt_status, t.status AS batch_status,
           t.attempt_count
    FROM attempts a JOIN tried t USING (job_id, batch_id)""",
)
def results_attach(spark, sf):
    tried = attempts(spark, sf).select(
        "attempt_id", "job_id", "batch_id", F.col("status").alias("attempt_status")
    )
    batches = tried_batches(spark, sf).select(
        "job_id", "batch_id", F.col("status").alias("batch_status"), "attempt_count"
    )
    return outcomes.attach_results(batches, tried)


@query(
    "status_marks",
    f"""WITH {TRIED}
    SELECT job_id, batch_id, 'lane_1' AS lane_id, attempt_count + 1 AS attempt_count,
           CASE status WHEN 'completed' THEN 'completed' ELSE 'failed' END AS status,
           CASE status WHEN 'failed' THEN 'TIMEOUT' WHEN 'queued' THEN '{DEFAULT_ERROR_CODE}' END
             AS error_code,
           TRUE AS finished_after_start
    FROM tried""",
)
def status_marks(spark, sf):
    start, end = (F.lit(f"2024-02-01 00:0{m}:00").cast("timestamp") for m in (0, 1))
    batches = tried_batches(spark, sf)
    code = F.when(F.col("was") == "failed", "TIMEOUT")
    assigned = outcomes.assign_batches(
        batches.withColumn("was", F.col("status")), F.lit("lane_1"), start
    )
    done = outcomes.complete_batches(assigned.where("was = 'completed'"), end)
    failed = outcomes.fail_batches(assigned.where("was <> 'completed'"), code, end)
    return done.unionByName(failed).select(
        "job_id",
        "batch_id",
        "lane_id",
        "attempt_count",
        "status",
        "error_code",
        (F.col("completed_at") > F.col("started_at")).alias("finished_after_start"),
    )


@query(
    "retry_split",
    f"""WITH {TRIED}
    SELECT job_id, batch_id, attempt_count,
           CASE WHEN attempt_count < 2 THEN 'queued' ELSE 'failed' END AS status
    FROM tried WHERE status = 'failed'""",
)
def retry_split(spark, sf):
    failed = tried_batches(spark, sf).where("status = 'failed'")
    again, terminal = outcomes.split_retry(failed, max_attempts=2)
    return again.drop("lane_id").unionByName(terminal).select(
        "job_id", "batch_id", "attempt_count", "status"
    )


@query(
    "next_round",
    f"""WITH {TRIED}
    SELECT job_id, batch_id, attempt_count, 0 AS queue_part, queue_pos FROM tried
      WHERE status = 'queued'
    UNION ALL SELECT job_id, batch_id, attempt_count, 1, queue_pos FROM tried
      WHERE status = 'failed' AND attempt_count < {MAX_ATTEMPTS}
    UNION ALL SELECT job_id, 'retry_' || batch_id, attempt_count, 1, queue_pos FROM tried
      WHERE status = 'completed'""",
)
def next_round(spark, sf):
    tried = tried_batches(spark, sf)
    again, _ = outcomes.split_retry(tried.where("status = 'failed'"), MAX_ATTEMPTS)
    children = tried.where("status = 'completed'").withColumn(
        "batch_id", F.concat(F.lit("retry_"), F.col("batch_id"))
    )
    queue = outcomes.next_round(tried.where("status = 'queued'"), again, children)
    return queue.select("job_id", "batch_id", "attempt_count", "queue_part", "queue_pos")


@query(
    "retry_numbers",
    f"""WITH {TRIED}, used AS (
      SELECT job_id, count(*) FILTER (status = 'completed') AS n FROM tried GROUP BY job_id),
    numbered AS (SELECT job_id, batch_id, n + row_number() OVER (PARTITION BY job_id
                   ORDER BY queue_pos, batch_id) AS retry_no
                 FROM tried JOIN used USING (job_id) WHERE status = 'queued')
    SELECT *, printf('retry_%03d', retry_no) AS retry_batch_id
    FROM numbered""",
)
def retry_numbers(spark, sf):
    tried = tried_batches(spark, sf)
    existing = tried.withColumn(
        "batch_id",
        F.when(F.col("status") == "completed", F.concat(F.lit("retry_"), "batch_id")).otherwise(
            F.col("batch_id")
        ),
    )
    parents = tried.where("status = 'queued'").select("job_id", "batch_id", "queue_pos")
    return outcomes.number_retries(
        parents, ["queue_pos", "batch_id"], existing=existing
    ).drop("queue_pos")


@query(
    "resume_split",
    f"""WITH {TRIED}
    SELECT job_id, batch_id, CASE status WHEN 'queued' THEN 'open' ELSE 'terminal' END AS part
    FROM tried""",
)
def resume_split(spark, sf):
    unfinished, terminal = outcomes.split_resumable(tried_batches(spark, sf))
    return (
        unfinished.withColumn("part", F.lit("open"))
        .unionByName(terminal.withColumn("part", F.lit("terminal")))
        .select("job_id", "batch_id", "part")
    )


@query(
    "latest_checkpoint",
    f"""WITH {ATTEMPTS}
    SELECT job_id, max(attempt_id) AS checkpoint_id,
           arg_max(virtual_window, attempt_id) AS virtual_window,
           arg_max(input_tokens, attempt_id) AS completed_work_items
    FROM attempts GROUP BY job_id""",
)
def latest_checkpoint(spark, sf):
    checkpoints = attempts(spark, sf).select(
        "job_id",
        F.col("attempt_id").alias("checkpoint_id"),
        "virtual_window",
        F.col("input_tokens").alias("completed_work_items"),
    )
    return outcomes.latest_checkpoint(checkpoints)


@query(
    "checkpoint_snapshot",
    f"""WITH {ITEM_STATES}, {TRIED},
    c AS (SELECT job_id, count(*) FILTER (status = 'completed') AS completed_work_items,
                 count(*) FILTER (status = 'failed') AS failed_work_items,
                 count(*) FILTER (status = 'missing') AS missing_outputs
          FROM item_states GROUP BY job_id),
    b AS (SELECT job_id, count(*) FILTER (status = 'queued') AS queued_batches,
                 count(*) FILTER (status <> 'queued') AS terminal_batches
          FROM tried GROUP BY job_id)
    SELECT job_id, CAST(7 AS BIGINT) AS virtual_window, coalesce(queued_batches, 0) AS queued_batches,
           coalesce(terminal_batches, 0) AS terminal_batches, completed_work_items,
           failed_work_items, missing_outputs
    FROM c LEFT JOIN b USING (job_id)""",
)
def checkpoint_snapshot(spark, sf):
    return audit.checkpoint_snapshot(
        views.item_states(spark, sf), tried_batches(spark, sf), window=7
    )


@query(
    "checkpoint_batches",
    f"""WITH {TRIED}
    SELECT job_id, batch_id, CASE status WHEN 'queued' THEN 'queued' ELSE 'terminal' END AS kind
    FROM tried""",
)
def checkpoint_batches(spark, sf):
    return audit.checkpoint_batches(tried_batches(spark, sf))


@query(
    "recent_events",
    """SELECT event_id, event_type, 'src' || CAST(user_id % 20 AS VARCHAR) AS job_id FROM events
    WHERE user_id % 20 = 7 ORDER BY event_id DESC LIMIT 50""",
)
def recent_events(spark, sf):
    log = table(spark, sf, "events").select(
        "event_id",
        "event_type",
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("job_id"),
    )
    return audit.recent_events(log, "src7", 50)


@query(
    "jobs_list",
    f"""WITH {TRIED}
    SELECT job_id, CAST(floor(epoch(min(created_at))) AS BIGINT) AS created_second, count(*) AS n_batches
    FROM tried GROUP BY job_id""",
)
def jobs_list(spark, sf):
    jobs = (
        tried_batches(spark, sf)
        .groupBy("job_id")
        .agg(F.min("created_at").alias("created_at"), F.count("*").alias("n_batches"))
    )
    return audit.list_jobs(jobs).select(
        "job_id", F.unix_seconds("created_at").alias("created_second"), "n_batches"
    )


@query(
    "batches_list",
    f"""WITH {TRIED}
    SELECT job_id, batch_id, status, attempt_count, estimated_input_tokens FROM tried
    ORDER BY created_at, queue_pos""",
)
def batches_list(spark, sf):
    batches = tried_batches(spark, sf).withColumnRenamed("queue_pos", "batch_seq")
    return audit.list_batches(batches).select(
        "job_id", "batch_id", "status", "attempt_count", "estimated_input_tokens"
    )
