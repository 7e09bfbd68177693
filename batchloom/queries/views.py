"""Inputs of the registered queries, as DataFrames and as the same CTEs in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.columns import minute_window
from batchloom.operators.items import derive_items
from batchloom.operators.packing import pack_items, pack_totals
from batchloom.schemas import PackLimits

# the hard cap takes the longest document (20,000 words), so that no item is left out
LIMITS = PackLimits(safe=36_000, hard=40_000, max_items=60)
NO_OVERFLOW = PackLimits(safe=36_000, hard=40_000, max_items=60, allow_overflow=False)
TURN_LIMITS = PackLimits(safe=600, hard=700, max_items=4)

EPOCH = datetime(2024, 1, 1)
MAX_ATTEMPTS = 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- items: input order = doc_id, job = source -----------------------------------------------

ITEMS = """items AS (
  SELECT source AS job_id, doc_id,
         printf('work_%06d', doc_id) AS work_item_id,
         sha256(text) AS input_text_hash,
         greatest(1, CAST(ceil(n_chars / 4.0) AS BIGINT)) AS tok
  FROM documents)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return derive_items(
        table(spark, sf, "documents"),
        "doc_id",
        job_id=F.col("source"),
        text_col="text",
        n_chars_col="n_chars",
    )


# items with the status that labels give them
ITEM_STATES = f"""{ITEMS}, item_states AS (
  SELECT i.*, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'completed'
                   WHEN l.doc_id IS NOT NULL THEN 'missing' ELSE 'pending' END AS status
  FROM items i LEFT JOIN labels l USING (doc_id))"""


def item_states(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "ord")
    status = (
        F.when(F.col("toxic") == 1, "failed")
        .when(F.col("quality") == 1, "completed")
        .when(F.col("quality").isNotNull(), "missing")
        .otherwise("pending")
    )
    joined = items(spark, sf).join(labels, "ord", "left")
    return joined.withColumn("status", status).drop("quality", "toxic")


# -- packed documents -------------------------------------------------------------------------


def packed_sql(limits: PackLimits, item_rows: str) -> str:
    """CTE `packed` (job, id, rn, tok, batch_seq, pos) over `item_rows` (job, id, rn, tok)."""
    allow = "TRUE" if limits.allow_overflow else "FALSE"
    return f"""it AS ({item_rows}),
packed(job, id, rn, tok, batch_seq, n, s) AS (
  SELECT job, id, rn, tok, CAST(1 AS BIGINT), CAST(1 AS BIGINT), tok FROM it WHERE rn = 1
  UNION ALL
  SELECT job, id, irn, tok, CASE WHEN brk THEN batch_seq + 1 ELSE batch_seq END,
         CASE WHEN brk THEN 1 ELSE n + 1 END, CASE WHEN brk THEN tok ELSE s + tok END
  FROM (SELECT i.job, i.id, i.rn AS irn, i.tok, f.batch_seq, f.n, f.s,
               (f.s >= {limits.safe} OR f.n >= {limits.max_items} OR f.s + i.tok > {limits.hard}
                OR (f.s + i.tok > {limits.safe}
                    AND (NOT {allow} OR f.s >= {limits.underfilled_below}))) AS brk
        FROM packed f JOIN it i ON i.job = f.job AND i.rn = f.rn + 1) x),
batches AS (
  SELECT job, batch_seq, printf('batch_%03d', batch_seq) AS batch_id,
         count(*) AS n_items, CAST(sum(tok) AS BIGINT) AS estimated_input_tokens
  FROM packed GROUP BY job, batch_seq)"""


ONE_JOB = "SELECT 'all' AS job, doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rn, tok FROM items"
JOB_PER_SOURCE = """SELECT job_id AS job, doc_id AS id,
  row_number() OVER (PARTITION BY job_id ORDER BY doc_id) AS rn, tok FROM items"""


def pack_cte(limits: PackLimits = LIMITS, rows: str = ONE_JOB) -> str:
    return f"WITH RECURSIVE {ITEMS}, {packed_sql(limits, rows)}"


def packed_documents(spark: SparkSession, sf: str, limits: PackLimits = LIMITS) -> DataFrame:
    """All documents as one job."""
    one_job = items(spark, sf).withColumn("job_id", F.lit("all"))
    return pack_items(one_job, ["ord"], limits, group_cols=["job_id"])


def document_batches(
    spark: SparkSession, sf: str, limits: PackLimits = LIMITS, with_ids: bool = False
) -> DataFrame:
    """The batches of `packed_documents`."""
    one_job = items(spark, sf).withColumn("job_id", F.lit("all"))
    return pack_totals(one_job, ["ord"], limits, with_ids=with_ids)


# -- lanes ------------------------------------------------------------------------------------

LANES = """lanes(lane_id, rpm, tpm, safe, hard) AS (VALUES
  ('lane_1', 1, 45000, 36000, 40000), ('lane_2', 1, 45000, 36000, 40000),
  ('lane_3', 1, 45000, 36000, 40000), ('lane_4', 1, 45000, 36000, 40000))"""
MIXED_LANES = """lanes(lane_id, rpm, tpm, safe, hard, day_requests) AS (VALUES
  ('lane_1', 1, 45000, 12000, 12000, NULL), ('lane_2', 1, 45000, 24000, 24000, 2),
  ('lane_3', 1, 45000, 36000, 37000, 3), ('lane_4', 1, 45000, 36000, 37000, 2))"""


# lane_5 takes nothing; the caps of lane_1 and lane_6 are their daily tokens
DAY_LANES = """lanes(lane_id, hard, day_requests, day_tokens) AS (VALUES
  ('lane_1', 24000, NULL, 9000), ('lane_2', 24000, 2, 30000), ('lane_3', 40000, 3, 60000),
  ('lane_4', 40000, 4, 90000), ('lane_5', 40000, NULL, 0), ('lane_6', 40000, NULL, 24000),
  ('lane_7', 37000, 2, NULL))"""


def lane_rows(
    spark: SparkSession,
    caps: list[int],
    day_requests: list[int | None],
    day_tokens: list[int | None] | None = None,
) -> DataFrame:
    """A lane per cap, with the columns of the lane table."""
    day_tokens = day_tokens or [None] * len(caps)
    one = F.array(
        *[
            F.struct(
                F.lit(f"lane_{n}").alias("lane_id"),
                F.lit(min(36_000, cap)).cast("bigint").alias("safe_input_token_target"),
                F.lit(cap).cast("bigint").alias("hard_input_token_cap"),
                F.lit(limit).cast("bigint").alias("daily_request_limit"),
                F.lit(tokens).cast("bigint").alias("daily_token_limit"),
            )
            for n, (cap, limit, tokens) in enumerate(zip(caps, day_requests, day_tokens), 1)
        ]
    )
    return (
        spark.range(1)
        .select(F.inline(one))
        .withColumns(
            {
                "requests_per_minute": F.lit(1).cast("bigint"),
                "input_tokens_per_minute": F.lit(45_000).cast("bigint"),
                "state": F.lit("ready"),
                "requests_used_current_window": F.lit(0).cast("bigint"),
                "input_tokens_used_current_window": F.lit(0).cast("bigint"),
                "requests_used_today": F.lit(0).cast("bigint"),
                "input_tokens_used_today": F.lit(0).cast("bigint"),
            }
        )
    )


def equal_lanes(spark: SparkSession) -> DataFrame:
    return lane_rows(spark, [40_000] * 4, [None] * 4)


def mixed_lanes(spark: SparkSession) -> DataFrame:
    return lane_rows(spark, [12_000, 24_000, 37_000, 37_000], [None, 2, 3, 2])


def day_lanes(spark: SparkSession) -> DataFrame:
    caps = [24_000, 24_000, 40_000, 40_000, 40_000, 40_000, 37_000]
    requests = [None, 2, 3, 4, None, None, 2]
    return lane_rows(spark, caps, requests, [9_000, 30_000, 60_000, 90_000, 0, 24_000, None])


# the lanes of each job that has attempts: the same names, other limits
JOB_LANES = """lanes AS (
  SELECT job_id, lane_id, 1 + k % 3 AS rpm, 9000 + 500 * (k % 7) AS tpm, 40 + k AS day_requests,
         200000 + 10000 * k AS day_tokens
  FROM (SELECT DISTINCT 'src' || CAST(user_id % 20 AS VARCHAR) AS job_id,
               'lane_' || CAST(user_id % 4 + 1 AS VARCHAR) AS lane_id, user_id % 20 AS k FROM events))"""


def job_lanes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("user_id") % 20
    limits = {
        "requests_per_minute": 1 + k % 3,
        "input_tokens_per_minute": 9_000 + 500 * (k % 7),
        "daily_request_limit": 40 + k,
        "daily_token_limit": 200_000 + 10_000 * k,
    }
    return (
        table(spark, sf, "events")
        .select(
            F.concat(F.lit("src"), k.cast("string")).alias("job_id"),
            F.concat(F.lit("lane_"), (F.col("user_id") % 4 + 1).cast("string")).alias("lane_id"),
            *[limit.cast("bigint").alias(name) for name, limit in limits.items()],
        )
        .distinct()
    )


# a lane per customer, for checks of big lane tables
CUSTOMER_LANES = """lanes AS (
  SELECT 'lane_' || CAST(c_custkey // 2 AS VARCHAR) AS lane_id, CAST(1 AS BIGINT) AS rpm,
         CAST(10000 + floor(c_acctbal) AS BIGINT) AS tpm, CAST(9000 + c_nationkey * 50 AS BIGINT) AS safe,
         CAST(8500 + c_nationkey * 100 AS BIGINT) AS hard
  FROM customer)"""


def customer_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.concat(F.lit("lane_"), F.expr("c_custkey div 2").cast("string")).alias("lane_id"),
        F.lit(1).cast("bigint").alias("requests_per_minute"),
        (F.lit(10_000) + F.floor("c_acctbal")).cast("bigint").alias("input_tokens_per_minute"),
        (9_000 + F.col("c_nationkey") * 50).cast("bigint").alias("safe_input_token_target"),
        (8_500 + F.col("c_nationkey") * 100).cast("bigint").alias("hard_input_token_cap"),
    )


# -- attempts from events ---------------------------------------------------------------------

ATTEMPTS = """attempts AS (
  SELECT event_id AS attempt_id, 'src' || CAST(user_id % 20 AS VARCHAR) AS job_id,
         'lane_' || CAST(user_id % 4 + 1 AS VARCHAR) AS lane_id,
         printf('batch_%03d', event_id % 500) AS batch_id,
         CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 60) AS BIGINT) AS virtual_window,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partially_succeeded'
                         ELSE 'succeeded' END AS status,
         CAST(floor(value * 100) AS BIGINT) AS input_tokens, ts AS created_at
  FROM events)"""


def as_attempts(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("attempt_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("job_id"),
        F.concat(F.lit("lane_"), (F.col("user_id") % 4 + 1).cast("string")).alias("lane_id"),
        F.format_string("batch_%03d", F.col("event_id") % 500).alias("batch_id"),
        minute_window(F.col("ts").cast("timestamp"), EPOCH).alias("virtual_window"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "partially_succeeded")
        .otherwise("succeeded")
        .alias("status"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return as_attempts(table(spark, sf, "events"))


# the batches these attempts belong to, with the status after their last attempt
TRIED = f"""{ATTEMPTS}, tried AS (
  SELECT job_id, batch_id, count(*) AS attempt_count, CAST(sum(input_tokens) AS BIGINT)
           AS estimated_input_tokens, min(attempt_id) AS queue_pos, min(created_at) AS created_at,
         CASE arg_max(status, attempt_id) WHEN 'failed' THEN 'failed'
              WHEN 'succeeded' THEN 'completed' ELSE 'queued' END AS status
  FROM attempts GROUP BY job_id, batch_id)"""


def tried_batches(spark: SparkSession, sf: str) -> DataFrame:
    last = F.max_by("status", "attempt_id")
    return (
        attempts(spark, sf)
        .groupBy("job_id", "batch_id")
        .agg(
            F.count("*").alias("attempt_count"),
            F.sum("input_tokens").alias("estimated_input_tokens"),
            F.min("attempt_id").alias("queue_pos"),
            F.min("created_at").alias("created_at"),
            F.when(last == "failed", "failed")
            .when(last == "succeeded", "completed")
            .otherwise("queued")
            .alias("status"),
        )
    )
