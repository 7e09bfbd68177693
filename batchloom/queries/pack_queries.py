from pyspark.sql import functions as F

from batchloom.operators.audit import list_lanes, wave_stats
from batchloom.operators.execute import ECHO_SCHEMA, apply_batches, attempts_of, echo_fn
from batchloom.operators.outcomes import missing_outputs, retry_batches
from batchloom.operators.packing import (
    batch_fill,
    batch_totals,
    collect_batches,
    explode_batches,
    pack_items,
    pack_items_by,
    pack_totals,
)
from batchloom.plans.lanes import (
    eligible_lanes,
    limit_violations,
    plan_waves,
    plan_waves_by_class,
    stuck_batches,
)
from batchloom.queries import views
from batchloom.schemas import PackLimits
from batchloom.queries.registry import query
from batchloom.queries.views import (
    CUSTOMER_LANES,
    JOB_PER_SOURCE,
    LIMITS,
    MIXED_LANES,
    NO_OVERFLOW,
    TURN_LIMITS,
    document_batches,
    pack_cte,
    packed_documents,
    packed_sql,
    table,
)
from batchloom.sources.tables import load_lanes

TOTALS = "batch_seq, batch_id, n_items, estimated_input_tokens"


@query("pack_global", f"{pack_cte()} SELECT {TOTALS} FROM batches")
def pack_global(spark, sf):
    return document_batches(spark, sf)


@query(
    "pack_assign", f"{pack_cte()} SELECT id AS doc_id, batch_seq, n - 1 AS pos FROM packed"
)
def pack_assign(spark, sf):
    return packed_documents(spark, sf).select(F.col("ord").alias("doc_id"), "batch_seq", "pos")


@query("pack_no_overflow", f"{pack_cte(NO_OVERFLOW)} SELECT {TOTALS} FROM batches")
def pack_no_overflow(spark, sf):
    return document_batches(spark, sf, NO_OVERFLOW)


@query(
    "pack_by_source",
    f"{pack_cte(LIMITS, JOB_PER_SOURCE)} SELECT job AS job_id, {TOTALS} FROM batches",
)
def pack_by_source(spark, sf):
    return pack_totals(views.items(spark, sf), ["ord"], LIMITS, group_cols=["job_id"])


PIECES = {"partitions": 7, "piece_rows": 10, "fanout": 4}


@query(
    "pack_pieces", f"{pack_cte()} SELECT id AS doc_id, batch_seq, n - 1 AS pos FROM packed"
)
def pack_pieces(spark, sf):
    """Small pieces, which are put together over several levels; batches run over several pieces."""
    packed = pack_items(views.items(spark, sf), ["ord"], LIMITS, **PIECES)
    return packed.select(F.col("ord").alias("doc_id"), "batch_seq", "pos")


@query(
    "pack_pieces_by_source",
    f"{pack_cte(LIMITS, JOB_PER_SOURCE)} SELECT job AS job_id, {TOTALS} FROM batches",
)
def pack_pieces_by_source(spark, sf):
    return pack_totals(views.items(spark, sf), ["ord"], LIMITS, group_cols=["job_id"], **PIECES)


TURNS = """SELECT conv_id AS job, turn AS id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
  greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tok FROM conversations"""


@query(
    "pack_turns_by_conv",
    f"""WITH RECURSIVE {packed_sql(TURN_LIMITS, TURNS)}
    SELECT job AS conv_id, id AS turn, tok, batch_seq, n - 1 AS pos FROM packed""",
)
def pack_turns_by_conv(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.greatest(F.lit(1), F.ceil(F.length("text") / 4.0)).alias("tok")
    )
    packed = pack_items_by(
        turns, ["conv_id"], ["turn"], TURN_LIMITS, id_col="turn", token_col="tok"
    )
    return packed.drop("batch_id")


@query(
    "pack_fill",
    f"""{pack_cte()}
    SELECT count(*) AS n_batches, min(estimated_input_tokens) AS min_tokens,
           max(estimated_input_tokens) AS max_tokens,
           round(avg(estimated_input_tokens / {LIMITS.safe}.0), 6) AS avg_fill,
           count(*) FILTER (estimated_input_tokens >= {LIMITS.safe}) AS at_target,
           count(*) FILTER (estimated_input_tokens > {LIMITS.hard}) AS over_cap
    FROM batches""",
)
def pack_fill(spark, sf):
    return batch_fill(document_batches(spark, sf), LIMITS)


@query(
    "pack_collect",
    f"""{pack_cte()}
    SELECT batch_id, string_agg(work_item_id, ',' ORDER BY rn) AS work_item_ids,
           count(*) AS n_items, CAST(sum(p.tok) AS BIGINT) AS estimated_input_tokens
    FROM packed p JOIN items ON id = doc_id JOIN batches USING (batch_seq) GROUP BY batch_id""",
)
def pack_collect(spark, sf):
    return document_batches(spark, sf, with_ids=True).select(
        "batch_id",
        F.array_join("work_item_ids", ",").alias("work_item_ids"),
        "n_items",
        "estimated_input_tokens",
    )


@query(
    "explode_batches",
    f"""{pack_cte()}
    SELECT batch_id, CAST(n - 1 AS INTEGER) AS pos, work_item_id
    FROM packed JOIN items ON id = doc_id JOIN batches USING (batch_seq)""",
)
def explode_batches_query(spark, sf):
    return explode_batches(collect_batches(packed_documents(spark, sf)), "batch_id")


WAVES = """waves AS (SELECT *, (batch_seq - 1) // 4 AS wave,
  'lane_' || CAST((batch_seq - 1) % 4 + 1 AS VARCHAR) AS lane_id FROM batches)"""


@query(
    "waves",
    f"{pack_cte()}, {WAVES} SELECT batch_id, estimated_input_tokens, wave, lane_id FROM waves",
)
def waves(spark, sf):
    plan = plan_waves(document_batches(spark, sf), views.equal_lanes(spark))
    return plan.select("batch_id", "estimated_input_tokens", "wave", "lane_id")


@query(
    "wave_stats",
    f"""{pack_cte()}, {WAVES}, w AS (SELECT wave, count(*) AS n FROM waves GROUP BY wave)
    SELECT max(n) AS parallel_lanes, count(*) AS n_waves, count(*) AS elapsed_minutes FROM w""",
)
def wave_stats_query(spark, sf):
    return wave_stats(
        plan_waves(document_batches(spark, sf), views.equal_lanes(spark))
    )


@query(
    "eligible_lanes",
    f"""{pack_cte()}, {MIXED_LANES}
    SELECT batch_id, CAST(count(lane_id) AS BIGINT) AS n_eligible, min(lane_id) AS first_lane
    FROM batches LEFT JOIN lanes ON estimated_input_tokens <= hard
      AND estimated_input_tokens <= tpm AND rpm >= 1
      AND (day_requests IS NULL OR day_requests >= 1)
    GROUP BY batch_id""",
)
def eligible_lanes_query(spark, sf):
    batches = document_batches(spark, sf)
    return eligible_lanes(batches, views.mixed_lanes(spark)).select(
        "batch_id", "n_eligible", "first_lane"
    )


BIG_LANES = """lanes AS (
  SELECT 'lane_' || CAST(c_custkey AS VARCHAR) AS lane_id,
         CAST(20000 + floor(c_acctbal) AS BIGINT) AS tpm,
         CAST(9000 + c_nationkey * 1200 AS BIGINT) AS hard, c_custkey % 5 <> 0 AS ready
  FROM customer)"""


def big_lanes(spark, sf):
    """A lane per customer."""
    return load_lanes(
        spark,
        table(spark, sf, "customer").select(
            F.concat(F.lit("lane_"), F.col("c_custkey").cast("string")).alias("lane_id"),
            F.lit(1).cast("bigint").alias("requests_per_minute"),
            (F.lit(20_000) + F.floor("c_acctbal")).cast("bigint").alias("input_tokens_per_minute"),
            (9_000 + F.col("c_nationkey") * 1_200).cast("bigint").alias("hard_input_token_cap"),
            F.when(F.col("c_custkey") % 5 == 0, "disabled").otherwise("ready").alias("state"),
        ),
    )


@query(
    "eligible_big_lanes",
    f"""{pack_cte()}, {BIG_LANES}
    SELECT batch_id, CAST(count(lane_id) AS BIGINT) AS n_eligible, min(lane_id) AS first_lane
    FROM batches LEFT JOIN lanes ON ready AND estimated_input_tokens <= least(hard, tpm)
    GROUP BY batch_id""",
)
def eligible_big_lanes(spark, sf):
    return eligible_lanes(document_batches(spark, sf), big_lanes(spark, sf)).select(
        "batch_id", "n_eligible", "first_lane"
    )


@query(
    "waves_big_lanes",
    f"""{pack_cte(LIMITS, JOB_PER_SOURCE)}, {BIG_LANES}, ranked AS (
      SELECT lane_id, row_number() OVER (ORDER BY lane_id) - 1 AS k, count(*) OVER () AS n
      FROM lanes WHERE ready)
    SELECT job AS job_id, batch_id, (batch_seq - 1) // n AS wave, lane_id
    FROM batches JOIN ranked ON k = (batch_seq - 1) % n""",
)
def waves_big_lanes(spark, sf):
    batches = pack_totals(views.items(spark, sf), ["ord"], LIMITS, group_cols=["job_id"])
    return plan_waves(batches, big_lanes(spark, sf)).select("job_id", "batch_id", "wave", "lane_id")


@query(
    "stuck_batches",
    f"""{pack_cte()}, {MIXED_LANES}
    SELECT batch_id, estimated_input_tokens FROM batches
    WHERE estimated_input_tokens > (SELECT max(hard) FROM lanes)""",
)
def stuck_batches_query(spark, sf):
    batches = document_batches(spark, sf)
    return stuck_batches(batches, views.mixed_lanes(spark)).select(
        "batch_id", "estimated_input_tokens"
    )


@query(
    "waves_mixed_caps",
    f"""{pack_cte(LIMITS, JOB_PER_SOURCE)}, {MIXED_LANES},
    classed AS (SELECT job, batch_seq, batch_id, estimated_input_tokens, (SELECT min(hard)
                  FROM lanes WHERE hard >= estimated_input_tokens) AS class_cap FROM batches),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY job, class_cap ORDER BY batch_seq)
                 AS class_seq FROM classed),
    class AS (SELECT hard AS class_cap, count(*) AS n, min(day_requests) AS d FROM lanes
              GROUP BY hard),
    lane AS (SELECT lane_id, hard AS class_cap,
               row_number() OVER (PARTITION BY hard ORDER BY lane_id) - 1 AS k FROM lanes)
    SELECT job AS job_id, batch_id, estimated_input_tokens, CAST(r.class_cap AS BIGINT) AS class_cap, class_seq,
           (class_seq - 1) // n AS wave, lane_id,
           CASE WHEN n IS NULL THEN NULL WHEN d IS NULL THEN 0
                ELSE (class_seq - 1) // n // d END AS day
    FROM ranked r LEFT JOIN class USING (class_cap)
      LEFT JOIN lane ON lane.class_cap = r.class_cap AND k = (class_seq - 1) % n""",
)
def waves_mixed_caps(spark, sf):
    batches = pack_totals(views.items(spark, sf), ["ord"], LIMITS, group_cols=["job_id"])
    return plan_waves_by_class(batches, views.mixed_lanes(spark), ["job_id"]).drop("batch_seq")


# small batches, so that days hold several of them
DAY_LIMITS = PackLimits(safe=7_000, hard=40_000, max_items=8)


@query(
    "waves_day_tokens",
    f"""{pack_cte(DAY_LIMITS, JOB_PER_SOURCE)}, {views.DAY_LANES},
    capped AS (SELECT *, least(hard, day_tokens) AS cap FROM lanes),
    classed AS (SELECT job, batch_seq, batch_id, estimated_input_tokens AS tok, (SELECT min(cap)
                  FROM capped WHERE cap >= estimated_input_tokens) AS class_cap FROM batches),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY job, class_cap ORDER BY batch_seq)
                 AS class_seq FROM classed),
    class AS (SELECT cap AS class_cap, count(*) AS n, min(day_requests) AS d, min(day_tokens) AS t
              FROM capped GROUP BY cap),
    lane AS (SELECT lane_id, cap AS class_cap,
               row_number() OVER (PARTITION BY cap ORDER BY lane_id) - 1 AS k FROM capped),
    queued AS (SELECT r.*, (class_seq - 1) // n AS wave, lane_id, d, t
      FROM ranked r LEFT JOIN class USING (class_cap)
        LEFT JOIN lane ON lane.class_cap = r.class_cap AND k = (class_seq - 1) % n),
    days(job, class_cap, lane_id, wave, day, used, n) AS (
      SELECT job, class_cap, lane_id, wave, CAST(0 AS BIGINT), tok, 1 FROM queued WHERE wave = 0
      UNION ALL
      SELECT job, class_cap, lane_id, wave, CASE WHEN full_up THEN day + 1 ELSE day END,
             CASE WHEN full_up THEN tok ELSE used + tok END, CASE WHEN full_up THEN 1 ELSE n + 1 END
      FROM (SELECT q.*, f.day, f.used, f.n,
                   coalesce(f.n >= q.d, FALSE) OR coalesce(f.used + q.tok > q.t, FALSE) AS full_up
            FROM days f JOIN queued q ON q.job = f.job AND q.class_cap = f.class_cap
              AND q.lane_id = f.lane_id AND q.wave = f.wave + 1) x)
    SELECT q.job AS job_id, batch_id, tok AS estimated_input_tokens,
           CAST(q.class_cap AS BIGINT) AS class_cap, class_seq, q.wave, q.lane_id, day
    FROM queued q LEFT JOIN days USING (job, class_cap, lane_id, wave)""",
)
def waves_day_tokens(spark, sf):
    batches = pack_totals(views.items(spark, sf), ["ord"], DAY_LIMITS, group_cols=["job_id"])
    return plan_waves_by_class(batches, views.day_lanes(spark), ["job_id"]).drop("batch_seq")


@query(
    "limit_violations",
    f"""WITH {CUSTOMER_LANES}
    SELECT lane_id AS subject, 'limits_positive' AS rule FROM lanes
      WHERE rpm <= 0 OR tpm <= 0 OR safe <= 0 OR hard <= 0
    UNION ALL SELECT lane_id, 'safe_within_hard' FROM lanes WHERE safe > hard
    UNION ALL SELECT lane_id, 'hard_within_minute' FROM lanes WHERE hard > tpm
    UNION ALL SELECT lane_id, 'lane_id_unique' FROM lanes GROUP BY lane_id HAVING count(*) > 1
    UNION ALL SELECT 'lanes', 'batching_cap_fits_a_lane' FROM lanes HAVING max(hard) < {LIMITS.hard}""",
)
def limit_violations_query(spark, sf):
    return limit_violations(views.customer_lanes(spark, sf), LIMITS)


@query(
    "lanes_list",
    f"WITH {CUSTOMER_LANES} SELECT lane_id, rpm AS requests_per_minute, "
    "tpm AS input_tokens_per_minute, hard AS hard_input_token_cap, 'ready' AS state, "
    "CAST(0 AS BIGINT) AS requests_used_today FROM lanes ORDER BY lane_id",
)
def lanes_list(spark, sf):
    return list_lanes(load_lanes(spark, views.customer_lanes(spark, sf))).select(
        "lane_id",
        "requests_per_minute",
        "input_tokens_per_minute",
        "hard_input_token_cap",
        "state",
        "requests_used_today",
    )


# -- outputs that came back: labelled documents ------------------------------------------------


def _missing(spark, sf, packed):
    back = table(spark, sf, "labels").select(F.col("doc_id").alias("ord"))
    return missing_outputs(packed, back, keys=["ord"])


@query(
    "missing_outputs",
    f"""{pack_cte()}
    SELECT batch_id, id AS doc_id FROM packed JOIN batches USING (batch_seq)
    WHERE id NOT IN (SELECT doc_id FROM labels)""",
)
def missing_outputs_query(spark, sf):
    missing = _missing(spark, sf, packed_documents(spark, sf))
    return missing.select("batch_id", F.col("ord").alias("doc_id"))


@query(
    "retry_batches",
    f"""{pack_cte()}, gone AS (
      SELECT batch_seq, batch_id, count(*) AS n_items, CAST(sum(p.tok) AS BIGINT) AS tokens,
             string_agg(work_item_id, ',' ORDER BY rn) AS work_item_ids
      FROM packed p JOIN batches USING (batch_seq) JOIN items ON id = doc_id
      WHERE id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL)
    SELECT printf('retry_%03d', row_number() OVER (ORDER BY batch_seq)) AS batch_id, batch_id AS parent_batch_id, work_item_ids,
           tokens AS estimated_input_tokens, n_items, CAST(1 AS INTEGER) AS attempt_count,
           'queued' AS status
    FROM gone""",
)
def retry_batches_query(spark, sf):
    packed = packed_documents(spark, sf)
    parents = batch_totals(packed, ["job_id"]).withColumn("attempt_count", F.lit(1))
    columns = ["job_id", "batch_id", "work_item_id", "pos", "estimated_input_tokens"]
    children = retry_batches(_missing(spark, sf, packed).select(*columns), None, parents)
    return children.drop("job_id", "batch_seq").withColumn(
        "work_item_ids", F.array_join("work_item_ids", ",")
    )


# -- running a function ------------------------------------------------------------------------


@query(
    "apply_echo",
    f"""{pack_cte()}
    SELECT batch_id, 'succeeded' AS status, CAST(NULL AS VARCHAR) AS error_code,
           estimated_input_tokens AS input_tokens, n_items, n_items AS n_completed,
           CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_failed
    FROM batches""",
)
def apply_echo(spark, sf):
    batch_items = packed_documents(spark, sf).withColumn("attempt_number", F.lit(1))
    cores = spark.sparkContext.defaultParallelism
    results = apply_batches(batch_items, echo_fn, ECHO_SCHEMA, partitions=cores)
    return attempts_of(results).drop("job_id", "attempt_number")
