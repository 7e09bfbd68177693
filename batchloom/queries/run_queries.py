import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.operators.audit import checkpoint_batches, checkpoint_snapshot, job_outcome
from batchloom.operators.execute import BatchFailed
from batchloom.operators.rounds import run_rounds
from batchloom.queries import views
from batchloom.queries.redact_queries import event_details
from batchloom.queries.registry import query
from batchloom.queries.views import ITEM_STATES, ITEMS, JOB_PER_SOURCE, LIMITS, pack_cte
from batchloom.session import new_folder
from batchloom.sources.tables import (
    append_attempts,
    append_checkpoint,
    append_events,
    read_items,
    read_rows,
    read_version,
    reset_job,
    write_table,
    write_version,
)
from batchloom.operators.outcomes import upsert

SIZE_SCHEMA = T.StructType([T.StructField("doubled", T.LongType())])


def faulty(key: dict, items: pd.DataFrame) -> pd.DataFrame:
    """Doubles the estimate. Every fifth batch fails at first; some items come back late, some
    never, which follows from the last digits of their hash."""
    number = int(key["batch_id"].rsplit("_", 1)[1])
    if key["batch_id"].startswith("batch_") and number % 5 == 0 and key["attempt_number"] == 1:
        raise BatchFailed("FIRST_TRY")
    digit = items["work_item_id"].str[-2:].astype(int)
    missing = (digit == 7) | ((digit % 10 == 3) & (key["attempt_number"] == 1))
    back = items[~missing]
    return pd.DataFrame(
        {"work_item_id": back["work_item_id"], "doubled": back["estimated_input_tokens"] * 2}
    )


def finished_run(spark, sf):
    items = views.items(spark, sf).select(
        "job_id", "work_item_id", "ord", "estimated_input_tokens"
    )
    return run_rounds(items, faulty, SIZE_SCHEMA, LIMITS, new_folder(spark, "rounds"))


def run_on_lanes(spark, sf):
    items = views.items(spark, sf).select(
        "job_id", "work_item_id", "ord", "estimated_input_tokens"
    )
    folder = new_folder(spark, "rounds")
    return run_rounds(items, faulty, SIZE_SCHEMA, LIMITS, folder, lanes=views.equal_lanes(spark))


FATES = f"""{pack_cte(LIMITS, JOB_PER_SOURCE)}, fates AS (
  SELECT job AS job_id, printf('work_%06d', id) AS work_item_id, batch_seq % 5 = 0 AS batch_fails,
         id % 100 = 7 AS never, id % 10 = 3 AS late
  FROM packed)"""


@query(
    "run_rounds",
    f"""{FATES}
    SELECT job_id, work_item_id, CASE WHEN never THEN 'failed' ELSE 'completed' END AS status,
           CAST(CASE WHEN never THEN 3 WHEN batch_fails OR late THEN 2 ELSE 1 END AS INTEGER)
             AS attempt_count
    FROM fates""",
)
def run_rounds_query(spark, sf):
    return finished_run(spark, sf).item_states().drop("estimated_input_tokens")


def read_texts(key: dict, items: pd.DataFrame) -> pd.DataFrame:
    """The length of each text; every seventh batch fails at first."""
    number = int(key["batch_id"].rsplit("_", 1)[1])
    if number % 7 == 0 and key["attempt_number"] == 1:
        raise BatchFailed("FIRST_TRY")
    return pd.DataFrame({"work_item_id": items["work_item_id"], "chars": items["text"].str.len()})


@query(
    "run_rounds_texts",
    f"""{pack_cte(LIMITS, JOB_PER_SOURCE)}
    SELECT p.job AS job_id, printf('work_%06d', p.id) AS work_item_id, p.batch_seq AS queue_pos,
           row_number() OVER (PARTITION BY p.job, p.batch_seq ORDER BY p.rn) - 1 AS pos,
           CASE WHEN p.batch_seq % 7 = 0 THEN 2 ELSE 1 END AS attempt_number, length(d.text) AS chars
    FROM packed p JOIN documents d ON d.doc_id = p.id""",
)
def run_rounds_texts(spark, sf):
    """The texts that a function reads are moved once, by ranges of (job, order)."""
    items = views.items(spark, sf).select("job_id", "work_item_id", "ord", "estimated_input_tokens")
    texts = views.table(spark, sf, "documents").select(
        F.col("source").alias("job_id"),
        F.format_string("work_%06d", "doc_id").alias("work_item_id"),
        F.col("doc_id").alias("at"),
        "text",
    )
    folder = new_folder(spark, "rounds")
    schema = T.StructType([T.StructField("chars", T.LongType())])
    run = run_rounds(items, read_texts, schema, LIMITS, folder, payload=texts, payload_order=["at"])
    done = run.results().where("outcome = 'completed'")
    return done.select("job_id", "work_item_id", "queue_pos", "pos", "attempt_number", "chars")


@query(
    "run_rounds_outcome",
    f"""{FATES}
    SELECT job_id, count(*) FILTER (NOT never) AS completed_work_items,
           count(*) FILTER (never) AS failed_work_items, CAST(0 AS BIGINT) AS missing_outputs,
           CAST(0 AS BIGINT) AS open_batches,
           CASE WHEN bool_or(never) THEN 'partially_completed' ELSE 'completed' END AS status
    FROM fates GROUP BY job_id""",
)
def run_rounds_outcome(spark, sf):
    run = finished_run(spark, sf)
    return job_outcome(run.item_states(), run.batches())


@query(
    "run_rounds_events",
    f"""{FATES}, tried AS (
      SELECT job AS job_id, batch_seq, batch_seq % 5 = 0 AS fails, bool_or(id % 100 = 7) AS never,
             bool_or(id % 100 = 7 OR id % 10 = 3) AS gaps
      FROM packed GROUP BY job, batch_seq),
    n AS (
      SELECT job_id, count(*) AS batches, count(*) FILTER (fails) AS failed,
             count(*) FILTER (NOT fails AND gaps) + count(*) FILTER (never) AS children,
             bool_or(fails OR gaps) AS second, bool_or(never) AS third
      FROM tried GROUP BY job_id),
    events AS (
      SELECT job_id, 'job_started' AS event_type, 1 AS n FROM n
      UNION ALL SELECT job_id, 'batch_dispatched', batches + failed + children FROM n
      UNION ALL SELECT job_id, 'batch_requeued', failed FROM n
      UNION ALL SELECT job_id, 'missing_outputs_requeued', children FROM n
      UNION ALL SELECT job_id, 'checkpoint_saved', 1 + CAST(second AS INT) + CAST(third AS INT) FROM n
      UNION ALL SELECT job_id, 'job_finished', 1 FROM n)
    SELECT job_id, event_type, CAST(n AS BIGINT) AS n_events FROM events WHERE n > 0""",
)
def run_rounds_events(spark, sf):
    events = finished_run(spark, sf).events()
    return events.groupBy("job_id", "event_type").agg(F.count("*").alias("n_events"))


# which batches run in which round, by the place of the batch that each comes from
ROUNDS = f"""{FATES}, tried AS (
  SELECT job AS job_id, batch_seq, CAST(sum(tok) AS BIGINT) AS tokens, batch_seq % 5 = 0 AS fails,
         CAST(sum(tok) FILTER (id % 100 = 7 OR id % 10 = 3) AS BIGINT) AS gap_tokens,
         CAST(sum(tok) FILTER (id % 100 = 7) AS BIGINT) AS never_tokens
  FROM packed GROUP BY job, batch_seq),
rounds AS (
  SELECT job_id, batch_seq, 1 AS round, tokens, fails FROM tried
  UNION ALL SELECT job_id, batch_seq, 2, CASE WHEN fails THEN tokens ELSE gap_tokens END, FALSE
    FROM tried WHERE fails OR gap_tokens IS NOT NULL
  UNION ALL SELECT job_id, batch_seq, 3, never_tokens, FALSE FROM tried WHERE never_tokens IS NOT NULL)"""


@query(
    "run_rounds_lanes",
    f"""{ROUNDS}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY job_id, round ORDER BY batch_seq) - 1 AS k FROM rounds),
    spans AS (SELECT job_id, round, CAST(max(k) // 4 + 1 AS BIGINT) AS span FROM placed GROUP BY ALL),
    begins AS (
      SELECT job_id, round, CAST(sum(span) OVER (PARTITION BY job_id ORDER BY round) - span AS BIGINT) AS first
      FROM spans)
    SELECT job_id, batch_seq AS queue_pos, round AS attempt_number, tokens AS input_tokens,
           'lane_' || CAST(k % 4 + 1 AS VARCHAR) AS lane_id, first + k // 4 AS virtual_window
    FROM placed JOIN begins USING (job_id, round)""",
)
def run_rounds_lanes(spark, sf):
    return run_on_lanes(spark, sf).attempts().select(
        "job_id", "queue_pos", "attempt_number", "input_tokens", "lane_id", "virtual_window"
    )


@query(
    "run_rounds_checkpoints",
    f"""{ROUNDS}, n AS (
      SELECT job_id, round, count(*) AS n, count(*) FILTER (NOT fails) AS ended FROM rounds GROUP BY ALL),
    done AS (
      SELECT f.job_id, n.round,
             count(*) FILTER (NOT never AND n.round >= CASE WHEN batch_fails OR late THEN 2 ELSE 1 END)
               AS completed, count(*) FILTER (never AND n.round = 3) AS failed
      FROM fates f JOIN n ON n.job_id = f.job_id GROUP BY ALL)
    SELECT n.job_id, CAST(n.round AS BIGINT) AS virtual_window,
           coalesce(lead(n.n) OVER w, 0) AS queued_batches, CAST(sum(ended) OVER w AS BIGINT) AS terminal_batches,
           completed AS completed_work_items, failed AS failed_work_items, CAST(0 AS BIGINT) AS missing_outputs
    FROM n JOIN done ON done.job_id = n.job_id AND done.round = n.round
    WINDOW w AS (PARTITION BY n.job_id ORDER BY n.round)""",
)
def run_rounds_checkpoints(spark, sf):
    names = (
        "queued_batches",
        "terminal_batches",
        "completed_work_items",
        "failed_work_items",
        "missing_outputs",
    )
    events = finished_run(spark, sf).events().where("event_type = 'checkpoint_saved'")
    details = F.from_json("details_json", ", ".join(f"{name} bigint" for name in names))
    return events.select("job_id", "virtual_window", details.alias("d")).select(
        "job_id", "virtual_window", *[F.col("d")[name].alias(name) for name in names]
    )


@query(
    "run_rounds_resumed",
    f"""{FATES}
    SELECT job_id, printf('work_%06d', doc_id) AS work_item_id, doc_id % 20 = 3 AS changed,
           CASE WHEN doc_id % 20 = 3 THEN 'pending' WHEN never THEN 'failed' ELSE 'completed' END AS status,
           CAST(CASE WHEN doc_id % 20 = 3 THEN 1 WHEN never THEN 3 WHEN batch_fails OR late THEN 2 ELSE 1 END
             AS INTEGER) AS attempt_count
    FROM fates JOIN items USING (job_id, work_item_id)""",
)
def run_rounds_resumed(spark, sf):
    items = views.items(spark, sf).select(
        "job_id", "work_item_id", "ord", "estimated_input_tokens", "input_text_hash"
    )
    folder = new_folder(spark, "rounds")
    run_rounds(items, faulty, SIZE_SCHEMA, LIMITS, folder, stop_after=1)
    edited = F.when(F.col("ord") % 20 == 3, F.sha2("input_text_hash", 256)).otherwise(
        F.col("input_text_hash")
    )
    run = run_rounds(
        items.withColumn("input_text_hash", edited), faulty, SIZE_SCHEMA, LIMITS, folder
    )
    changed = run.changed().select("job_id", "work_item_id", F.lit(True).alias("changed"))
    states = run.item_states().join(changed, ["job_id", "work_item_id"], "left")
    return states.select(
        "job_id", "work_item_id", F.coalesce("changed", F.lit(False)).alias("changed"), "status", "attempt_count"
    )


@query(
    "store_append",
    """SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS job_id, event_id,
           '{"list": [{"n": ' || user_id || '}, 1, null], "nested": {"label": "'
             || event_type || '"}, "z": ' || props || '}' AS details_json
    FROM events""",
)
def store_append(spark, sf):
    path = new_folder(spark, "events")
    job = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
    events = views.table(spark, sf, "events")
    append_events(event_details(events, job.alias("job_id")), path)
    return read_rows(spark, path).select("job_id", "event_id", "details_json")


@query(
    "store_attempts",
    f"""WITH {views.ATTEMPTS}
    SELECT attempt_id, job_id, batch_id, lane_id, virtual_window, status, input_tokens FROM attempts""",
)
def store_attempts(spark, sf):
    """Two parts, the second of them added twice."""
    path = new_folder(spark, "attempts")
    attempts = views.attempts(spark, sf)
    early = F.col("attempt_id") % 2 == 0
    append_attempts(attempts.where(early), path, run="first", epoch=0)
    for _ in range(2):
        append_attempts(attempts.where(~early), path, run="first", epoch=1)
    return read_rows(spark, path).select(
        "attempt_id", "job_id", "batch_id", "lane_id", "virtual_window", "status", "input_tokens"
    )


@query(
    "store_checkpoints",
    f"""WITH {views.TRIED}
    SELECT job_id, batch_id, CASE WHEN status = 'queued' THEN 'queued' ELSE 'terminal' END AS kind,
           count(*) FILTER (status = 'queued') OVER w AS queued_batches,
           count(*) FILTER (status <> 'queued') OVER w AS terminal_batches
    FROM tried WINDOW w AS (PARTITION BY job_id)""",
)
def store_checkpoints(spark, sf):
    """A checkpoint that is added twice is there once; its counts next to its batches."""
    root = new_folder(spark, "checkpoints")
    batches = views.tried_batches(spark, sf)
    items = batches.select(
        "job_id", F.col("batch_id").alias("work_item_id"), "status", "estimated_input_tokens"
    )
    mark = F.lit(1).cast("bigint").alias("checkpoint_id")
    snapshot = checkpoint_snapshot(items, batches, 1).select("*", mark)
    for _ in range(2):
        append_checkpoint(
            snapshot, checkpoint_batches(batches).select("*", mark), root, run="first", epoch=1
        )
    counts = read_rows(spark, f"{root}/checkpoints").select(
        "job_id", "checkpoint_id", "queued_batches", "terminal_batches"
    )
    listed = read_rows(spark, f"{root}/checkpoint_batches")
    return listed.join(counts, ["job_id", "checkpoint_id"]).drop("checkpoint_id")


@query("store_reset", f"WITH {ITEMS} SELECT job_id, work_item_id FROM items WHERE job_id <> 'src3'")
def store_reset(spark, sf):
    root = new_folder(spark, "tables")
    write_table(views.items(spark, sf).select("job_id", "work_item_id"), f"{root}/work_items")
    reset_job(spark, root, "src3")
    return read_rows(spark, f"{root}/work_items")


@query(
    "store_read_job",
    f"""WITH {ITEM_STATES}
    SELECT job_id, work_item_id, tok AS estimated_input_tokens, status
    FROM item_states WHERE job_id = 'src4'""",
)
def store_read_job(spark, sf):
    path = new_folder(spark, "items")
    states = views.item_states(spark, sf)
    write_table(states.select("job_id", "work_item_id", "estimated_input_tokens", "status"), path)
    return read_items(spark, path, "src4")


@query(
    "store_versions",
    f"""WITH {ITEM_STATES} SELECT job_id, work_item_id, status FROM item_states""",
)
def store_versions(spark, sf):
    path = new_folder(spark, "versions")
    columns = ["job_id", "work_item_id", "status"]
    write_version(views.items(spark, sf).select(*columns), path, 1)
    known = views.item_states(spark, sf).where("status <> 'pending'").select(*columns)
    merged = upsert(read_version(spark, path), known, columns[:2], ["status"])
    write_version(merged, path, 2)
    return read_version(spark, path)
