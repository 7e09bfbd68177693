from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.columns import minute_window
from batchloom.operators.outcomes import latest_per_key
from batchloom.queries import views
from batchloom.queries.redact_queries import event_details
from batchloom.queries.registry import query
from batchloom.queries.views import (
    ATTEMPTS,
    EPOCH,
    ITEMS,
    JOB_LANES,
    LIMITS,
    ONE_JOB,
    pack_cte,
    table,
)
from batchloom.session import ROCKSDB, new_folder
from batchloom.sources.tables import write_version
from batchloom.streaming.outputs import (
    compact_status,
    read_status,
    redact_stream,
    status_sink,
    unanswered_stream,
)
from batchloom.streaming.packing import pack_sink, read_packs, tail_packs
from batchloom.streaming.usage import lane_state_stream, quota_usage_stream

# what a stream that has read all events takes as the current time
CLOCK = "clock AS (SELECT max(ts) - INTERVAL 10 MINUTE AS now FROM events)"


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file, a folder of files or a folder of partitions.

    A stream takes one file only by a pattern, so the name is given as one; partitions are looked for below `sf`.
    """
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("basePath", sf).parquet(f"{sf}/{name}.parque[t]")


def stream_in_pieces(
    spark: SparkSession, sf: str, name: str, by: str, n: int = 4, ascending: bool = True
) -> DataFrame:
    """All rows of a table as a stream of `n` micro-batches, ranges of `by`; nulls are in the first.

    Each range is written by several tasks as so many files, and files are read in the order in which they were
    written, so many at a time.
    """
    folder = new_folder(spark, "pieces")
    rows = table(spark, sf, name)
    share = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx(F.col(by).cast("double"), share, 1000)).first()[0]
    edges = [None, *(cuts or []), None]
    spans = list(zip(edges, edges[1:]))
    files = spark.sparkContext.defaultParallelism
    for low, high in spans if ascending else spans[::-1]:
        value = F.col(by).cast("double")
        inside = value.isNotNull() if low is None else value >= low
        if high is not None:
            inside &= value < high
        if low is None:
            inside |= value.isNull()
        rows.where(inside).repartition(files).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
    return stream.parquet(folder)


def run_to_end(rows: DataFrame, folder: str, sink=None, mode: str = "append") -> None:
    """Process everything there is; rows go to Parquet below `folder` or to `sink`."""
    writer = rows.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    if sink is None:
        started = writer.format("parquet").start(f"{folder}/out")
    else:
        started = writer.foreachBatch(sink).start()
    started.awaitTermination()


@query(
    "stream_usage",
    f"""WITH {ATTEMPTS}, {CLOCK}
    SELECT lane_id, CAST(epoch(date_trunc('minute', created_at)) AS BIGINT) AS minute_second,
           count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS tokens
    FROM attempts, clock
    WHERE date_trunc('minute', created_at) + INTERVAL 1 MINUTE <= now GROUP BY ALL""",
)
def stream_usage(spark, sf):
    folder = new_folder(spark, "stream")
    usage = quota_usage_stream(views.as_attempts(stream(spark, sf, "events")), shared=True)
    run_to_end(usage, folder)
    return spark.read.parquet(f"{folder}/out").select(
        "lane_id", F.unix_seconds("minute").alias("minute_second"), "requests", "tokens"
    )


@query(
    "stream_usage_by_job",
    f"""WITH {ATTEMPTS}, {CLOCK}, {JOB_LANES}
    SELECT job_id, lane_id, CAST(epoch(date_trunc('minute', created_at)) AS BIGINT) AS minute_second,
           count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS tokens,
           count(*) > rpm OR sum(input_tokens) > tpm AS over_limit
    FROM attempts JOIN lanes USING (job_id, lane_id), clock
    WHERE date_trunc('minute', created_at) + INTERVAL 1 MINUTE <= now
    GROUP BY job_id, lane_id, date_trunc('minute', created_at), rpm, tpm""",
)
def stream_usage_by_job(spark, sf):
    """Jobs with lanes of the same names and limits of their own, in several micro-batches."""
    folder = new_folder(spark, "stream")
    tried = views.as_attempts(stream_in_pieces(spark, sf, "events", "event_id"))
    run_to_end(quota_usage_stream(tried, lanes=views.job_lanes(spark, sf)), folder)
    return spark.read.parquet(f"{folder}/out").select(
        "job_id", "lane_id", F.unix_seconds("minute").alias("minute_second"), "requests", "tokens",
        "over_limit",
    )


@query(
    "stream_lane_state",
    f"""WITH {CLOCK}, tried AS (
      SELECT 'lane_' || CAST(user_id AS VARCHAR) AS lane_id,
             CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 60) AS BIGINT) AS w,
             event_type = 'error' AND value > 120 AS failed,
             CAST(floor(value * 100) AS BIGINT) AS input_tokens
      FROM events),
    used AS (SELECT lane_id, max(w) AS last, count(*) AS requests_used,
                    CAST(sum(input_tokens) AS BIGINT) AS input_tokens_used,
                    count(*) FILTER (failed) AS failure_count
             FROM tried GROUP BY lane_id),
    states AS (SELECT used.*, CASE WHEN failure_count > 0 THEN 'failed'
                 WHEN TIMESTAMP '2024-01-01' + to_minutes(last + 1) <= now THEN 'ready'
                 ELSE 'cooldown' END AS state
               FROM used, clock)
    SELECT lane_id, state, last + CASE state WHEN 'ready' THEN 1 ELSE 0 END AS as_of_window,
           CASE state WHEN 'cooldown' THEN last + 1 END AS cooldown_until_window,
           last AS last_request_window, requests_used, input_tokens_used, failure_count
    FROM states""",
)
def stream_lane_state(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = new_folder(spark, "stream")
    events = stream(spark, sf, "events")
    bad = (F.col("event_type") == "error") & (F.col("value") > 120)
    tried = events.select(
        F.concat(F.lit("lane_"), F.col("user_id").cast("string")).alias("lane_id"),
        minute_window(F.col("ts").cast("timestamp"), EPOCH).alias("virtual_window"),
        F.when(bad, "failed").otherwise("succeeded").alias("status"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )

    def keep(rows, epoch):
        rows.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    states = lane_state_stream(tried, EPOCH, timedelta(minutes=1))
    run_to_end(states, folder, keep, mode="update")
    changes = spark.read.parquet(f"{folder}/out").drop("epoch")
    return latest_per_key(changes, ["lane_id"], "as_of_window")


@query(
    "stream_unanswered",
    f"""WITH {CLOCK}
    SELECT event_id, user_id FROM events, clock
    WHERE event_type IN ('error', 'view') AND ts + INTERVAL 1 HOUR < now""",
)
def stream_unanswered(spark, sf):
    """Errors never come back, views come back after two hours, the rest after five seconds."""
    folder = new_folder(spark, "stream")
    sent = stream(spark, sf, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("sent_at")
    )
    took = F.when(F.col("event_type") == "view", F.expr("INTERVAL 2 HOURS")).otherwise(
        F.expr("INTERVAL 5 SECONDS")
    )
    returned = (
        stream(spark, sf, "events")
        .where("event_type <> 'error'")
        .select("event_id", (F.col("ts").cast("timestamp") + took).alias("returned_at"))
    )
    run_to_end(unanswered_stream(sent, returned, ["event_id"], "1 HOUR"), folder)
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id")


@query(
    "stream_redact",
    """SELECT event_id, '{"list": [{"n": ' || user_id || '}, 1, null], "nested": {"label": "'
             || event_type || '"}, "z": ' || props || '}' AS details_json
    FROM events""",
)
def stream_redact(spark, sf):
    folder = new_folder(spark, "stream")
    rows = event_details(stream(spark, sf, "events")).withColumn("Secret_key", F.lit("x"))
    run_to_end(redact_stream(rows, ["details_json"]), folder)
    return spark.read.parquet(f"{folder}/out")


@query(
    "stream_status",
    f"""WITH {ITEMS}, u AS (
      SELECT printf('work_%06d', user_id) AS work_item_id, arg_max(event_type, event_id) AS status,
             max(event_id) AS event_id
      FROM events GROUP BY user_id)
    SELECT coalesce(i.work_item_id, u.work_item_id) AS work_item_id,
           coalesce(u.status, 'pending') AS status, u.event_id
    FROM items i FULL JOIN u USING (work_item_id)""",
)
def stream_status(spark, sf):
    folder = new_folder(spark, "stream")
    table_path = f"{folder}/items"
    start = views.items(spark, sf).select(
        "work_item_id", "status", F.lit(None).cast("bigint").alias("event_id")
    )
    write_version(start, table_path, 0)
    updates = stream(spark, sf, "events").select(
        F.format_string("work_%06d", "user_id").alias("work_item_id"),
        F.col("event_type").alias("status"),
        "event_id",
    )
    columns = (["work_item_id"], ["status", "event_id"], "event_id")
    run_to_end(updates, folder, status_sink(table_path, *columns), mode="update")
    return read_status(spark, table_path, *columns)


@query(
    "stream_status_pieces",
    f"""WITH {ITEMS}, u AS (
      SELECT printf('work_%06d', user_id) AS work_item_id, arg_max(event_type, event_id) AS status,
             max(event_id) AS event_id
      FROM events GROUP BY user_id)
    SELECT coalesce(i.work_item_id, u.work_item_id) AS work_item_id,
           coalesce(u.status, 'pending') AS status, u.event_id
    FROM items i FULL JOIN u USING (work_item_id)""",
)
def stream_status_pieces(spark, sf):
    """Several micro-batches, later events first, a new version in between, and all of it once more."""
    folder = new_folder(spark, "stream")
    table_path = f"{folder}/items"
    start = views.items(spark, sf).select(
        "work_item_id", "status", F.lit(None).cast("bigint").alias("event_id")
    )
    write_version(start, table_path, 5)
    columns = (["work_item_id"], ["status", "event_id"], "event_id")
    events = stream_in_pieces(spark, sf, "events", "event_id", ascending=False)
    updates = events.select(
        F.format_string("work_%06d", "user_id").alias("work_item_id"),
        F.col("event_type").alias("status"),
        "event_id",
    )
    run_to_end(updates, folder, status_sink(table_path, *columns), mode="update")
    compact_status(spark, table_path, *columns)
    run_to_end(updates, f"{folder}/again", status_sink(table_path, *columns), mode="update")
    return read_status(spark, table_path, *columns)


@query(
    "stream_pack",
    f"""{pack_cte(LIMITS, ONE_JOB)}
    SELECT id AS doc_id, batch_seq, n - 1 AS pos FROM packed""",
)
def stream_pack(spark, sf):
    folder = new_folder(spark, "stream")
    documents = stream(spark, sf, "documents")
    rows = documents.select(
        F.lit("all").alias("job_id"),
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("work_item_id"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 4.0)).alias("estimated_input_tokens"),
    )
    run_to_end(rows, folder, pack_sink(folder, LIMITS))
    packed = read_packs(spark, folder).unionByName(tail_packs(spark, folder, LIMITS))
    return packed.select(F.col("ord").alias("doc_id"), "batch_seq", "pos")


@query(
    "stream_pack_pieces",
    f"""{pack_cte(LIMITS, ONE_JOB)}
    SELECT id AS doc_id, batch_seq, n - 1 AS pos FROM packed""",
)
def stream_pack_pieces(spark, sf):
    """Later items come first; then all come again from a new checkpoint, and count as late."""
    folder = new_folder(spark, "stream")
    documents = stream_in_pieces(spark, sf, "documents", "doc_id", n=3, ascending=False)
    rows = documents.select(
        F.lit("all").alias("job_id"),
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("work_item_id"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 4.0)).alias("estimated_input_tokens"),
    )
    run_to_end(rows, folder, pack_sink(folder, LIMITS))
    run_to_end(rows, f"{folder}/again", pack_sink(folder, LIMITS, stream="again"))
    packed = read_packs(spark, folder).unionByName(tail_packs(spark, folder, LIMITS))
    return packed.select(F.col("ord").alias("doc_id"), "batch_seq", "pos")


# a document in a hundred never comes; what is left is one sequence with holes
PRESENT = """SELECT 'all' AS job, doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rn, tok
  FROM items WHERE doc_id % 100 <> 50"""


@query(
    "stream_pack_lost_items",
    f"""{pack_cte(LIMITS, PRESENT)}
    SELECT id AS doc_id, batch_seq, n - 1 AS pos FROM packed""",
)
def stream_pack_lost_items(spark, sf):
    """The last micro-batch is a day later than the others, so all that waits for lost items is given out."""
    folder = new_folder(spark, "stream")
    documents = stream_in_pieces(spark, sf, "documents", "doc_id", n=3)
    rows = documents.where("doc_id % 100 <> 50").select(
        F.lit("all").alias("job_id"),
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("work_item_id"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 4.0)).alias("estimated_input_tokens"),
        F.timestamp_seconds(F.col("doc_id")).alias("time"),
    )
    sink = pack_sink(folder, LIMITS, time_col="time", delay="1 day")
    run_to_end(rows, folder, sink)
    # an item of another job, long after the last document
    later = spark.range(1).select(
        F.lit("clock").alias("job_id"),
        F.col("id").alias("ord"),
        F.lit("tick").alias("work_item_id"),
        F.lit(1).cast("bigint").alias("estimated_input_tokens"),
        F.lit("2100-01-01").cast("timestamp").alias("time"),
    )
    pack_sink(folder, LIMITS, stream="clock", time_col="time", delay="1 day")(later, 0)
    packed = read_packs(spark, folder).where("job_id = 'all'")
    return packed.select(F.col("ord").alias("doc_id"), "batch_seq", "pos")
