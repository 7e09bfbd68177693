from pyspark.sql import functions as F

from batchloom.operators.audit import (
    item_status_counts,
    job_dashboard,
    job_outcome,
    job_totals,
    job_type_totals,
    new_jobs,
)
from batchloom.operators.items import derive_items, item_violations, split_oversize
from batchloom.operators.ordered import order_items
from batchloom.operators.outcomes import (
    apply_status,
    reconcile_by_hash,
    skip_completed,
    upsert,
)
from batchloom.queries import views
from batchloom.queries.registry import query
from batchloom.queries.views import ITEM_STATES, ITEMS, TRIED, table
from batchloom.session import new_folder
from batchloom.sources.buckets import create_buckets, read_buckets, upsert_buckets


@query(
    "items_derive",
    f"""WITH {ITEMS}
    SELECT job_id, work_item_id, doc_id AS ord, CAST(doc_id AS VARCHAR) AS external_id,
           input_text_hash, tok AS estimated_input_tokens,
           '{{"lang":"' || lang || '","n_chars":' || n_chars || '}}' AS metadata_json,
           'pending' AS status, CAST(0 AS INTEGER) AS attempt_count
    FROM items JOIN documents USING (doc_id)""",
)
def items_derive(spark, sf):
    return derive_items(
        table(spark, sf, "documents"),
        "doc_id",
        job_id=F.col("source"),
        text_col="text",
        n_chars_col="n_chars",
        metadata_cols=["n_chars", "lang", "text"],
    )


@query(
    "items_nested_metadata",
    f"""WITH {ITEMS}
    SELECT job_id, work_item_id,
           '{{"info":{{"deep":[{{"n":' || n_chars || '}}],"label":"' || lang || '"}},"tags":{{"a":"' || lang
             || '","z":"' || source || '"}}}}' AS metadata_json
    FROM items JOIN documents USING (doc_id)""",
)
def items_nested_metadata(spark, sf):
    """Sensitive keys go at every depth: in structs, in lists of structs and in maps."""
    documents = table(spark, sf, "documents").withColumns(
        {
            "info": F.struct(
                F.col("text").alias("raw_text"),
                F.col("lang").alias("label"),
                F.lit("S3CRET").alias("Api_Key"),
                F.array(F.struct(F.col("n_chars").alias("n"), F.col("text").alias("prompt"))).alias("deep"),
            ),
            "tags": F.create_map(
                F.lit("z"), F.col("source"), F.lit("client_secret"), F.col("text"), F.lit("a"), F.col("lang")
            ),
        }
    )
    items = derive_items(
        documents,
        "doc_id",
        job_id=F.col("source"),
        n_chars_col="n_chars",
        metadata_cols=["tags", "info"],
    )
    return items.select("job_id", "work_item_id", "metadata_json")


@query(
    "items_oversize",
    f"WITH {ITEMS} SELECT job_id, work_item_id, tok AS estimated_input_tokens FROM items "
    "WHERE tok > 2000",
)
def items_oversize(spark, sf):
    _, rejected = split_oversize(views.items(spark, sf), 2_000)
    return rejected.select("job_id", "work_item_id", "estimated_input_tokens")


@query(
    "items_violations",
    """WITH rows AS (
      SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS work_item_id, n_chars - 100 AS tok,
             CASE WHEN quality = 1 THEN 'completed' WHEN toxic = 1 THEN 'toxic' END AS status,
             quality - toxic AS attempts
      FROM documents LEFT JOIN labels USING (doc_id))
    SELECT job_id, work_item_id, 'tokens_positive' AS rule FROM rows WHERE tok <= 0
    UNION ALL SELECT job_id, work_item_id, 'status_known' FROM rows
      WHERE status IS NULL OR status = 'toxic'
    UNION ALL SELECT job_id, work_item_id, 'attempts_not_negative' FROM rows
      WHERE attempts IS NULL OR attempts < 0""",
)
def items_violations(spark, sf):
    rows = (
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels"), "doc_id", "left")
        .select(
            F.col("source").alias("job_id"),
            F.col("doc_id").cast("string").alias("work_item_id"),
            (F.col("n_chars") - 100).alias("estimated_input_tokens"),
            F.when(F.col("quality") == 1, "completed")
            .when(F.col("toxic") == 1, "toxic")
            .alias("status"),
            (F.col("quality") - F.col("toxic")).alias("attempt_count"),
        )
    )
    return item_violations(rows)


@query(
    "items_list",
    f"WITH {ITEMS} SELECT job_id, work_item_id, tok AS estimated_input_tokens FROM items "
    "ORDER BY job_id, work_item_id",
)
def items_list(spark, sf):
    narrow = views.items(spark, sf).select("job_id", "work_item_id", "estimated_input_tokens")
    return order_items(narrow, "job_id", "work_item_id")


@query(
    "job_totals",
    f"""WITH {ITEMS}
    SELECT job_id, count(*) AS total_work_items,
           CAST(sum(tok) AS BIGINT) AS total_estimated_input_tokens
    FROM items GROUP BY job_id""",
)
def job_totals_query(spark, sf):
    return job_totals(views.items(spark, sf))


COUNTS = """count(*) FILTER (status = 'completed') AS completed_work_items,
           count(*) FILTER (status = 'failed') AS failed_work_items,
           count(*) FILTER (status = 'missing') AS missing_outputs"""


@query(
    "item_status_counts",
    f"WITH {ITEM_STATES} SELECT job_id, {COUNTS} FROM item_states GROUP BY job_id",
)
def item_status_counts_query(spark, sf):
    return item_status_counts(views.item_states(spark, sf))


@query(
    "job_outcome",
    f"""WITH {ITEM_STATES}, {TRIED},
    c AS (SELECT job_id, {COUNTS} FROM item_states GROUP BY job_id),
    b AS (SELECT job_id, count(*) FILTER (status = 'queued') AS n FROM tried GROUP BY job_id)
    SELECT job_id, completed_work_items, failed_work_items, missing_outputs,
           coalesce(n, 0) AS open_batches,
           CASE WHEN failed_work_items > 0 AND completed_work_items = 0 THEN 'failed'
                WHEN failed_work_items = 0 AND coalesce(n, 0) = 0 THEN 'completed'
                ELSE 'partially_completed' END AS status
    FROM c LEFT JOIN b USING (job_id)""",
)
def job_outcome_query(spark, sf):
    return job_outcome(views.item_states(spark, sf), views.tried_batches(spark, sf))


@query(
    "job_dashboard",
    f"""WITH {ITEM_STATES},
    c AS (SELECT job_id, {COUNTS}, count(*) AS n, CAST(sum(tok) AS BIGINT) AS tokens,
                 count(*) FILTER (status = 'pending') AS n_open
          FROM item_states GROUP BY job_id)
    SELECT job_id,
           CASE WHEN failed_work_items > 0 AND completed_work_items = 0 THEN 'failed'
                WHEN failed_work_items = 0 AND n_open = 0 THEN 'completed'
                ELSE 'partially_completed' END AS status,
           completed_work_items || '/' || n AS progress, failed_work_items, missing_outputs,
           tokens AS total_estimated_input_tokens
    FROM c""",
)
def job_dashboard_query(spark, sf):
    return job_dashboard(views.item_states(spark, sf))


@query(
    "job_dashboard_stored",
    f"""WITH {ITEM_STATES},
    c AS (SELECT job_id, {COUNTS}, count(*) AS n, CAST(sum(tok) AS BIGINT) AS tokens
          FROM item_states GROUP BY job_id)
    SELECT job_id, 'running' AS status, 'type_' || length(job_id) AS job_type,
           completed_work_items || '/' || n AS progress, failed_work_items, missing_outputs,
           tokens AS total_estimated_input_tokens
    FROM c""",
)
def job_dashboard_stored(spark, sf):
    """A job in progress shows as running."""
    states = views.item_states(spark, sf)
    return job_dashboard(states, _jobs(states))


def _jobs(states):
    """A job table with a type for each length of a job's name."""
    jobs = new_jobs(states, "any", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    kind = F.concat(F.lit("type_"), F.length("job_id").cast("string"))
    return jobs.withColumn("job_type", kind)


@query(
    "job_type_totals",
    f"""WITH {ITEM_STATES}, s AS (SELECT *, 'type_' || length(job_id) AS job_type FROM item_states)
    SELECT job_type, job_id, {COUNTS}, count(*) AS total_work_items,
           CAST(sum(tok) AS BIGINT) AS total_estimated_input_tokens,
           CAST(GROUPING(job_type) * 2 + GROUPING(job_id) AS BIGINT) AS level
    FROM s GROUP BY ROLLUP (job_type, job_id)""",
)
def job_type_totals_query(spark, sf):
    states = views.item_states(spark, sf)
    return job_type_totals(states, _jobs(states))


@query(
    "status_apply",
    f"""WITH {ITEMS}
    SELECT job_id, work_item_id,
           CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality = 1 THEN 'completed'
                ELSE 'failed' END AS status,
           CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS attempt_count
    FROM items LEFT JOIN labels l USING (doc_id)""",
)
def status_apply(spark, sf):
    items = views.items(spark, sf).select("ord", "job_id", "work_item_id", "status", "attempt_count")
    updates = table(spark, sf, "labels").select(
        F.col("doc_id").alias("ord"),
        F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"),
    )
    return apply_status(items, updates, keys=["ord"], increment=True).drop("ord")


# Stored: all documents. Resubmitted: the labelled ones, toxic ones edited, and all pages.
RESUBMITTED = f"""{ITEMS}, resubmitted AS (
  SELECT job_id, work_item_id,
         CASE WHEN toxic = 1 THEN sha256(text || '!') ELSE input_text_hash END AS input_text_hash,
         tok + 1 AS tok, 'processing' AS status
  FROM items JOIN labels USING (doc_id) JOIN documents USING (doc_id)
  UNION ALL
  SELECT 'pages', printf('work_%06d', page_id), sha256(html),
         greatest(1, CAST(ceil(length(html) / 4.0) AS BIGINT)), 'processing'
  FROM pages)"""


def resubmitted(spark, sf):
    """Texts are hashed where they are read; only hashes are joined with the labels."""
    documents = table(spark, sf, "documents")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("ord"), toxic.alias("edited"))
    parts = []
    for text, rows in ((F.col("text"), "NOT edited"), (F.concat("text", F.lit("!")), "edited")):
        items = derive_items(
            documents.withColumn("text", text),
            "doc_id",
            job_id=F.col("source"),
            text_col="text",
            n_chars_col="n_chars",
        )
        parts.append(items.join(labels.where(rows).drop("edited"), "ord"))
    again = parts[0].unionByName(parts[1]).withColumn(
        "estimated_input_tokens", F.col("estimated_input_tokens") + 1
    )
    pages = derive_items(table(spark, sf, "pages"), "page_id", job_id="pages", text_col="html")
    return again.unionByName(pages).withColumn("status", F.lit("processing"))


UPSERT_SQL = f"""WITH {RESUBMITTED}
    SELECT coalesce(i.job_id, r.job_id) AS job_id,
           coalesce(i.work_item_id, r.work_item_id) AS work_item_id,
           CASE WHEN i.job_id IS NULL THEN r.input_text_hash ELSE i.input_text_hash END
             AS input_text_hash,
           coalesce(r.tok, i.tok) AS estimated_input_tokens,
           coalesce(r.status, 'pending') AS status
    FROM items i FULL JOIN resubmitted r
      ON i.job_id = r.job_id AND i.work_item_id = r.work_item_id"""


@query("upsert_items", UPSERT_SQL)
def upsert_items(spark, sf):
    columns = ["job_id", "work_item_id", "input_text_hash", "estimated_input_tokens", "status"]
    return upsert(
        views.items(spark, sf).select(*columns),
        resubmitted(spark, sf).select(*columns),
        keys=["job_id", "work_item_id"],
        update_cols=["estimated_input_tokens", "status"],
    )


@query("upsert_buckets", UPSERT_SQL)
def upsert_buckets_query(spark, sf):
    """As `upsert_items`, into a table in buckets; only those that the source touches are written."""
    columns = ["job_id", "work_item_id", "input_text_hash", "estimated_input_tokens", "status"]
    path = new_folder(spark, "buckets")
    create_buckets(views.items(spark, sf).select(*columns), path, ["job_id", "work_item_id"], 32)
    upsert_buckets(resubmitted(spark, sf).select(*columns), path, ["estimated_input_tokens", "status"])
    return read_buckets(spark, path)


@query(
    "reconcile_hash",
    f"""WITH {RESUBMITTED}
    SELECT coalesce(i.job_id, r.job_id) AS job_id,
           coalesce(i.work_item_id, r.work_item_id) AS work_item_id,
           i.input_text_hash AS stored_hash, r.input_text_hash AS resubmitted_hash,
           CASE WHEN r.job_id IS NULL THEN 'absent' WHEN i.job_id IS NULL THEN 'new'
                WHEN i.input_text_hash = r.input_text_hash THEN 'match' ELSE 'changed' END AS verdict
    FROM items i FULL JOIN resubmitted r
      ON i.job_id = r.job_id AND i.work_item_id = r.work_item_id""",
)
def reconcile_hash(spark, sf):
    return reconcile_by_hash(views.items(spark, sf), resubmitted(spark, sf))


@query(
    "skip_completed",
    f"""WITH {ITEM_STATES}
    SELECT job_id, work_item_id, tok AS estimated_input_tokens FROM item_states
    WHERE status <> 'completed'""",
)
def skip_completed_query(spark, sf):
    done = views.item_states(spark, sf).where("status = 'completed'")
    items = views.items(spark, sf).select("job_id", "work_item_id", "estimated_input_tokens")
    return skip_completed(items, done)
