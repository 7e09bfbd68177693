import pytest
from pyspark.sql import functions as F

from batchloom.operators import audit
from batchloom.operators import outcomes as o

ITEM = "job_id string, work_item_id string"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_missing_and_skipped(spark):
    sent = spark.createDataFrame([("j", "a"), ("j", "b"), ("k", "a")], ITEM)
    back = spark.createDataFrame([("j", "a"), ("j", "zz")], ITEM)
    assert rows_of(o.missing_outputs(sent, back), "*") == [("j", "b"), ("k", "a")]
    assert rows_of(o.skip_completed(sent, back), "*") == [("j", "b"), ("k", "a")]


def test_status_updates_touch_only_named_items(spark):
    items = spark.createDataFrame(
        [("j", "a", "pending", 0), ("j", "b", "pending", 4), ("k", "a", "pending", 0)],
        f"{ITEM}, status string, attempt_count int",
    )
    updates = spark.createDataFrame([("j", "a", "completed")], f"{ITEM}, status string")
    got = rows_of(o.apply_status(items, updates, increment=True), "*")
    assert got == [("j", "a", "completed", 1), ("j", "b", "pending", 4), ("k", "a", "pending", 0)]
    assert rows_of(o.apply_status(items, updates), "attempt_count") == [(0,), (0,), (4,)]
    marked = o.set_status(items, "processing", F.lit(1), increment=True)
    assert rows_of(marked, "status", "attempt_count")[-1] == ("processing", 5)


def test_retries_end_with_the_attempts(spark):
    failed = spark.createDataFrame(
        [("j", "b1", 1, "failed", "x"), ("j", "b2", 3, "failed", "x")],
        "job_id string, batch_id string, attempt_count int, status string, lane_id string",
    )
    again, terminal = o.split_retry(failed)
    assert rows_of(again, "batch_id", "status", "lane_id") == [("b1", "queued", None)]
    assert rows_of(terminal, "batch_id", "status", "lane_id") == [("b2", "failed", "x")]


def test_children_of_missing_outputs(spark):
    items = spark.createDataFrame(
        [("j", f"w{i}", 10 + i) for i in range(6)], f"{ITEM}, estimated_input_tokens long"
    )
    missing = spark.createDataFrame(
        [("j", "batch_010", "w5", 3), ("j", "batch_010", "w1", 0), ("j", "batch_002", "w2", 1)],
        "job_id string, batch_id string, work_item_id string, pos int",
    )
    parents = spark.createDataFrame(
        [("j", "batch_002", 2, 1), ("j", "batch_010", 10, 2), ("j", "retry_001", 11, 1)],
        "job_id string, batch_id string, batch_seq long, attempt_count int",
    )
    with_tokens = missing.join(items, ["job_id", "work_item_id"])
    for found, known in ((missing, items), (with_tokens, None)):
        children = o.retry_batches(found, known, parents, existing=parents)
        assert rows_of(
            children,
            "batch_id",
            "parent_batch_id",
            "work_item_ids",
            "estimated_input_tokens",
            "attempt_count",
            "status",
        ) == [
            ("retry_002", "batch_002", ["w2"], 12, 1, "queued"),
            ("retry_003", "batch_010", ["w1", "w5"], 26, 2, "queued"),
        ]


def test_queue_order(spark):
    schema = "job_id string, batch_id string, attempt_count int, queue_pos long"
    untouched = spark.createDataFrame([("j", "b9", 0, 9)], schema)
    failed = spark.createDataFrame([("j", "b2", 1, 2), ("j", "b2", 1, 2)], schema)
    children = spark.createDataFrame([("j", "retry_001", 1, 1)], schema)
    queue = o.next_round(untouched, failed, children).orderBy("queue_part", "queue_pos")
    assert [r["batch_id"] for r in queue.collect()] == ["b9", "retry_001", "b2"]


@pytest.mark.parametrize("small_source", [False, True])
def test_upsert_keeps_first_values(spark, small_source):
    schema = "job_id string, job_type string, status string, n int"
    target = spark.createDataFrame([("a", "t1", "running", 1), ("b", "t2", "running", None)], schema)
    source = spark.createDataFrame([("a", "other", "done", None), ("c", "t3", "new", 3)], schema)
    merged = o.upsert(target, source, ["job_id"], ["status", "n"], small_source)
    assert merged.columns == target.columns
    got = {r["job_id"]: tuple(r)[1:] for r in merged.collect()}
    assert got == {
        "a": ("t1", "done", None),  # null in the source is a value
        "b": ("t2", "running", None),
        "c": ("t3", "new", 3),
    }


def test_reconcile(spark):
    schema = f"{ITEM}, input_text_hash string"
    stored = spark.createDataFrame(
        [("j", "same", "h"), ("j", "edited", "h"), ("j", "gone", "h"), ("j", "nul", None)], schema
    )
    back = spark.createDataFrame(
        [("j", "same", "h"), ("j", "edited", "g"), ("j", "extra", "h"), ("j", "nul", None)], schema
    )
    assert rows_of(o.reconcile_by_hash(stored, back), "work_item_id", "verdict") == [
        ("edited", "changed"),
        ("extra", "new"),
        ("gone", "absent"),
        ("nul", "match"),
        ("same", "match"),
    ]


def test_resume_parts_and_checkpoints(spark):
    statuses = ["queued", "pending", "retry_pending", "processing", "completed", "failed",
                "partially_completed"]
    batches = spark.createDataFrame(
        [("j", f"b{i}", s) for i, s in enumerate(statuses)],
        "job_id string, batch_id string, status string",
    )
    unfinished, terminal = o.split_resumable(batches)
    assert unfinished.count() == 4 and terminal.count() == 3
    items = spark.createDataFrame(
        [("j", "completed"), ("j", "completed"), ("j", "missing"), ("j", "pending")],
        "job_id string, status string",
    )
    snapshot = audit.checkpoint_snapshot(items, batches, 5).first().asDict()
    assert snapshot == {
        "job_id": "j",
        "virtual_window": 5,
        "queued_batches": 4,
        "terminal_batches": 3,
        "completed_work_items": 2,
        "failed_work_items": 0,
        "missing_outputs": 1,
    }
    kinds = audit.checkpoint_batches(batches).groupBy("kind").count()
    assert rows_of(kinds, "*") == [("queued", 4), ("terminal", 3)]
    stored = spark.createDataFrame(
        [(1, "j", 0), (7, "j", 3), (2, "k", 9)],
        "checkpoint_id long, job_id string, virtual_window long",
    )
    assert rows_of(o.latest_checkpoint(stored), "*") == [(2, "k", 9), (7, "j", 3)]


@pytest.mark.parametrize(
    "statuses, queued, expected",
    [
        (["completed"], False, "completed"),
        (["completed", "missing"], False, "completed"),
        (["completed"], True, "partially_completed"),
        (["completed", "failed"], False, "partially_completed"),
        (["failed"], False, "failed"),
        (["failed"], True, "failed"),
        (["pending"], False, "completed"),
    ],
)
def test_job_outcome(spark, statuses, queued, expected):
    items = spark.createDataFrame([("j", s) for s in statuses], "job_id string, status string")
    batches = spark.createDataFrame(
        [("j", "queued" if queued else "completed")], "job_id string, status string"
    )
    assert audit.job_outcome(items, batches).first()["status"] == expected


def test_batch_marks(spark):
    batch = spark.createDataFrame(
        [("j", "b", "queued", 0, None)],
        "job_id string, batch_id string, status string, attempt_count int, error_code string",
    )
    start, end = F.lit(1), F.lit(2)
    assigned = o.assign_batches(batch, F.lit("lane_1"), start)
    assert rows_of(assigned, "status", "lane_id", "attempt_count", "started_at") == [
        ("processing", "lane_1", 1, 1)
    ]
    failed = o.fail_batches(assigned, F.lit(None).cast("string"), end)
    assert rows_of(failed, "status", "error_code", "completed_at") == [("failed", "BATCH_FAILED", 2)]
    done = o.complete_batches(failed, end)
    assert rows_of(done, "status", "error_code") == [("completed", None)]


def test_history_and_lists(spark):
    attempts = spark.createDataFrame(
        [(2, "b", "succeeded"), (1, "b", "failed"), (3, "c", "succeeded")],
        "attempt_id long, batch_id string, status string",
    )
    history = audit.attempt_history(attempts).orderBy("batch_id", "attempt_number").collect()
    assert [(r["batch_id"], r["status"]) for r in history] == [
        ("b", "failed"),
        ("b", "succeeded"),
        ("c", "succeeded"),
    ]
    batches = spark.createDataFrame(
        [(1, 1000, "batch_1000"), (1, 999, "batch_999"), (0, 5, "batch_005")],
        "created_at int, batch_seq long, batch_id string",
    )
    assert [r["batch_seq"] for r in audit.list_batches(batches).collect()] == [5, 999, 1000]
    log = spark.createDataFrame([(i, "j") for i in range(30)], "event_id long, job_id string")
    assert [r["event_id"] for r in audit.recent_events(log, "j", 3).collect()] == [29, 28, 27]
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], "created_at int, job_id string")
    assert [r["job_id"] for r in audit.list_jobs(jobs).collect()] == ["b", "a"]
