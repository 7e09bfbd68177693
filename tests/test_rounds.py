import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.operators import audit, rounds
from batchloom.operators.audit import job_outcome
from batchloom.operators.execute import (
    ECHO_SCHEMA,
    BatchFailed,
    apply_batches,
    attempts_of,
    echo_fn,
)
from batchloom.operators.rounds import Rounds, run_rounds
from batchloom.operators.outcomes import latest_checkpoint
from batchloom.schemas import PackLimits
from batchloom.sources.tables import append_checkpoint, append_events, read_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMITS = PackLimits(50, 60, 5)
OUT = T.StructType([T.StructField("answer", T.StringType())])


@pytest.fixture(scope="module")
def items(spark):
    job = F.when(F.col("id") < 40, "a").otherwise("b")
    return spark.range(60).select(
        job.alias("job_id"),
        F.format_string("work_%06d", "id").alias("work_item_id"),
        F.col("id").alias("ord"),
        F.lit(10).cast("bigint").alias("estimated_input_tokens"),
    )


def answers(frame):
    return pd.DataFrame({"work_item_id": frame["work_item_id"], "answer": "ok"})


def flaky(key, frame):
    """Batch 1 fails once; item 12 is missing once; item 25 always; batch 8 of job a always fails."""
    number = frame["work_item_id"].str[-2:].astype(int)
    if key["batch_id"] == "batch_001" and key["attempt_number"] == 1:
        raise BatchFailed("TIMEOUT")
    if key["job_id"] == "a" and key["batch_id"] == "batch_008":
        raise RuntimeError("HIDDEN details")
    gone = (number == 25) | ((number == 12) & (key["attempt_number"] == 1))
    return answers(frame[~gone])


def statuses(run):
    return {r["work_item_id"]: (r["status"], r["attempt_count"]) for r in run.item_states().collect()}


def check_finished(run):
    got = statuses(run)
    assert got["work_000025"] == ("failed", 3)
    assert got["work_000012"] == ("completed", 2)
    assert got["work_000000"] == ("completed", 2) and got["work_000040"] == ("completed", 2)
    assert got["work_000039"] == ("failed", 3)
    assert got["work_000010"] == ("completed", 1)
    batches = {(r["job_id"], r["batch_id"]): r for r in run.batches().collect()}
    assert batches["a", "batch_001"]["status"] == "completed"
    assert batches["a", "batch_001"]["attempt_count"] == 2
    assert batches["a", "batch_003"]["status"] == "partially_completed"
    assert batches["a", "batch_008"]["status"] == "failed"
    assert batches["a", "batch_008"]["error_code"] == "BATCH_FAILED"
    assert batches["a", "retry_001"]["status"] == "completed"
    assert batches["a", "retry_002"]["status"] == "partially_completed"
    assert batches["a", "retry_003"]["n_items"] == 1
    assert {b for j, b in batches if j == "b"} == {f"batch_00{i}" for i in range(1, 5)}
    parents = run.results().where("batch_id LIKE 'retry%'").select("batch_id", "parent_batch_id")
    assert {tuple(r) for r in parents.collect()} == {
        ("retry_001", "batch_003"),
        ("retry_002", "batch_006"),
        ("retry_003", "retry_002"),
    }
    outcome = {r["job_id"]: r["status"] for r in run.outcome().collect()}
    assert outcome == {"a": "partially_completed", "b": "completed"}
    history = run.attempts().where("job_id = 'a' AND batch_id = 'batch_001'").orderBy("attempt_number")
    assert [(r["status"], r["error_code"]) for r in history.collect()] == [
        ("failed", "TIMEOUT"),
        ("succeeded", None),
    ]


def test_rounds_to_the_end(items, folder):
    run = run_rounds(items, flaky, OUT, LIMITS, folder)
    assert sorted(run.committed()) == [1, 2, 3]
    check_finished(run)


def test_stopped_run_goes_on_without_repeating_work(spark, items, folder):
    first = run_rounds(items, flaky, OUT, LIMITS, folder, stop_after=1)
    assert statuses(first)["work_000025"] == ("pending", 1)
    queued = {r["batch_id"] for r in first.batches().where("status = 'queued'").collect()}
    assert queued == {"batch_001", "batch_008", "retry_001", "retry_002"}
    assert job_outcome(first.item_states(), first.batches()).where("open_batches = 0").count() == 0
    before = {tuple(r) for r in first.attempts().select("job_id", "batch_id", "status").collect()}

    # a round that was written but not committed is done again
    first.queue_after(1).limit(1).write.parquet(first.folder("queue", 2))
    run = run_rounds(items, flaky, OUT, LIMITS, folder)
    check_finished(run)
    again = run.attempts().where("attempt_number = 1").select("job_id", "batch_id", "status")
    assert {tuple(r) for r in again.collect()} == before
    done = run_rounds(items, flaky, OUT, LIMITS, folder)
    assert done.results().count() == run.results().count()


@pytest.mark.parametrize("stop_after", [1, None])
def test_items_that_come_later_are_packed_and_run(items, folder, stop_after):
    some = items.where("ord % 4 < 2 AND ord < 40")
    first = run_rounds(some, flaky, OUT, LIMITS, folder, stop_after=stop_after)
    ran = {tuple(r) for r in first.results().select("work_item_id", "round", "batch_id").collect()}
    grown = Rounds(items.sparkSession, folder, items)
    assert {r["job_id"]: r["status"] for r in grown.outcome().collect()} == dict.fromkeys("ab", "partially_completed")
    assert grown.outcome().where("open_batches = 0").count() == 0
    new = {r["work_item_id"] for r in grown.new_items().collect()}
    assert {statuses(grown)[i] for i in new} == {("pending", 0)} and len(new) == 40

    run = run_rounds(items, flaky, OUT, LIMITS, folder)
    got = statuses(run)
    assert len(got) == 60 and {state for state, _ in got.values()} == {"completed", "failed"}
    assert got["work_000025"] == ("failed", 3) and got["work_000012"] == ("completed", 2)
    assert got["work_000040"] == ("completed", 2) and got["work_000045"] == ("completed", 1)
    results = run.results()
    assert ran <= {tuple(r) for r in results.select("work_item_id", "round", "batch_id").collect()}
    once = results.where("attempt_number = 1")
    assert once.count() == once.select("work_item_id").distinct().count() == 60
    batches = once.select("job_id", "batch_id", "round", "queue_pos").distinct()
    assert batches.count() == batches.select("job_id", "batch_id").distinct().count()
    assert {(r["job_id"], r["batch_id"]) for r in batches.where("round > 1").collect()} == {
        *(("a", f"batch_{i:03}") for i in range(5, 9)), *(("b", f"batch_{i:03}") for i in range(1, 5))
    }
    assert {r["job_id"]: r["open_batches"] for r in run.outcome().collect()} == {"a": 0, "b": 0}
    log = run.events().collect()
    assert sorted(r["job_id"] for r in log if r["event_type"] == "job_started") == ["a", "b"]
    assert sorted(r["job_id"] for r in log if r["event_type"] == "job_finished") == ["a", "b"]
    assert run_rounds(items, flaky, OUT, LIMITS, folder).results().count() == results.count()


def test_a_run_stored_before_rounds_had_a_first_round(spark, items, folder):
    first = run_rounds(items.where("ord < 40"), flaky, OUT, LIMITS, f"{folder}/new", stop_after=1)
    for table in ("queue", "results"):
        old = spark.read.parquet(first.folder(table, 1)).drop("first_round")
        old.write.parquet(f"{folder}/old/{table}/attempt_number=1")
    spark.read.parquet(f"{folder}/new/commits").write.parquet(f"{folder}/old/commits")
    old = Rounds(spark, f"{folder}/old", items)
    assert statuses(old)["work_000025"] == ("pending", 1) and statuses(old)["work_000040"] == ("pending", 0)
    check_finished(run_rounds(items, flaky, OUT, LIMITS, f"{folder}/old"))


def test_event_log_and_checkpoints(spark, items, folder):
    run_rounds(items, flaky, OUT, LIMITS, f"{folder}/run", stop_after=1)
    run = run_rounds(items, flaky, OUT, LIMITS, f"{folder}/run")
    append_events(run.events(), f"{folder}/scheduler_events")
    log = read_rows(spark, f"{folder}/scheduler_events", "a").orderBy("event_id").collect()
    kinds = [r["event_type"] for r in log]
    assert kinds[0] == "job_started" and kinds[-1] == "job_finished"
    assert kinds.count("batch_dispatched") == run.attempts().where("job_id = 'a'").count()
    assert kinds.count("checkpoint_saved") == 3 and kinds.count("job_resumed") == 1
    requeued = [r for r in log if r["event_type"] == "batch_requeued"]
    assert [(r["batch_id"], r["virtual_window"]) for r in requeued] == [
        ("batch_001", 1),
        ("batch_008", 1),
        ("batch_008", 2),
    ]
    assert json.loads(requeued[0]["details_json"]) == {"attempt_count": 1, "error_code": "TIMEOUT"}
    missing = [r["batch_id"] for r in log if r["event_type"] == "missing_outputs_requeued"]
    assert missing == ["batch_003", "batch_006", "retry_002"]
    assert "HIDDEN" not in str(log)
    ids = [r["event_id"] for r in run.events().orderBy("event_id").collect()]
    assert ids == list(range(1, len(ids) + 1))

    attempts = run.attempt_log().orderBy("attempt_id").collect()
    assert [r["attempt_id"] for r in attempts] == list(range(1, len(attempts) + 1))
    for attempt in (1, 3):
        append_checkpoint(*run.as_of(attempt).checkpoint(), folder)
    last = latest_checkpoint(read_rows(spark, f"{folder}/checkpoints")).where("job_id = 'a'").first()
    assert (last["virtual_window"], last["queued_batches"]) == (3, 0)
    assert (last["completed_work_items"], last["failed_work_items"]) == (34, 6)
    ids = read_rows(spark, f"{folder}/checkpoint_batches", "a").where("checkpoint_id = 1")
    assert ids.where("kind = 'queued'").count() == 4


def test_missing_items_fail_without_requeue(items, folder):
    run = run_rounds(items, flaky, OUT, LIMITS, folder, requeue_missing=False)
    got = statuses(run)
    assert got["work_000012"] == ("failed", 1) and got["work_000025"] == ("failed", 1)
    assert run.batches().where("batch_id LIKE 'retry%'").count() == 0


def test_run_without_trouble_ends_after_one_round(items, folder):
    run = run_rounds(items, echo_fn, ECHO_SCHEMA, LIMITS, folder)
    assert run.committed() == {1: 0}
    assert set(statuses(run).values()) == {("completed", 1)}
    assert run.results().where("input_tokens_used <> estimated_input_tokens").count() == 0


def test_payload_is_used_but_not_stored(spark, items, folder):
    texts = items.select("job_id", "work_item_id", F.lit("HIDDEN").alias("text"))

    def upper(key, frame):
        assert (frame["text"] == "HIDDEN").all()
        return answers(frame[: key["attempt_number"] + 2])

    run = run_rounds(items, upper, OUT, LIMITS, folder, payload=texts)
    assert set(statuses(run).values()) == {("completed", 1), ("completed", 2)}
    assert "text" not in spark.read.parquet(f"{folder}/queue").columns
    assert "text" not in run.results().columns


def test_nothing_ran_yet(spark, items, folder):
    assert Rounds(spark, folder, items).committed() == {}


def test_big_numbers_and_gaps_survive(spark):
    sent = spark.createDataFrame(
        [("j", "b", 1, f"w{i}", i, 5) for i in range(3)],
        "job_id string, batch_id string, attempt_number int, work_item_id string, pos int, "
        "estimated_input_tokens long",
    )

    def fn(key, frame):
        return pd.DataFrame(
            {"work_item_id": ["w2", "w0"], "n": [2**62 + 1, 3], "answer": ["two", None]}
        )

    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("answer", T.StringType())])
    rows = apply_batches(sent, fn, out).orderBy("pos").collect()
    assert [(r["n"], r["answer"], r["outcome"]) for r in rows] == [
        (3, None, "completed"),
        (None, None, "missing"),
        (2**62 + 1, "two", "completed"),
    ]


def test_apply_accounts_for_every_item(spark):
    rows = [("j", f"b{b}", 1, f"w{b}{i}", i, 5) for b in range(4) for i in range(3)]
    sent = spark.createDataFrame(
        rows,
        "job_id string, batch_id string, attempt_number int, work_item_id string, pos int, "
        "estimated_input_tokens long",
    )

    def fn(key, frame):
        assert frame["pos"].tolist() == [0, 1, 2]
        if key["batch_id"] == "b1":
            return pd.DataFrame({"work_item_id": ["unknown"], "answer": ["x"]})
        if key["batch_id"] == "b2":
            return answers(frame).assign(failed=[True, False, False])
        if key["batch_id"] == "b3":
            return answers(frame[:0])
        return answers(frame)

    got = {r["batch_id"]: r for r in attempts_of(apply_batches(sent, fn, OUT)).collect()}
    counts = {b: (r["status"], r["n_completed"], r["n_missing"], r["n_failed"]) for b, r in got.items()}
    assert counts == {
        "b0": ("succeeded", 3, 0, 0),
        "b1": ("failed", 0, 0, 3),
        "b2": ("partially_succeeded", 2, 0, 1),
        "b3": ("partially_succeeded", 0, 3, 0),
    }
    assert got["b1"]["error_code"] == "BATCH_FAILED"


def lanes_of(spark, *rows):
    return spark.createDataFrame(
        rows,
        "lane_id string, hard_input_token_cap long, daily_request_limit long, daily_token_limit long",
    )


def test_attempts_have_lanes_and_windows(spark, items, folder):
    lanes = lanes_of(spark, ("x", 60, None, None), ("y", 60, None, None))
    run_rounds(items, flaky, OUT, LIMITS, f"{folder}/run", lanes=lanes, stop_after=1)
    run = run_rounds(items, flaky, OUT, LIMITS, f"{folder}/run", lanes=lanes)
    check_finished(run)
    log = [r for r in run.attempt_log().orderBy("attempt_id").collect() if r["job_id"] == "a"]
    assert [(r["batch_id"], r["lane_id"], r["virtual_window"]) for r in log[:8]] == [
        (f"batch_00{i + 1}", "xy"[i % 2], i // 2) for i in range(8)
    ]
    assert [(r["batch_id"], r["attempt_number"], r["lane_id"], r["virtual_window"]) for r in log[8:]] == [
        ("batch_001", 2, "x", 4), ("retry_001", 2, "y", 4), ("retry_002", 2, "x", 5), ("batch_008", 2, "y", 5),
        ("retry_003", 3, "x", 6), ("batch_008", 3, "y", 6),
    ]
    assert len({(r["lane_id"], r["virtual_window"]) for r in log}) == len(log)
    totals = {r["lane_id"]: r for r in audit.lane_totals(run.attempt_log().where("job_id = 'a'")).collect()}
    assert sorted(totals) == ["x", "y"]
    events = [r for r in run.events().orderBy("event_id").collect() if r["job_id"] == "a"]
    sent = [(r["lane_id"], r["virtual_window"]) for r in events if r["event_type"] == "batch_dispatched"]
    assert sorted(sent) == sorted((r["lane_id"], r["virtual_window"]) for r in log)
    assert [r["virtual_window"] for r in events if r["event_type"] == "checkpoint_saved"] == [3, 5, 6]
    assert [r["virtual_window"] for r in events if r["event_type"] == "job_finished"] == [6]


def test_lanes_with_daily_limits_and_too_small_ones(spark, items, folder):
    lanes = lanes_of(spark, ("x", 60, 3, None), ("y", 60, None, 100), ("z", 5, None, None))
    run = run_rounds(items, echo_fn, ECHO_SCHEMA, LIMITS, f"{folder}/two", lanes=lanes)
    log = run.attempt_log().where("job_id = 'a'").collect()
    placed = sorted((r["virtual_window"], r["lane_id"]) for r in log)
    # batches of 50 tokens: y takes two a day, and x as many, since limits are those of the class
    assert placed == [(day * 1440 + i, lane) for day in range(2) for i in range(2) for lane in "xy"]
    none = run_rounds(items, echo_fn, ECHO_SCHEMA, LIMITS, f"{folder}/none", lanes=lanes.where("lane_id = 'z'"))
    assert {(r["lane_id"], r["virtual_window"]) for r in none.attempt_log().collect()} == {(None, None)}
    assert set(statuses(none).values()) == {("completed", 1)}


def test_checkpoint_events_are_running_totals(items, folder):
    run = run_rounds(items, flaky, OUT, LIMITS, folder)
    events = run.events().where("event_type = 'checkpoint_saved'").collect()
    found = {(r["job_id"], r["virtual_window"]): json.loads(r["details_json"]) for r in events}
    assert sorted(found) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    for number in (1, 2, 3):
        for row in run.as_of(number).checkpoint()[0].collect():
            if (row["job_id"], number) in found:
                details = found[row["job_id"], number]
                assert details == {name: row[name] for name in details} and len(details) == 5


def test_changed_items_are_reported_and_do_not_run(spark, items, folder):
    hashed = items.withColumn("input_text_hash", F.sha2("work_item_id", 256))
    ran = f"{folder}/run"
    run_rounds(hashed.where("ord <> 59"), flaky, OUT, LIMITS, ran, stop_after=1)
    # 12 and 25 are missing, batches 1 (0 to 4) and 8 (35 to 39) of job a failed, and 10 is done
    ids = ("work_000012", "work_000001", "work_000010", *(f"work_0000{i}" for i in range(35, 40)))
    edited = F.when(F.col("work_item_id").isin(*ids), "other").otherwise(F.col("input_text_hash"))
    run = run_rounds(hashed.withColumn("input_text_hash", edited), flaky, OUT, LIMITS, ran)
    assert {r["work_item_id"] for r in run.changed().collect()} == set(ids)
    assert {r["resubmitted_hash"] for r in run.changed().collect()} == {"other"}
    got = statuses(run)
    assert got["work_000012"] == got["work_000001"] == got["work_000037"] == ("pending", 1)
    assert got["work_000010"] == ("completed", 1) and got["work_000000"] == ("completed", 2)
    assert got["work_000025"] == ("failed", 3) and got["work_000059"] == ("completed", 1)
    again = run.results().where("attempt_number > 1").select("work_item_id").distinct().collect()
    assert not {r["work_item_id"] for r in again} & set(ids)
    outcome = {r["job_id"]: (r["status"], r["open_batches"] > 0) for r in run.outcome().collect()}
    assert outcome == {"a": ("partially_completed", True), "b": ("completed", False)}
    open_batches = {r["batch_id"] for r in run.batches().where("status = 'queued'").collect()}
    assert open_batches == {"batch_008"}
    with pytest.raises(ValueError, match="was packed with"):
        run_rounds(hashed, flaky, OUT, PackLimits(40, 60, 5), ran)


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_only_buckets_that_differ_are_compared(items, folder, monkeypatch, size):
    monkeypatch.setattr(rounds, "BUCKET_ITEMS", size)
    hashed = items.withColumn("input_text_hash", F.sha2("work_item_id", 256))
    run_rounds(hashed, echo_fn, ECHO_SCHEMA, LIMITS, folder)
    same = Rounds(items.sparkSession, folder, hashed)
    assert same.differences().collect() == []
    edited = F.when(F.col("ord") == 7, "other").otherwise(F.col("input_text_hash"))
    found = Rounds(items.sparkSession, folder, hashed.withColumn("input_text_hash", edited)).differences()
    verdicts = {r["work_item_id"]: r["verdict"] for r in found.collect()}
    assert verdicts.pop("work_000007") == "changed" and set(verdicts.values()) <= {"match"}
    assert len(verdicts) == 59 if size > 60 else len(verdicts) < 20
