import pytest
from pyspark.sql import functions as F

from batchloom.operators import audit
from batchloom.operators.outcomes import latest_checkpoint, upsert
from batchloom.schemas import ATTEMPTS, JOBS, UPDATE_COLS, as_table
from batchloom.session import durable, shared_dir
from batchloom.sources import tables as t


def test_tables_by_job(spark, folder):
    rows = [("a=b/c", "w2", 1), ("a=b/c", "w1", 2), ("other", "w1", 3)]
    df = spark.createDataFrame(rows, "job_id string, work_item_id string, n int")
    t.write_table(df, f"{folder}/work_items")
    got = t.read_items(spark, f"{folder}/work_items", "a=b/c")
    assert [(r["work_item_id"], r["n"]) for r in got.collect()] == [("w1", 2), ("w2", 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(job_id" in plan
    attempts = df.select("job_id", F.col("n").alias("attempt_id"), F.lit("failed").alias("status"))
    t.append_attempts(attempts, f"{folder}/batch_attempts")
    t.append_attempts(attempts, f"{folder}/batch_attempts")
    assert t.read_rows(spark, f"{folder}/batch_attempts", "other").count() == 2
    assert set(t.read_rows(spark, f"{folder}/batch_attempts").columns) == set(ATTEMPTS.fieldNames())
    with pytest.raises(ValueError, match="no columns"):
        t.append_attempts(df, f"{folder}/batch_attempts")

    t.reset_job(spark, folder, "a=b/c")
    for table in ("work_items", "batch_attempts"):
        left = t.read_rows(spark, f"{folder}/{table}")
        assert {r["job_id"] for r in left.collect()} == {"other"}
    t.reset_job(spark, folder, "unknown")
    t.append_attempts(attempts, f"{folder}/batch_attempts")
    assert t.read_rows(spark, f"{folder}/batch_attempts", "a=b/c").count() == 2


def test_versions(spark, folder):
    assert t.current_version(spark, folder) is None
    t.write_version(spark.range(3), folder, 1)
    t.write_version(t.read_version(spark, folder).where("id > 0"), folder, 2)
    assert t.read_version(spark, folder).count() == 2
    assert t.read_version(spark, folder, 1).count() == 3
    t.write_version(spark.range(7), folder, 2)  # done again after a crash
    assert t.read_version(spark, folder).count() == 7


def test_durable_keeps_rows_and_partitions(spark):
    df = spark.range(100, numPartitions=7).withColumn("part", F.spark_partition_id())
    kept = durable(df)
    assert kept.rdd.getNumPartitions() == 7
    assert kept.where(F.col("part") != F.spark_partition_id()).count() == 0


def test_shared_folder_is_named_by_the_cluster_or_below_the_warehouse():
    def folder(named, current=None):
        class Context:
            def getCheckpointDir(self):
                return current

            def setCheckpointDir(self, path):
                self.path = path

        class Conf:
            def get(self, name, default=None):
                return {"spark.sql.warehouse.dir": "s3://w/", "spark.checkpoint.dir": named}[name]

        class Session:
            sparkContext, conf = Context(), Conf()

        return shared_dir(Session())

    assert folder("hdfs:///shared") == "hdfs:///shared"
    assert folder(None, "/c/1") == "/c/1"
    assert folder(None) == "s3://w/batchloom-checkpoints"


def test_job_ids_are_text(spark, folder):
    rows = [("007", "a"), ("7", "b"), ("1e3", "c")]
    t.write_table(spark.createDataFrame(rows, "job_id string, work_item_id string"), f"{folder}/work_items")
    t.write_table(spark.createDataFrame(rows, "job_id string, lane_id string"), f"{folder}/lanes")
    read = lambda *job: {tuple(r) for r in t.read_rows(spark, f"{folder}/work_items", *job).select("job_id", "work_item_id").collect()}
    assert read() == set(rows) and read("007") == {("007", "a")} and read("7") == {("7", "b")}
    t.reset_job(spark, folder, "007")
    assert read() == set(rows[1:])
    assert {r["job_id"] for r in t.read_rows(spark, f"{folder}/lanes").collect()} == {"7", "1e3"}


def test_details_that_cannot_be_parsed_are_marked(spark, folder):
    rows = [("j", 1, '{"secret": "HIDDEN", "n": 1}'), ("j", 2, "HIDDEN {"), ("j", 3, None)]
    t.append_events(spark.createDataFrame(rows, "job_id string, event_id long, details_json string"), folder)
    got = {r["event_id"]: (r["details_json"], r["details_unparsed"]) for r in t.read_rows(spark, folder).collect()}
    assert got == {1: ('{"n": 1}', False), 2: ("{}", True), 3: ("{}", False)}


def test_checkpoints_are_read_back(spark, folder):
    items = spark.createDataFrame([("j", "completed"), ("j", "pending")], "job_id string, status string")
    batches = spark.createDataFrame(
        [("j", "b1", "completed"), ("j", "b2", "queued")],
        "job_id string, batch_id string, status string",
    )
    for number in (1, 2):
        mark = F.lit(number).alias("checkpoint_id")
        t.append_checkpoint(
            audit.checkpoint_snapshot(items, batches, window=number * 10).select("*", mark),
            audit.checkpoint_batches(batches).select("*", mark),
            folder,
        )
    last = latest_checkpoint(t.read_rows(spark, f"{folder}/checkpoints")).first()
    assert (last["job_id"], last["checkpoint_id"], last["virtual_window"]) == ("j", 2, 20)
    assert (last["queued_batches"], last["completed_work_items"]) == (1, 1)
    queued = t.read_rows(spark, f"{folder}/checkpoint_batches", "j").where(
        f"checkpoint_id = {last['checkpoint_id']} AND kind = 'queued'"
    )
    assert [r["batch_id"] for r in queued.collect()] == ["b2"]


def test_jobs_round_trip(spark, folder):
    items = spark.createDataFrame(
        [("j", "w1", 100), ("j", "w2", 50)],
        "job_id string, work_item_id string, estimated_input_tokens long",
    )
    now = F.lit("2024-01-01").cast("timestamp")
    started = audit.new_jobs(items, "summaries", now)
    assert started.schema.simpleString() == JOBS.simpleString()
    t.write_version(started, folder, 1)
    later = F.lit("2024-01-02").cast("timestamp")
    change = started.withColumns(
        {"job_type": F.lit("x"), "status": F.lit("completed"), "created_at": later, "updated_at": later}
    )
    t.write_version(
        upsert(t.read_version(spark, folder), change, ["job_id"], UPDATE_COLS["jobs"]), folder, 2
    )
    row = t.read_version(spark, folder).first()
    assert (row["job_type"], row["status"], row["total_estimated_input_tokens"]) == (
        "summaries",
        "completed",
        150,
    )
    assert row["created_at"] < row["updated_at"]
    assert as_table(spark.range(1).select(F.lit("a").alias("job_id")), "jobs").first()["status"] is None


def test_a_part_that_is_added_again_replaces_itself(spark, folder):
    from batchloom.operators.audit import checkpoint_batches, checkpoint_snapshot

    schema = "job_id string, batch_id string, attempt_id long, status string"
    first = spark.createDataFrame([("007", "b1", 1, "failed"), ("x/y", "b2", 2, "succeeded")], schema)
    second = spark.createDataFrame([("007", "b1", 3, "succeeded")], schema)
    root = f"{folder}/tables"
    path = f"{root}/batch_attempts"
    for _ in range(2):
        t.append_attempts(first, path, run="1", epoch=0)
        t.append_attempts(second, path, run="1", epoch=1)
    t.append_attempts(second.withColumn("attempt_id", t.F.lit(4).cast("long")), path, run="2", epoch=1)
    rows = lambda: sorted((r["job_id"], r["attempt_id"]) for r in t.read_rows(spark, path).collect())
    assert rows() == [("007", 1), ("007", 3), ("007", 4), ("x/y", 2)]
    assert t.read_rows(spark, path, "007").columns == t.read_rows(spark, path).columns
    assert not {"run", "epoch"} & set(t.read_rows(spark, path).columns)
    t.reset_job(spark, root, "007")
    assert rows() == [("x/y", 2)]
    t.append_attempts(second, path, run="1", epoch=1)
    assert rows() == [("007", 3), ("x/y", 2)]

    items = spark.createDataFrame([("j", "w1", "completed", 5)], "job_id string, work_item_id string, status string, estimated_input_tokens long")
    batches = spark.createDataFrame([("j", "b1", "queued"), ("j", "b2", "completed")], "job_id string, batch_id string, status string")
    for _ in range(2):
        t.append_checkpoint(checkpoint_snapshot(items, batches, 1), checkpoint_batches(batches), root, run="1", epoch=1)
    assert t.read_rows(spark, f"{root}/checkpoints").count() == 1
    assert t.read_rows(spark, f"{root}/checkpoint_batches").count() == 2
