import json
import os
import time
from datetime import datetime, timedelta

import pytest

from batchloom.operators.outcomes import latest_per_key
from batchloom.operators.packing import pack_items
from batchloom.queries.stream_queries import run_to_end, stream, stream_pack
from batchloom.queries.views import LIMITS
from batchloom.schemas import PackLimits
from batchloom.sources.tables import write_version
from batchloom.streaming.outputs import compact_status, read_status, redact_stream, status_sink
from batchloom.streaming.packing import pack_sink, read_packs, tail_packs
from batchloom.streaming.usage import lane_state_stream, quota_usage_stream
from model import one_by_one

START = datetime(2024, 1, 1)


def files(spark, folder, schema, *pieces):
    """A file stream that reads each piece as its own micro-batch, in the order given."""
    os.makedirs(f"{folder}/in", exist_ok=True)
    for number, rows in enumerate(pieces):
        name = f"{folder}/in/{number:03d}.json"
        names = [part.split()[0] for part in schema.split(", ")]
        with open(name, "w") as out:
            for row in rows:
                out.write(json.dumps(dict(zip(names, row)), default=str) + "\n")
        stamp = time.time() - 1000 + 10 * number
        os.utime(name, (stamp, stamp))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return source.json(f"{folder}/in")


ITEM = "job_id string, ord long, work_item_id string, estimated_input_tokens long"


def item(job, ord_, tokens):
    return (job, ord_, f"{job}/{ord_}", tokens)


def test_packing_over_micro_batches(spark, folder):
    limits = PackLimits(20, 25, 4)
    tokens = {"a": [(7 * i) % 9 + 1 for i in range(40)], "b": [3] * 25, "c": [25, 1, 25]}
    pieces = [
        # in order, then a gap that the next piece fills, then the rest backwards
        [item("a", i, tokens["a"][i]) for i in range(13)],
        [item("a", i, tokens["a"][i]) for i in range(16, 30)] + [item("c", 1, 1)],
        [item("a", i, tokens["a"][i]) for i in (15, 14, 13)] + [item("b", 0, 3)],
        [item("a", i, tokens["a"][i]) for i in range(39, 29, -1)],
        [item("b", i, 3) for i in range(1, 25)] + [item("c", 0, 25), item("a", 2, 1)],
        [item("c", 2, 25)],
    ]
    rows = files(spark, folder, ITEM, *pieces)
    run_to_end(rows, folder, pack_sink(folder, limits))
    packed = read_packs(spark, folder).unionByName(tail_packs(spark, folder, limits))
    got = {r["work_item_id"]: (r["batch_seq"], r["pos"]) for r in packed.collect()}
    expected = {
        f"{job}/{i}": place
        for job, ts in tokens.items()
        for i, place in enumerate(one_by_one(ts, limits))
    }
    assert got == expected and packed.count() == len(expected)
    late = spark.read.parquet(f"{folder}/late").collect()
    assert [r["work_item_id"] for r in late] == ["a/2"]


def test_a_repeated_epoch_changes_nothing(spark, folder):
    limits = PackLimits(10, 10, 3)
    sink = pack_sink(folder, limits)
    first = spark.createDataFrame([item("a", i, 4) for i in range(5)], ITEM)
    second = spark.createDataFrame([item("a", i, 4) for i in range(5, 9)], ITEM)
    sink(first, 0)
    sink(second, 1)
    before = sorted(map(tuple, read_packs(spark, folder).collect()))
    sink(second, 1)
    assert sorted(map(tuple, read_packs(spark, folder).collect())) == before
    # from a new checkpoint all of it comes once more, and is late
    again = pack_sink(folder, limits, stream="again")
    again(first, 0)
    again(second, 1)
    everything = read_packs(spark, folder).unionByName(tail_packs(spark, folder, limits))
    expected = pack_items(first.unionByName(second), ["ord"], limits, group_cols=["job_id"])
    assert sorted(map(tuple, everything.collect())) == sorted(
        map(tuple, expected.select(*everything.columns).collect())
    )


ATTEMPT = (
    "lane_id string, virtual_window long, status string, input_tokens long, created_at timestamp"
)


def attempt(lane, minute, status="succeeded", tokens=10):
    return (lane, minute, status, tokens, (START + timedelta(minutes=minute, seconds=1)).isoformat())


PIECES = [
    [attempt("a", 0), attempt("a", 0), attempt("b", 1, "failed"), attempt("hot", 2)],
    [attempt("hot", 2, tokens=7)] * 50 + [attempt("b", 4)],
    [attempt("c", 30)],
    [attempt("c", 31), attempt("d", 31)],
]


def test_usage_per_minute(spark, folder):
    usage = quota_usage_stream(files(spark, folder, ATTEMPT, *PIECES), "5 minutes")
    run_to_end(usage, folder)
    rows = spark.read.parquet(f"{folder}/out").collect()
    got = {
        (r["lane_id"], int((r["minute"] - START).total_seconds()) // 60): (r["requests"], r["tokens"])
        for r in rows
    }
    # minutes after the watermark are still open
    assert got == {("a", 0): (2, 20), ("b", 1): (1, 10), ("hot", 2): (51, 360), ("b", 4): (1, 10)}


def test_lane_states(spark, folder):
    rows = files(spark, folder, ATTEMPT, *PIECES)

    def keep(changes, epoch):
        changes.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    run_to_end(lane_state_stream(rows, START, delay="5 minutes"), folder, keep, mode="update")
    changes = spark.read.parquet(f"{folder}/out")
    states = {r["lane_id"]: r for r in latest_per_key(changes, ["lane_id"], "as_of_window").collect()}
    assert {lane: r["state"] for lane, r in states.items()} == {
        "a": "ready",
        "b": "failed",
        "hot": "ready",
        "c": "cooldown",
        "d": "cooldown",
    }
    assert (states["hot"]["requests_used"], states["hot"]["input_tokens_used"]) == (51, 360)
    assert states["b"]["failure_count"] == 1 and states["b"]["last_request_window"] == 4
    assert states["c"]["cooldown_until_window"] == 32
    assert changes.where("lane_id = 'a' AND state = 'cooldown'").count() == 1


def test_status_updates(spark, folder):
    schema = "job_id string, work_item_id string, status string, event_id long"
    start = spark.createDataFrame([("j", "a", "pending", 0), ("j", "b", "pending", 0)], schema)
    write_version(start, f"{folder}/items", 0)
    pieces = [
        [("j", "a", "processing", 1), ("j", "a", "completed", 3), ("j", "a", "missing", 2)],
        [("j", "b", "failed", 4), ("j", "new", "pending", 5)],
    ]
    columns = (["job_id", "work_item_id"], ["status", "event_id"], "event_id")
    path = f"{folder}/items"
    sink = status_sink(path, *columns)
    run_to_end(files(spark, folder, schema, *pieces), folder, sink, mode="update")
    expected = {("a", "completed"), ("b", "failed"), ("new", "pending")}
    found = lambda: {(r["work_item_id"], r["status"]) for r in read_status(spark, path, *columns).collect()}
    assert found() == expected
    sink(spark.createDataFrame(pieces[1], schema), 1)
    assert found() == expected
    # an older event that comes later changes nothing, before and after the table was written anew
    late = spark.createDataFrame([("j", "a", "processing", 1)], schema)
    sink(late, 2)
    assert found() == expected
    assert compact_status(spark, path, *columns) == 1
    sink(late, 3)
    assert found() == expected
    # a stream with a new checkpoint begins with epoch 0 again
    again = status_sink(path, *columns)
    again(spark.createDataFrame([("j", "b", "completed", 9)], schema), 0)
    assert found() == {("a", "completed"), ("b", "completed"), ("new", "pending")}


def test_redaction(spark, folder):
    schema = "event_id long, details_json string, prompt string"
    rows = files(spark, folder, schema, [(1, '{"secret": "HIDDEN", "n": 1}', "HIDDEN")])
    run_to_end(redact_stream(rows, ["details_json"]), folder)
    out = spark.read.parquet(f"{folder}/out")
    assert [tuple(r) for r in out.collect()] == [(1, '{"n": 1}')]


TIMED = ITEM + ", time timestamp"


def timed(job, ord_, minute, tokens=4):
    return (*item(job, ord_, tokens), (START + timedelta(minutes=minute)).isoformat())


def test_what_is_missing_is_given_up_after_a_delay(spark, folder):
    limits = PackLimits(8, 10, 3)
    pieces = [
        # item 2 of a is lost; b waits for its first one
        [timed("a", 0, 0), timed("a", 1, 0), timed("a", 3, 1), timed("a", 4, 1), timed("b", 1, 1)],
        [timed("a", 5, 4), timed("a", 7, 9), timed("c", 0, 5)],
        [timed("c", 1, 12), timed("b", 0, 12)],
        [timed("a", 2, 13), timed("c", 3, 30)],
    ]
    sink = pack_sink(folder, limits, time_col="time", delay="10 minutes")
    rows = [spark.createDataFrame([tuple(r[:4]) + (datetime.fromisoformat(r[4]),) for r in p], TIMED) for p in pieces]
    given = lambda: {
        r["work_item_id"]: (r["batch_seq"], r["pos"]) for r in read_packs(spark, folder).collect()
    }
    sink(rows[0], 0)
    assert given() == {"a/0": (1, 0), "a/1": (1, 1)}
    sink(rows[1], 1)
    assert given() == {"a/0": (1, 0), "a/1": (1, 1)}
    sink(rows[2], 2)
    # up to minute 2: a goes on behind the gap; b's items are whole, and its first came in time
    second = {"a/3": (2, 0), "a/4": (2, 1), "b/0": (1, 0), "b/1": (1, 1), "c/0": (1, 0), "c/1": (1, 1)}
    assert given() == {"a/0": (1, 0), "a/1": (1, 1), **second}
    sink(rows[3], 3)
    # up to minute 20: a's tail is given out behind one more gap, c/3 still waits for c/2
    assert given() == {"a/0": (1, 0), "a/1": (1, 1), **second, "a/5": (3, 0), "a/7": (3, 1)}
    late = spark.read.parquet(f"{folder}/late").collect()
    assert [r["work_item_id"] for r in late] == ["a/2"]
    before = given()
    sink(rows[3], 3)
    assert given() == before
    held = tail_packs(spark, folder, limits).collect()
    assert [(r["work_item_id"], r["batch_seq"]) for r in held] == [("c/3", 2)]


DOCUMENT = "doc_id long, n_chars long, source string"
N_CHARS = [(37 * i) % 20_000 for i in range(400)]


def store_documents(spark, folder, layout):
    """400 documents in one of the layouts that a reader of tables takes, beside a table of another name."""
    rows = spark.createDataFrame(
        [(i, n, f"site{i % 3}") for i, n in enumerate(N_CHARS)], DOCUMENT
    )
    path = f"{folder}/documents.parquet"
    if layout == "file":
        os.makedirs(folder)
        rows.toPandas().to_parquet(path)
    elif layout == "folder":
        rows.repartition(7).write.parquet(path)
    else:
        rows.repartition(3).write.partitionBy("source").parquet(path)
    rows.withColumn("doc_id", rows["doc_id"] + 1000).write.parquet(f"{folder}/documents_2.parquet")


@pytest.mark.parametrize("layout", ["file", "folder", "partitions"])
def test_a_table_as_a_stream_has_all_its_rows(spark, folder, layout):
    store_documents(spark, f"{folder}/in", layout)
    rows = stream(spark, f"{folder}/in", "documents").select("doc_id", "n_chars", "source")
    run_to_end(rows, folder)
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
    assert got == [(i, n, f"site{i % 3}") for i, n in enumerate(N_CHARS)]


@pytest.mark.parametrize("layout", ["file", "folder", "partitions"])
def test_documents_in_many_files_are_packed(spark, folder, layout):
    store_documents(spark, folder, layout)
    got = {r["doc_id"]: (r["batch_seq"], r["pos"]) for r in stream_pack(spark, folder).collect()}
    tokens = [max(1, -(-n // 4)) for n in N_CHARS]
    assert got == dict(enumerate(one_by_one(tokens, LIMITS)))
