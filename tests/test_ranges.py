import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.operators import ranges
from batchloom.operators.execute import apply_batches
from batchloom.operators.packing import pack_items
from batchloom.operators.ranges import RANGE, find_cuts, join_in_ranges, joined_by_range, orderable, range_of
from batchloom.operators.rounds import run_rounds
from batchloom.schemas import PackLimits
from batchloom.session import durable

LIMITS = PackLimits(50, 60, 5)
OUT = T.StructType([T.StructField("answer", T.StringType())])


@pytest.fixture(scope="module")
def rows():
    """A job with most items, many small ones, and orders with ties and nulls, which are not those of the ids."""
    rng = random.Random(3)
    jobs = ["big"] * 400 + [f"job {rng.randrange(60)}" for _ in range(200)]
    return [
        (job, f"w{rng.random()}", rng.choice([None, "a", 'b"\\', "ü"]), rng.randrange(40), rng.randrange(1, 30))
        for job in jobs
    ]


@pytest.fixture(scope="module")
def items(spark, rows):
    schema = "job_id string, work_item_id string, part string, no int, estimated_input_tokens long"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def texts(items):
    text = F.concat(F.lit("text of "), "job_id", F.lit(" "), "work_item_id").alias("text")
    return items.select("work_item_id", "job_id", F.col("part").alias("p"), F.col("no").alias("n"), text)


@pytest.fixture(scope="module")
def queue(items):
    packed = pack_items(items, ["part", "no"], LIMITS, group_cols=["job_id"])
    return packed.withColumn("attempt_number", F.lit(1)).withColumnRenamed("batch_seq", "queue_pos")


def joined(queue, texts, partitions=None):
    return join_in_ranges(queue, texts, ["part", "no"], ["p", "n"], partitions=partitions)


def test_batches_lie_whole_in_a_range(spark, queue, texts, items):
    with joined_by_range(spark):
        got = joined(queue, texts).toPandas()
    assert len(got) == items.count()
    assert (got["text"] == "text of " + got["job_id"] + " " + got["work_item_id"]).all()
    assert (got.groupby(["job_id", "batch_id"])[RANGE].nunique() == 1).all()
    assert got[got["job_id"] == "big"][RANGE].nunique() > 20
    assert not {"part", "no", "p", "n"} & set(got.columns)


def test_ranges_are_those_of_the_sorted_cuts(spark, queue, rows, monkeypatch):
    order = ["job_id", "part", "no", "work_item_id"]
    for most in (1, 3, 7, 1000):
        monkeypatch.setattr(ranges, "MOST_RANGES", most)
        cuts, n = find_cuts(queue, order, place="queue_pos")
        got = queue.select(*order, range_of(queue, order, cuts, n).alias("r")).collect()
        numbers = [r["r"] for r in sorted(got, key=lambda r: [(x is not None, x) for x in r[:3]] + [r[3]])]
        assert numbers == sorted(numbers) and max(numbers) == n
        assert set(numbers) | {0} == set(range(n + 1))


def test_text_is_exchanged_once(spark, queue, texts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_by_range(spark):
            moved = joined(durable(queue), durable(texts))
            frame = apply_batches(moved, lambda key, rows: rows[["work_item_id"]], OUT, within=RANGE)
            plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 2 and all(f"hashpartitioning({RANGE}#" in line for line in exchanges), plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


@pytest.mark.parametrize("partitions", [None, 3])
def test_rounds_with_a_payload_in_order(spark, items, texts, folder, partitions):
    def read(key, frame):
        assert set(key) == {"job_id", "batch_id", "attempt_number"}
        assert not {RANGE, "p", "n", "order_0", "order_1"} & set(frame.columns)
        late = (frame["work_item_id"].str[-1] == "7") & (key["attempt_number"] == 1)
        back = frame[~late]
        return pd.DataFrame({"work_item_id": back["work_item_id"], "answer": back["text"]})

    def answers(path, payload, **options):
        run = run_rounds(items, read, OUT, LIMITS, path, order_cols=["part", "no"], payload=payload, **options)
        done = run.results().where("outcome = 'completed'")
        assert done.where("answer <> concat('text of ', job_id, ' ', work_item_id)").isEmpty()
        return sorted(done.select("job_id", "batch_id", "pos", "work_item_id", "answer").collect())

    moved_once = answers(f"{folder}/one", texts, payload_order=["p", "n"], partitions=partitions)
    assert len(moved_once) == items.count()
    if partitions is None:
        assert moved_once == answers(f"{folder}/two", texts.drop("p", "n"))


def test_no_items(spark, queue, texts):
    with joined_by_range(spark):
        assert joined(queue.limit(0), texts).count() == 0
        assert joined(queue, texts.limit(0)).where("text IS NULL").count() == queue.count()


def test_orders_that_cuts_can_be_made_on():
    schema = T.StructType.fromDDL("a bigint, b string, c timestamp, d double, e array<int>")
    assert orderable(schema, ["a", "b", "c"]) and not orderable(schema, ["d"]) and not orderable(schema, ["e"])


def test_times_keep_their_microseconds(spark):
    rows = [("j", f"w{i}", f"2026-01-01 00:00:00.00000{i}", 50) for i in range(8)]
    items = spark.createDataFrame(rows, "job_id string, work_item_id string, t string, estimated_input_tokens long")
    items = items.withColumn("t", F.to_timestamp("t"))
    queue = pack_items(items, ["t"], LIMITS, group_cols=["job_id"]).withColumnRenamed("batch_seq", "queue_pos")
    order = ["job_id", "t", "work_item_id"]
    cuts, n = find_cuts(queue, order)
    got = queue.select("work_item_id", range_of(queue, order, cuts, n).alias("r")).orderBy("work_item_id").collect()
    assert n == 8 and [r["r"] for r in got] == list(range(1, 9))
