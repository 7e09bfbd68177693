import random

import pytest
from pyspark.sql import functions as F

from batchloom.operators import ordered
from batchloom.operators.items import reject_oversize, split_oversize
from batchloom.operators.packing import (
    batch_fill,
    batch_totals,
    collect_batches,
    explode_batches,
    pack_items,
    pack_items_by,
    pack_totals,
)
from batchloom.plans.lanes import plan_waves
from batchloom.operators.audit import wave_stats
from batchloom.queries.views import lane_rows
from batchloom.schemas import PackLimits
from model import DEMO_JOB, SMALL_JOB, one_by_one, seeded_tokens

SCHEMA = "job_id string, ord long, work_item_id string, estimated_input_tokens long"


def items_of(spark, jobs: dict, shuffle=True):
    rows = [(job, i, f"{job}/{i}", t) for job, ts in jobs.items() for i, t in enumerate(ts)]
    if shuffle:
        random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def placed(packed):
    return {r["work_item_id"]: (r["batch_seq"], r["pos"]) for r in packed.collect()}


def expected(jobs, limits):
    return {
        f"{job}/{i}": place
        for job, tokens in jobs.items()
        for i, place in enumerate(one_by_one(tokens, limits))
    }


@pytest.mark.parametrize("partitions", [1, 3, 20, 60])
@pytest.mark.parametrize(
    "limits",
    [
        PackLimits(30, 40, 5),
        PackLimits(30, 40, 5, allow_overflow=False),
        PackLimits(400, 450, 100),
        PackLimits(9, 9, 1),
    ],
)
def test_one_hot_job_among_many(spark, monkeypatch, limits, partitions):
    """A third of all rows in one job, constant sizes in another, jobs of one item."""
    monkeypatch.setattr(ordered, "FANOUT", 4)
    rng = random.Random(partitions)
    jobs = {"hot": [rng.randint(1, 9) for _ in range(300)], "flat": [3] * 200}
    jobs |= {f"j{k}": [rng.randint(1, 9) for _ in range(rng.randint(1, 12))] for k in range(60)}
    packed = pack_items_by(
        items_of(spark, jobs), ["job_id"], ["ord"], limits, partitions=partitions, piece_rows=97
    )
    assert placed(packed) == expected(jobs, limits)
    columns = ["job_id", "batch_seq", "batch_id", "estimated_input_tokens", "n_items"]
    options = {"group_cols": ["job_id"], "partitions": partitions, "piece_rows": 97}
    totals = pack_totals(items_of(spark, jobs), ["ord"], limits, **options)
    assert {tuple(r) for r in totals.select(columns).collect()} == {
        tuple(r) for r in batch_totals(packed, ["job_id"]).select(columns).collect()
    }
    batches = pack_totals(items_of(spark, jobs), ["ord"], limits, with_ids=True, **options)
    collected = collect_batches(packed, ["job_id"])
    assert sorted(map(str, batches.select(collected.columns).collect())) == sorted(
        map(str, collected.collect())
    )


@pytest.mark.parametrize("partitions", [2, 7, 40])
def test_one_job_over_partitions_smaller_than_a_batch(spark, monkeypatch, partitions):
    monkeypatch.setattr(ordered, "FANOUT", 3)
    jobs = {"a": [random.Random(3).randint(1, 4) for _ in range(500)]}
    for limits in (PackLimits(300, 330, 200), PackLimits(10_000, 11_000, 10_000)):
        packed = pack_items(items_of(spark, jobs), ["ord"], limits, partitions=partitions)
        assert placed(packed) == expected(jobs, limits)


def part_files(df):
    return {file for file in df.inputFiles() if "/runs-" in file}


def test_totals_of_small_pieces_that_share_files(spark, monkeypatch):
    """Files follow the rows, not the pieces; jobs and batches run over several pieces and files."""
    monkeypatch.setattr(ordered, "FILE_ROWS", 64, raising=False)
    rng = random.Random(5)
    jobs = {"hot": [rng.randint(1, 9) for _ in range(700)]}
    jobs |= {f"j{k}": [rng.randint(1, 9) for _ in range(rng.randint(1, 12))] for k in range(40)}
    limits = PackLimits(100, 110, 30)
    options = {"partitions": 3, "piece_rows": 3, "fanout": 4}
    totals = pack_totals(items_of(spark, jobs), ["ord"], limits, group_cols=["job_id"], **options)
    n = sum(map(len, jobs.values()))
    assert 3 < len(part_files(totals)) <= n // 63 + 3
    batches = {}
    for job, tokens in jobs.items():
        for (seq, _), own in zip(one_by_one(tokens, limits), tokens):
            n_items, total = batches.get((job, seq), (0, 0))
            batches[job, seq] = (n_items + 1, total + own)
    assert {
        (r["job_id"], r["batch_seq"]): (r["n_items"], r["estimated_input_tokens"])
        for r in totals.collect()
    } == batches


def test_items_of_small_pieces_when_joins_become_broadcasts(spark):
    """Batches over several pieces keep their numbers when Spark reads shuffles by mapper."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in conf}
    rng = random.Random(6)
    jobs = {"a": [rng.randint(1, 9) for _ in range(1000)]}
    limits = PackLimits(100, 110, 30)
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        packed = pack_items(
            items_of(spark, jobs), ["ord"], limits, partitions=3, piece_rows=3, fanout=4
        )
        assert len(part_files(packed)) == 3
        assert placed(packed) == expected(jobs, limits)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_null_jobs_and_two_group_columns(spark):
    rows = [(g, h, i, f"{g}{h}{i}", 4) for g in (None, "x") for h in (1, None) for i in range(5)]
    df = spark.createDataFrame(
        rows, "g string, h int, ord long, work_item_id string, estimated_input_tokens long"
    )
    packed = pack_items_by(df, ["g", "h"], ["ord"], PackLimits(8, 8, 9), partitions=3)
    for row in packed.collect():
        assert row["batch_seq"] == row["ord"] // 2 + 1


def test_demo_job_and_its_waves(spark):
    jobs = {"demo": seeded_tokens(*DEMO_JOB)}
    packed = pack_items(items_of(spark, jobs), ["ord"], PackLimits(), partitions=6)
    batches = batch_totals(packed)
    fill = batch_fill(batches, PackLimits()).first()
    assert (fill["n_batches"], fill["over_cap"]) == (31, 0)
    assert batches.agg(F.sum("estimated_input_tokens")).first()[0] == 6_779_991
    full = batches.where("batch_seq < 31").agg(
        F.min("estimated_input_tokens"), F.max("estimated_input_tokens")
    )
    assert tuple(full.first()) == (224_220, 224_930)
    lanes = lane_rows(spark, [240_000] * 4, [None] * 4)
    stats = wave_stats(plan_waves(batches, lanes)).first()
    assert tuple(stats) == (4, 8, 8)


def test_small_job_batches(spark):
    jobs = {"small": seeded_tokens(*SMALL_JOB)}
    packed = pack_items(items_of(spark, jobs), ["ord"], PackLimits(), group_cols=["job_id"])
    rows = collect_batches(packed, ["job_id"]).orderBy("batch_seq").collect()
    assert [(r["n_items"], r["estimated_input_tokens"]) for r in rows] == [
        (324, 224_674),
        (328, 224_800),
        (48, 33_190),
    ]
    assert [r["batch_id"] for r in rows] == ["batch_001", "batch_002", "batch_003"]
    assert rows[1]["work_item_ids"] == [f"small/{i}" for i in range(324, 652)]
    assert {r["status"] for r in rows} == {"queued"}
    again = explode_batches(collect_batches(packed, ["job_id"]), "batch_id")
    assert again.where("batch_id = 'batch_002' AND pos = 0").first()["work_item_id"] == "small/324"


def test_order_start_index_and_prefix(spark):
    df = items_of(spark, {"a": [5, 5, 5]})
    packed = pack_items(
        df, ["work_item_id"], PackLimits(5, 5, 9), start_index=999, prefix="part"
    )
    ids = {r["work_item_id"]: r["batch_id"] for r in packed.collect()}
    assert ids == {"a/0": "part_999", "a/1": "part_1000", "a/2": "part_1001"}


def test_ties_are_taken_by_id(spark):
    rows = [("j", i // 50, f"w{i:03d}", i % 7 + 1) for i in range(200)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    limits = PackLimits(20, 25, 6)
    got = placed(pack_items(df, ["ord"], limits, partitions=5, piece_rows=30))
    places = one_by_one([i % 7 + 1 for i in range(200)], limits)
    assert got == {f"w{i:03d}": place for i, place in enumerate(places)}


def test_empty_input(spark):
    packed = pack_items(spark.createDataFrame([], SCHEMA), ["ord"], PackLimits())
    assert packed.count() == 0 and collect_batches(packed).count() == 0


@pytest.mark.parametrize("tokens", [250_001, 0, -1, None])
def test_items_that_fit_no_batch_are_named(spark, tokens):
    df = spark.createDataFrame([("j", 0, "w1", tokens)], SCHEMA)
    with pytest.raises(Exception, match="w1 has"):
        pack_items(df, ["ord"], PackLimits())


def test_oversize_items_are_split_off_or_rejected(spark):
    df = items_of(spark, {"a": [10, 240_000, 240_001]})
    fits, rejected = split_oversize(df, 240_000)
    assert fits.count() == 2
    assert [r["work_item_id"] for r in rejected.collect()] == ["a/2"]
    assert reject_oversize(fits, 240_000).count() == 2
    with pytest.raises(Exception, match="a/2 has 240001 tokens"):
        reject_oversize(df, 240_000).collect()
