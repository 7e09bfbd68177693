import random

import pytest
from pyspark.sql import functions as F

from batchloom.plans.lanes import lane_state_asof
from batchloom.sources.lane_days import lane_state_from_days, put_lane_attempts

ATTEMPT = "job_id string, lane_id string, virtual_window long, status string, input_tokens long, run int"
WINDOWS = (0, 9, 10, 25, 39, 40, 1000)


@pytest.fixture(scope="module")
def attempts(spark):
    rng = random.Random(6)
    rows = [
        (
            f"j{rng.randrange(3)}",
            f"lane {rng.randrange(4)}",
            rng.choice([None, *range(40)]),
            "failed" if rng.random() < 0.03 else "succeeded",
            rng.choice([None, 5, 7]),
            1,
        )
        for _ in range(150)
    ]
    return spark.createDataFrame(rows, ATTEMPT).drop("run").withColumn("place", F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def lanes(spark):
    rows = [(f"j{j}", f"lane {i}", "disabled" if i == 3 else "ready") for j in range(4) for i in range(4)]
    return spark.createDataFrame(rows, "job_id string, lane_id string, state string")


def listed(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("shared", [False, True])
def test_same_as_from_all_attempts(spark, attempts, lanes, folder, shared):
    if shared:
        lanes = lanes.where("job_id = 'j0'").drop("job_id")
    parts = [attempts.where(F.col("place") % 3 == i) for i in range(3)]
    for epoch, part in enumerate([*parts, attempts.limit(0)]):
        put_lane_attempts(part, folder, "007", epoch, shared, windows_per_day=10)
    put_lane_attempts(parts[1], folder, "007", 1, shared, windows_per_day=10)
    for window in WINDOWS:
        got = lane_state_from_days(spark, folder, lanes, window, shared, windows_per_day=10)
        assert listed(got) == listed(lane_state_asof(attempts, lanes, window, shared, windows_per_day=10))


def test_one_day_of_attempts_is_read(spark, attempts, lanes, folder):
    put_lane_attempts(attempts, folder, "r", windows_per_day=10)
    state = lane_state_from_days(spark, folder, lanes, 25, windows_per_day=10)
    plan = state._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    tail, before = sorted(scans, key=lambda line: "failure_count" in line)
    assert "PartitionFilters: [isnotnull(day" in tail and "= 2)]" in tail.split("PartitionFilters")[1]
    assert "< 2)]" in before.split("PartitionFilters")[1]
    assert "input_tokens" not in before
