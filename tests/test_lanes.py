import random

import pytest
from pyspark.sql import functions as F

from batchloom.functions.columns import can_accept, capacity
from batchloom.operators import audit
from batchloom.operators.days import number_days
from batchloom.plans.lanes import (
    eligible_lanes,
    lane_state_asof,
    limit_violations,
    plan_waves,
    plan_waves_by_class,
    refresh_lanes,
    stuck_batches,
)
from batchloom.queries.views import lane_rows
from batchloom.schemas import PackLimits
from batchloom.sources.tables import load_lanes

LIMITS = (
    "lane_id string, requests_per_minute long, input_tokens_per_minute long, "
    "safe_input_token_target long, hard_input_token_cap long"
)


def lane(lane_id, cap=240_000):
    return (lane_id, 1, max(250_000, cap), min(225_000, cap), cap)


def broken(spark, rows, limits=PackLimits()):
    lanes = spark.createDataFrame(rows, LIMITS)
    return sorted(tuple(r) for r in limit_violations(lanes, limits).collect())


def test_limit_rules(spark):
    assert broken(spark, []) == [("lanes", "at_least_one_lane")]
    assert broken(spark, [lane("a", 120_000)]) == [("lanes", "batching_cap_fits_a_lane")]
    assert broken(spark, [lane("small", 120_000), lane("large")]) == []
    assert broken(spark, [lane("a"), lane("a")]) == [("a", "lane_id_unique")]
    assert broken(spark, [("a", 0, 100, 300, 240_000)]) == [
        ("a", "hard_within_minute"),
        ("a", "limits_positive"),
    ]
    assert broken(spark, [("a", 1, 250_000, 300_000, 240_000)]) == [("a", "safe_within_hard")]


def test_limit_rules_by_job(spark):
    rows = [("a", *lane("x")), ("b", *lane("x")), ("c", *lane("y", 120_000)), ("c", *lane("y"))]
    lanes = spark.createDataFrame(rows, f"job_id string, {LIMITS}")
    jobs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "job_id string")
    found = limit_violations(lanes, PackLimits(), jobs).collect()
    assert sorted(tuple(r) for r in found) == [
        ("c", "y", "lane_id_unique"),
        ("d", "lanes", "at_least_one_lane"),
    ]


def batches(spark, tokens, job="j"):
    rows = [(job, i, f"batch_{i:03d}", t) for i, t in enumerate(tokens, 1)]
    return spark.createDataFrame(
        rows, "job_id string, batch_seq long, batch_id string, estimated_input_tokens long"
    )


@pytest.mark.parametrize(
    "change, accepts",
    [
        ({}, True),
        ({"state": "cooldown"}, False),
        ({"hard_input_token_cap": 99}, False),
        ({"requests_used_current_window": 1}, False),
        ({"input_tokens_used_current_window": 44_901}, False),
        ({"input_tokens_used_current_window": 44_900}, True),
        ({"daily_request_limit": 5, "requests_used_today": 5}, False),
        ({"daily_request_limit": 5, "requests_used_today": 4}, True),
        ({"daily_token_limit": 1_000, "input_tokens_used_today": 901}, False),
        ({"daily_token_limit": 1_000, "input_tokens_used_today": 900}, True),
    ],
)
def test_can_accept(spark, change, accepts):
    lanes = lane_rows(spark, [22_000], [None])
    for name, value in change.items():
        lanes = lanes.withColumn(name, F.lit(value))
    test = lanes.select(can_accept(F.struct("*"), F.lit(100)).alias("ok"))
    assert test.first()["ok"] is accepts
    fits = lanes.select(F.coalesce(capacity() >= 100, F.lit(False)).alias("ok"))
    assert fits.first()["ok"] is accepts


def test_eligible_and_stuck(spark):
    lanes = lane_rows(spark, [6_000, 12_000], [None, None]).withColumn(
        "state", F.when(F.col("lane_id") == "lane_1", "ready").otherwise("ready")
    )
    rows = eligible_lanes(batches(spark, [100, 7_000, 13_000]), lanes).orderBy("batch_seq").collect()
    assert [r["n_eligible"] for r in rows] == [2, 1, 0]
    assert [r["first_lane"] for r in rows] == ["lane_1", "lane_2", None]
    stuck = stuck_batches(batches(spark, [100, 7_000, 13_000]), lanes).collect()
    assert [r["batch_id"] for r in stuck] == ["batch_003"]


def test_each_lane_takes_one_batch_per_wave(spark):
    lanes = lane_rows(spark, [9] * 12, [None] * 12)
    plan = plan_waves(batches(spark, [5] * 31), lanes)
    per_lane = plan.groupBy("wave", "lane_id").count()
    assert per_lane.where("count > 1").count() == 0
    first = [r["lane_id"] for r in plan.where("wave = 0").orderBy("batch_seq").collect()]
    assert first == sorted(first) and first[:3] == ["lane_1", "lane_10", "lane_11"]
    assert tuple(audit.wave_stats(plan).first()) == (12, 3, 3)


def test_lanes_that_are_not_ready_get_nothing(spark):
    lanes = lane_rows(spark, [9, 9], [None, None])
    failed = lanes.withColumn("state", F.when(F.col("lane_id") == "lane_1", "failed").otherwise("ready"))
    plan = plan_waves(batches(spark, [5] * 3), failed).orderBy("batch_seq").collect()
    assert [(r["wave"], r["lane_id"]) for r in plan] == [(w, "lane_2") for w in range(3)]
    none = plan_waves(batches(spark, [5]), lanes.withColumn("state", F.lit("failed"))).first()
    assert none["wave"] is None and none["lane_id"] is None


def test_lanes_of_a_job(spark):
    lanes = spark.createDataFrame([("j", "a"), ("j", "b"), ("k", "c")], "job_id string, lane_id string")
    both = batches(spark, [5, 5, 5]).unionByName(batches(spark, [5, 5], job="k"))
    plan = {(r["job_id"], r["batch_seq"]): (r["wave"], r["lane_id"]) for r in plan_waves(both, lanes).collect()}
    assert plan == {
        ("j", 1): (0, "a"),
        ("j", 2): (0, "b"),
        ("j", 3): (1, "a"),
        ("k", 1): (0, "c"),
        ("k", 2): (1, "c"),
    }


def test_mixed_caps(spark):
    lanes = lane_rows(spark, [6_000, 12_000, 12_000], [None, 3, 2])
    plan = plan_waves_by_class(batches(spark, [9_000] * 9 + [100, 99_999]), lanes, ["job_id"])
    rows = plan.orderBy("batch_seq").collect()
    assert [(r["wave"], r["lane_id"], r["day"]) for r in rows] == [
        (i // 2, f"lane_{i % 2 + 2}", i // 4) for i in range(9)
    ] + [(0, "lane_1", 0), (None, None, None)]


def test_a_class_that_may_take_nothing_in_a_day(spark):
    lanes = lane_rows(spark, [6_000, 12_000], [None, 0])
    plan = plan_waves_by_class(batches(spark, [9_000, 100]), lanes, ["job_id"]).orderBy("batch_seq")
    assert [(r["wave"], r["lane_id"], r["day"]) for r in plan.collect()] == [
        (None, None, None), (0, "lane_1", 0)
    ]


def test_a_new_window_frees_lanes(spark):
    rows = [
        ("used", "ready", None, 6, 1, 900),
        ("rested", "cooldown", 7, 6, 1, 10),
        ("resting", "cooldown", 9, 6, 1, 10),
        ("failed", "failed", 7, 6, 1, 10),
        ("now", "ready", None, 7, 1, 10),
    ]
    used = "requests_used_current_window long, input_tokens_used_current_window long"
    lanes = spark.createDataFrame(
        rows, f"lane_id string, state string, cooldown_until_window long, last_request_window long, {used}"
    ).withColumns(
        {
            "requests_per_minute": F.lit(1),
            "input_tokens_per_minute": F.lit(1_000),
            "hard_input_token_cap": F.lit(800),
            "requests_used_today": F.lit(0),
            "input_tokens_used_today": F.lit(0),
            "daily_request_limit": F.lit(None).cast("long"),
            "daily_token_limit": F.lit(None).cast("long"),
        }
    )
    fresh = {r["lane_id"]: (r["state"], r["requests_used_current_window"]) for r in refresh_lanes(lanes, 7).collect()}
    assert fresh == {
        "used": ("ready", 0), "rested": ("ready", 0), "resting": ("cooldown", 0),
        "failed": ("failed", 0), "now": ("ready", 1),
    }
    row = eligible_lanes(batches(spark, [700]), lanes, window=7).first()
    assert (row["n_eligible"], row["first_lane"]) == (2, "rested")
    assert eligible_lanes(batches(spark, [700]), lanes).first()["n_eligible"] == 0


def test_many_lanes_by_job(spark):
    """Counts and first lanes against all pairs."""
    import random

    rng = random.Random(6)
    lanes = [(f"j{i % 3}", f"l{i}", rng.randrange(50), rng.random() < 0.8) for i in range(300)]
    todo = [(f"j{i % 4}", f"b{i}", i, rng.randrange(1, 60)) for i in range(200)]
    table = load_lanes(
        spark,
        spark.createDataFrame(
            [(j, x, cap, 1, 99, "ready" if ok else "disabled") for j, x, cap, ok in lanes],
            "job_id string, lane_id string, hard_input_token_cap long, requests_per_minute long, "
            "input_tokens_per_minute long, state string",
        ),
    )
    df = spark.createDataFrame(todo, "job_id string, batch_id string, batch_seq long, estimated_input_tokens long")
    got = {r["batch_id"]: (r["n_eligible"], r["first_lane"]) for r in eligible_lanes(df, table).collect()}
    for job, batch, _, tokens in todo:
        fit = sorted(x for j, x, cap, ok in lanes if j == job and ok and cap >= tokens)
        assert got[batch] == (len(fit), fit[0] if fit else None)


def test_lanes_keep_their_own_state_and_job(spark):
    attempts = spark.createDataFrame(
        [("a", "x", 5, "succeeded", 20), ("b", "x", 5, "failed", 7), ("a", "x", 1, "succeeded", 3)],
        "job_id string, lane_id string, virtual_window long, status string, input_tokens long",
    )
    lanes = spark.createDataFrame(
        [("a", "x", "ready", 9), ("b", "x", "ready", 9), ("a", "y", "disabled", 9), ("b", "y", "processing", 9)],
        "job_id string, lane_id string, state string, daily_request_limit long",
    )
    rows = {(r["job_id"], r["lane_id"]): r for r in lane_state_asof(attempts, lanes, 5, windows_per_day=4).collect()}
    assert {k: r["state"] for k, r in rows.items()} == {
        ("a", "x"): "cooldown", ("b", "x"): "failed", ("a", "y"): "disabled", ("b", "y"): "ready"
    }
    assert rows["a", "x"]["input_tokens_used_today"] == 20 and rows["a", "x"]["daily_request_limit"] == 9


def test_states_after_a_window(spark):
    attempts = spark.createDataFrame(
        [
            ("busy", 3, "succeeded", 10),
            ("busy", 5, "succeeded", 20),
            ("busy", 6, "failed", 1),
            ("idle", 4, "succeeded", 30),
            ("bad", 1, "failed", 40),
            ("bad", 5, "succeeded", 5),
        ],
        "lane_id string, virtual_window long, status string, input_tokens long",
    )
    lanes = spark.createDataFrame([(x,) for x in ("busy", "idle", "bad", "new")], "lane_id string")
    state = {r["lane_id"]: r for r in lane_state_asof(attempts, lanes, 5).collect()}
    assert {k: r["state"] for k, r in state.items()} == {
        "busy": "cooldown",
        "idle": "ready",
        "bad": "failed",
        "new": "ready",
    }
    assert state["busy"]["cooldown_until_window"] == 6
    assert state["busy"]["input_tokens_used_current_window"] == 20
    assert state["idle"]["input_tokens_used_current_window"] == 0
    later = {r["lane_id"]: r["state"] for r in lane_state_asof(attempts, lanes, 6).collect()}
    assert later["busy"] == "failed"


def test_lane_tables(spark, folder):
    source = spark.createDataFrame([lane("lane_2"), lane("lane_10"), lane("lane_1")], LIMITS)
    loaded = load_lanes(spark, source)
    assert [r["lane_id"] for r in audit.list_lanes(loaded).collect()] == ["lane_1", "lane_10", "lane_2"]
    row = loaded.first()
    assert (row["state"], row["requests_used_today"], row["daily_token_limit"]) == ("ready", 0, None)
    source.write.json(folder)
    assert load_lanes(spark, folder).count() == 3 and "job_id" not in load_lanes(spark, folder).columns
    source.withColumn("job_id", F.lit("007")).write.json(f"{folder}-jobs")
    assert load_lanes(spark, f"{folder}-jobs").first()["job_id"] == "007"


def test_quota_use_by_job(spark):
    attempts = spark.createDataFrame(
        [("j", "a", 0, 100), ("k", "a", 0, 200)],
        "job_id string, lane_id string, virtual_window long, input_tokens long",
    )
    lanes = spark.createDataFrame(
        [("j", "a", 1, 150), ("k", "a", 1, 150)],
        "job_id string, lane_id string, requests_per_minute long, input_tokens_per_minute long",
    )
    assert audit.rpm_usage(attempts, lanes).where("over_limit").count() == 0
    assert audit.rpm_usage(attempts, lanes).count() == 2
    over = audit.tpm_usage(attempts, lanes).where("over_limit").collect()
    assert [(r["job_id"], r["tokens"]) for r in over] == [("k", 200)]
    together = audit.rpm_usage(attempts, lanes.where("job_id = 'j'"), shared=True).collect()
    assert [(r["requests"], r["over_limit"]) for r in together] == [(2, True)]


def test_quota_use(spark):
    attempts = spark.createDataFrame(
        [("a", 0, 100), ("a", 0, 200), ("a", 1, 900), ("b", 0, 5)],
        "lane_id string, virtual_window long, input_tokens long",
    )
    lanes = spark.createDataFrame(
        [("a", 1, 500), ("b", 1, 500)],
        "lane_id string, requests_per_minute long, input_tokens_per_minute long",
    )
    over = audit.rpm_usage(attempts, lanes).where("over_limit").collect()
    assert [(r["lane_id"], r["virtual_window"], r["requests"]) for r in over] == [("a", 0, 2)]
    over = audit.tpm_usage(attempts, lanes).where("over_limit").collect()
    assert [(r["lane_id"], r["virtual_window"], r["tokens"]) for r in over] == [("a", 1, 900)]


def days_by_hand(tokens, most_tokens, most_requests):
    days, day, used, n = [], 0, 0, 0
    for own in tokens:
        if n and (used + own > (most_tokens or 10**9) or n >= (most_requests or 10**9)):
            day, used, n = day + 1, 0, 0
        days.append((day, n))
        used, n = used + own, n + 1
    return days


@pytest.mark.parametrize("pieces", [{}, {"partitions": 5, "piece_rows": 7, "fanout": 2}])
def test_days_of_queues_with_their_own_limits(spark, pieces):
    rng = random.Random(len(pieces))
    rows, expected = [], {}
    for queue, (tokens, requests) in enumerate(
        [(40, None), (None, 3), (25, 4), (20, 1), (1000, 1000), (None, None), (20, 50)]
    ):
        own = [rng.randint(1, 20) for _ in range(rng.choice([1, 40, 150]))]
        days = days_by_hand(own, tokens, requests)
        rows += [(queue, place, t, tokens, requests) for place, t in enumerate(own)]
        expected |= {(queue, place): day for place, day in enumerate(days)}
    df = spark.createDataFrame(rows, "queue int, place int, tokens int, most_tokens long, most int")
    got = number_days(
        df.repartition(4), ["queue"], ["place"], token_col="tokens", token_limit_col="most_tokens",
        request_limit_col="most", **pieces,
    )
    assert got.columns == [*df.columns, "day", "day_pos"]
    assert {(r["queue"], r["place"]): (r["day"], r["day_pos"]) for r in got.collect()} == expected


def test_day_limits_of_zero_and_none(spark):
    batches = spark.createDataFrame(
        [("j", f"b{i}", i, 30) for i in range(1, 7)],
        "job_id string, batch_id string, batch_seq long, estimated_input_tokens long",
    )
    lanes = lambda *rows: spark.createDataFrame(
        rows,
        "lane_id string, hard_input_token_cap long, daily_request_limit long, daily_token_limit long",
    )
    days = lambda plan: [
        (r["lane_id"], r["wave"], r["day"]) for r in plan.orderBy("batch_seq").collect()
    ]
    plan = plan_waves_by_class(batches, lanes(("x", 50, None, 0), ("y", 50, None, 70)), ["job_id"])
    assert days(plan) == [("y", i, i // 2) for i in range(6)]
    none = plan_waves_by_class(batches, lanes(("x", 50, None, 0), ("y", 50, None, 29)), ["job_id"])
    assert days(none) == [(None, None, None)] * 6
    free = plan_waves_by_class(batches, lanes(("x", 50, None, None)), ["job_id"])
    assert days(free) == [("x", i, 0) for i in range(6)]
