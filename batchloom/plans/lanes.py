"""Lanes: limits, eligibility, and the spread of batches over lanes and waves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.columns import capacity
from batchloom.operators.audit import lane_keys
from batchloom.operators.days import number_days
from batchloom.operators.items import violations
from batchloom.operators.ordered import number_rows, running
from batchloom.schemas import PackLimits


def lane_violations(lanes: DataFrame, keys: Sequence[str] = ("lane_id",)) -> DataFrame:
    """Row rules: positive limits, safe <= hard <= tokens per minute."""
    rpm, tpm = F.col("requests_per_minute"), F.col("input_tokens_per_minute")
    safe, hard = F.col("safe_input_token_target"), F.col("hard_input_token_cap")
    return violations(
        lanes,
        keys,
        {
            "limits_positive": (rpm > 0) & (tpm > 0) & (safe > 0) & (hard > 0),
            "safe_within_hard": safe <= hard,
            "hard_within_minute": hard <= tpm,
        },
    )


def limit_violations(
    lanes: DataFrame, limits: PackLimits, jobs: DataFrame | None = None
) -> DataFrame:
    """Broken rules of a lane table as (subject, rule): those of single lanes, ids that are not
    unique, no lane at all, and a batching cap that no lane can take.

    Lanes with a `job_id` are checked job by job; `jobs` names the jobs that need lanes.
    """
    job = ["job_id"] if "job_id" in lanes.columns else []
    subject = F.col("lane_id").alias("subject")
    rows = lane_violations(lanes, [*job, "lane_id"]).select(*job, subject, "rule")
    repeated = (
        lanes.groupBy(*job, "lane_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(*job, subject, F.lit("lane_id_unique").alias("rule"))
    )
    whole = lanes.groupBy(*job).agg(
        F.count("*").alias("n"), F.max("hard_input_token_cap").alias("largest")
    )
    if job and jobs is not None:
        whole = jobs.select("job_id").join(whole, "job_id", "left")
    rule = F.when(F.coalesce("n", F.lit(0)) == 0, "at_least_one_lane").when(
        F.col("largest") < limits.hard, "batching_cap_fits_a_lane"
    )
    whole = whole.select(*job, F.lit("lanes").alias("subject"), rule.alias("rule"))
    return rows.unionByName(repeated).unionByName(whole.where("rule IS NOT NULL"))


def refresh_lanes(lanes: DataFrame, window: int) -> DataFrame:
    """Lanes as they are when `window` begins: use of an earlier window counts no more, and a
    cool-down that ends by now is over. Other states stay."""
    new_window = F.coalesce(F.col("last_request_window") != window, F.lit(True))
    rested = (F.col("state") == "cooldown") & (F.col("cooldown_until_window") <= window)
    zero = F.lit(0).cast("bigint")
    used = ("requests_used_current_window", "input_tokens_used_current_window")
    return lanes.withColumns(
        {name: F.when(new_window, zero).otherwise(F.col(name)) for name in used}
        | {"state": F.when(F.coalesce(rested, F.lit(False)), "ready").otherwise(F.col("state"))}
    )


def _job(lanes: DataFrame) -> list[str]:
    return ["job_id"] if "job_id" in lanes.columns else []


def _batch_keys(batches: DataFrame) -> list[str]:
    return [*_job(batches), "batch_id"]


def _asof(
    batches: DataFrame, rows: DataFrame, by: list[str], token_col: str, **found: dict
) -> DataFrame:
    """For each batch what `running` finds over the `rows` (by, cap, ..) whose cap is at least its
    tokens. Both are ordered by size together, so no batch meets a row by itself."""
    keys = _batch_keys(batches)
    extra = [name for name in rows.columns if name not in (*by, "cap", "tie")]
    kinds = {name: rows.schema[name].dataType for name in extra}
    tokens = F.col(token_col).cast("bigint")
    asked = batches.select(
        *keys,
        (-tokens).alias("_size"),
        F.lit(1).alias("_kind"),
        F.col("batch_id").cast("string").alias("_tie"),
        *[F.lit(None).cast(kinds[name]).alias(name) for name in extra],
    )
    offered = rows.select(
        *[
            (F.col(name) if name in by else F.lit(None)).cast(batches.schema[name].dataType).alias(name)
            for name in keys
        ],
        (-F.col("cap")).alias("_size"),
        F.lit(0).alias("_kind"),
        F.col("tie").alias("_tie"),
        *extra,
    )
    order = ["_size", "_kind", "_tie", *[name for name in keys if name not in by]]
    counted = running(asked.unionAll(offered), by, order, "_n", **found)
    names = [name for columns in found.values() for name in columns]
    return counted.where("_kind = 1").select(*keys, *names)


def eligible_lanes(
    batches: DataFrame,
    lanes: DataFrame,
    token_col: str = "estimated_input_tokens",
    window: int | None = None,
) -> DataFrame:
    """For each batch how many lanes can take it now, and the first of them by id, null if stuck.

    With `window` lanes are refreshed to it first. A batch has a row per (job, batch id).
    """
    if window is not None:
        lanes = refresh_lanes(lanes, window)
    by = _job(lanes)
    ready = lanes.select(*by, "lane_id", capacity().alias("cap")).where("cap IS NOT NULL")
    ranked = number_rows(ready, by, ["lane_id"], "lane_rank")
    rows = ranked.select(*by, "cap", F.col("lane_id").alias("tie"), F.lit(1).alias("one"), "lane_rank")
    found = _asof(
        batches, rows, by, token_col, sums={"n_eligible": "one"}, minima={"first_rank": "lane_rank"}
    )
    first = ranked.select(
        *by, F.col("lane_rank").alias("first_rank"), F.col("lane_id").alias("first_lane")
    )
    found = found.join(first, [*by, "first_rank"], "left").drop("first_rank")
    return batches.join(found, _batch_keys(batches), "left")


def stuck_batches(
    batches: DataFrame,
    lanes: DataFrame,
    token_col: str = "estimated_input_tokens",
    window: int | None = None,
) -> DataFrame:
    """Batches that no lane can take."""
    return eligible_lanes(batches, lanes, token_col, window).where("n_eligible = 0").select(
        *batches.columns
    )


def _ready(lanes: DataFrame) -> DataFrame:
    return lanes.where(F.col("state") == "ready") if "state" in lanes.columns else lanes


def _in_turn(
    batches: DataFrame, lanes: DataFrame, by: list[str], index: Column, sizes: DataFrame
) -> DataFrame:
    """Round robin: in every wave each lane takes one batch, lanes by id, batches in order.

    Batches meet the number of their lanes (`sizes`: by, n), then their lane by its rank. `n` has one
    row per group, so a group with most batches is split by Spark where it is skewed.
    """
    ranked = number_rows(lanes.select(*by, "lane_id"), by, ["lane_id"], "_rank")
    if by:
        counted = batches.join(sizes, by, "left")
    else:
        counted = batches.withColumn("n", sizes.select("n").scalar())
    place = F.when(F.col("n") > 0, index - 1)
    placed = counted.withColumns(
        {"wave": F.floor(place / F.col("n")).cast("bigint"), "_rank": F.pmod(place, F.col("n")) + 1}
    )
    return placed.join(ranked, [*by, "_rank"], "left").drop("_rank", "n")


def plan_waves(batches: DataFrame, lanes: DataFrame, index_col: str = "batch_seq") -> DataFrame:
    """Adds `wave` (0, 1, ..) and `lane_id` where all lanes can take all batches.

    `index_col` is the 1-based place of the batch in its job's queue. Without lanes both are null.
    """
    lanes = _ready(lanes)
    by = _job(lanes)
    sizes = lanes.groupBy(*by).agg(F.count("*").alias("n"))
    planned = _in_turn(batches, lanes, by, F.col(index_col), sizes)
    return planned.select(*batches.columns, "wave", "lane_id")


def plan_waves_by_class(
    batches: DataFrame,
    lanes: DataFrame,
    group_cols: Sequence[str] = (),
    order_cols: Sequence[str] = ("batch_seq",),
    token_col: str = "estimated_input_tokens",
) -> DataFrame:
    """`plan_waves` for lanes with different caps and day limits.

    A lane's cap is its hard cap or, if that is less, its daily token limit. A batch belongs to the class
    of the smallest cap it fits under, and the lanes with that cap take the batches of the class in turn. `day`
    counts the days of the lane's own queue: a day takes what comes next while it stays within the lowest
    daily limits of the class, of requests and of tokens. A batch no lane can take, or whose class may take
    none in a day, has a null wave.
    """
    return _with_days(batches, lanes, group_cols, order_cols, token_col).drop("day_pos")


def _with_days(
    batches: DataFrame,
    lanes: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    token_col: str,
) -> DataFrame:
    """`plan_waves_by_class` with `day_pos`, the place of the batch in its lane's day."""
    lanes = _ready(lanes)
    by = _job(lanes)
    keep = list(dict.fromkeys([*_batch_keys(batches), *group_cols, *order_cols, token_col]))
    day_tokens = F.col("daily_token_limit") if "daily_token_limit" in lanes.columns else F.lit(None)
    caps = lanes.select(
        *by,
        F.least("hard_input_token_cap", day_tokens.cast("bigint")).cast("bigint").alias("cap"),
        "lane_id",
        "daily_request_limit",
        day_tokens.cast("bigint").alias("daily_token_limit"),
    )
    classes = caps.groupBy(*by, "cap").agg(
        F.count("*").alias("lanes"),
        F.min("daily_request_limit").alias("day_limit"),
        F.min("daily_token_limit").alias("token_limit"),
    )
    offered = classes.select(*by, "cap", F.lit("").alias("tie"), F.col("cap").alias("class_of"))
    fitting = _asof(batches, offered, by, token_col, minima={"class_cap": "class_of"})
    classed = batches.select(*keep).join(fitting, _batch_keys(batches), "left")
    placed = number_rows(classed, [*group_cols, "class_cap"], order_cols, "class_seq")
    in_class = [*by, "class_cap"]
    sizes = classes.select(
        *by,
        F.col("cap").alias("class_cap"),
        F.when(F.coalesce(F.col("day_limit") > 0, F.lit(True)), F.col("lanes")).alias("n"),
        "day_limit",
        "token_limit",
    )
    own = caps.select(*by, F.col("cap").alias("class_cap"), "lane_id")
    planned = _in_turn(placed, own, in_class, F.col("class_seq"), sizes)
    columns = [*keep, "class_cap", "class_seq", "wave", "lane_id", "day", "day_pos"]
    by_tokens = F.col("token_limit").isNotNull() & F.col("wave").isNotNull()
    # without a token limit the day follows from the wave
    counted = planned.withColumns(
        {
            "day": F.when(F.col("day_limit").isNull(), F.lit(0)).otherwise(
                F.floor(F.try_divide("wave", "day_limit"))
            ),
            "day_pos": F.when(F.col("day_limit").isNull(), F.col("wave")).otherwise(
                F.expr("try_mod(wave, day_limit)")
            ),
        }
    ).withColumns(
        {
            name: F.when(F.col("wave").isNotNull(), F.col(name).cast("bigint"))
            for name in ("day", "day_pos")
        }
    )
    if caps.where("daily_token_limit IS NOT NULL").isEmpty():
        return counted.select(*columns)
    queue = list(dict.fromkeys([*by, *group_cols, "class_cap", "lane_id"]))
    numbered = number_days(
        planned.where(by_tokens).select(*columns[:-2], "day_limit", "token_limit"),
        queue,
        ["class_seq"],
        token_col=token_col,
        token_limit_col="token_limit",
        request_limit_col="day_limit",
    )
    numbered = numbered.withColumn(token_col, F.col(token_col).cast(batches.schema[token_col].dataType))
    return counted.where(~by_tokens).select(*columns).unionByName(numbered.select(*columns))


WINDOWS_PER_DAY = 24 * 60


def place_in_windows(
    batches: DataFrame,
    lanes: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    before: DataFrame | None = None,
    token_col: str = "estimated_input_tokens",
) -> DataFrame:
    """`plan_waves_by_class` with `virtual_window`: one batch a lane and window, a day of windows for each day.

    `before` (group columns, `last`) says which windows are used up; null or no row is none. Where lanes have daily
    limits a plan begins on the day after. A batch without a lane has no window.
    """
    plan = _with_days(batches, lanes, group_cols, order_cols, token_col)
    names = [name for name in ("daily_request_limit", "daily_token_limit") if name in lanes.columns]
    limited = F.lit(False)
    for name in names:
        limited = limited | F.col(name).isNotNull()
    by_day = not _ready(lanes).where(limited).isEmpty()
    if before is None:
        plan = plan.withColumn("last", F.lit(None).cast("bigint"))
    else:
        plan = plan.join(before.select(*group_cols, "last"), list(group_cols), "left")
    first = F.col("last") + 1
    if by_day:
        first = F.ceil(first / WINDOWS_PER_DAY).cast("bigint") * WINDOWS_PER_DAY
    window = F.coalesce(first, F.lit(0)) + F.col("day") * WINDOWS_PER_DAY + F.col("day_pos")
    return plan.withColumn("virtual_window", window.cast("bigint")).drop("last", "day_pos")


_LIMITS = (
    "requests_per_minute",
    "input_tokens_per_minute",
    "safe_input_token_target",
    "hard_input_token_cap",
    "daily_request_limit",
    "daily_token_limit",
)
_OWN_STATES = ("quota_exhausted", "failed", "disabled")


def lane_state_asof(
    attempts: DataFrame,
    lanes: DataFrame,
    window: int,
    shared: bool = False,
    windows_per_day: int = WINDOWS_PER_DAY,
) -> DataFrame:
    """State, use and limits of every lane after `window`, as `eligible_lanes` takes them.

    A lane that is disabled, exhausted or failed by itself stays so, and one with a failed batch is failed;
    one used in this very window cools down until the next; the others are ready. Use in the
    window starts at zero in each window, use of the day every `windows_per_day` windows. Lanes are those
    of a job where the lane table has jobs, unless they are `shared`.
    """
    keys = [key for key in lane_keys(attempts, shared) if key in lanes.columns]
    return lane_state_of(lane_use_asof(attempts, keys, window, windows_per_day), lanes, keys, window)


def lane_use_asof(
    attempts: DataFrame, keys: Sequence[str], window: int, windows_per_day: int = WINDOWS_PER_DAY
) -> DataFrame:
    """What the attempts up to `window` make of each lane's counters; attempts without a window count for none."""
    now = F.col("virtual_window") == window
    today = F.col("virtual_window") >= window - window % windows_per_day
    tokens = lambda when: F.sum(F.when(when, F.col("input_tokens")).otherwise(0))
    return (
        attempts.where(F.col("virtual_window") <= window)
        .groupBy(*keys)
        .agg(
            F.max("virtual_window").alias("last_request_window"),
            F.count_if(F.col("status") == "failed").alias("failure_count"),
            F.count_if(now).alias("requests_used_current_window"),
            tokens(now).alias("input_tokens_used_current_window"),
            F.count_if(today).alias("requests_used_today"),
            tokens(today).alias("input_tokens_used_today"),
        )
    )


def lane_state_of(used: DataFrame, lanes: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """`lane_state_asof` from counters that are there already."""
    zero = F.lit(0).cast("bigint")
    failures = F.coalesce("failure_count", zero)
    own = F.col("own_state") if "state" in lanes.columns else F.lit(None).cast("string")
    given = F.coalesce(own.isin(*_OWN_STATES), F.lit(False))
    used_now = F.coalesce(F.col("last_request_window") == window, F.lit(False))
    cooling = ~given & (failures == 0) & used_now
    limits = [name for name in _LIMITS if name in lanes.columns]
    states = [F.col("state").alias("own_state")] if "state" in lanes.columns else []
    counters = (
        "requests_used_current_window",
        "input_tokens_used_current_window",
        "requests_used_today",
        "input_tokens_used_today",
    )
    return (
        lanes.select(*keys, *limits, *states)
        .join(used, keys, "left")
        .select(
            *keys,
            F.when(given, own)
            .when(failures > 0, "failed")
            .when(cooling, "cooldown")
            .otherwise("ready")
            .alias("state"),
            F.when(cooling, F.lit(window + 1).cast("bigint")).alias("cooldown_until_window"),
            *[F.coalesce(name, zero).alias(name) for name in counters],
            "last_request_window",
            failures.alias("failure_count"),
            *limits,
        )
    )
