"""A log of attempts by day with a roll-up of each day, so that lane states need not read all attempts.

The state of a lane after a window takes the last use and the failures of all days before, which the roll-ups hold in a
row per lane and part, and single attempts of the window's own day only. Attempts come in parts (`run`, `epoch`), of
any days; a late one gives rows of its day and changes no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.operators.audit import lane_keys
from batchloom.plans.lanes import WINDOWS_PER_DAY, lane_state_of, lane_use_asof

_PART = ["day", "run", "epoch"]
_KINDS = {"day": T.LongType(), "run": T.StringType(), "epoch": T.IntegerType()}


def put_lane_attempts(
    attempts: DataFrame,
    path: str,
    run: str,
    epoch: int = 0,
    shared: bool = False,
    windows_per_day: int = WINDOWS_PER_DAY,
) -> None:
    """Add attempts as a part; a repeat replaces what the part held of the same days, and its roll-ups.

    Lanes are those of a job where attempts have one, unless they are `shared`. The roll-ups are written after
    the attempts, so a part that was interrupted has to be repeated. Attempts without a window count for no state; a part
    without attempts adds nothing.
    """
    if attempts.isEmpty():
        return
    day = F.floor(F.col("virtual_window") / windows_per_day).cast("bigint")
    rows = attempts.withColumns({"day": day, "run": F.lit(run), "epoch": F.lit(epoch)})
    _put(rows, f"{path.rstrip('/')}/attempts")
    written = _rows(attempts.sparkSession, f"{path.rstrip('/')}/attempts")
    own = written.where((F.col("run") == run) & (F.col("epoch") == epoch))
    totals = own.groupBy(*lane_keys(attempts, shared), *_PART).agg(
        F.max("virtual_window").alias("last_request_window"),
        F.count_if(F.col("status") == "failed").alias("failure_count"),
    )
    _put(totals, f"{path.rstrip('/')}/rollups")


def lane_state_from_days(
    spark: SparkSession,
    path: str,
    lanes: DataFrame,
    window: int,
    shared: bool = False,
    windows_per_day: int = WINDOWS_PER_DAY,
) -> DataFrame:
    """`lane_state_asof` over all attempts at `path`, from the attempts of one day and the roll-ups before it.

    `shared` and `windows_per_day` are those that the parts were put with.
    """
    path, today = path.rstrip("/"), window // windows_per_day
    attempts = _rows(spark, f"{path}/attempts")
    keys = [key for key in lane_keys(attempts, shared) if key in lanes.columns]
    tail = lane_use_asof(attempts.where(F.col("day") == today), keys, window, windows_per_day)
    earlier = _rows(spark, f"{path}/rollups").where(F.col("day") < today)
    counters = [name for name in tail.columns if name not in keys]
    used = (
        tail.unionByName(
            earlier.select(*keys, "last_request_window", "failure_count"), allowMissingColumns=True
        )
        .groupBy(*keys)
        .agg(
            F.max("last_request_window").alias("last_request_window"),
            *(F.sum(name).alias(name) for name in counters if name != "last_request_window"),
        )
    )
    return lane_state_of(used, lanes, keys, window)


def _put(rows: DataFrame, path: str) -> None:
    writer = rows.hint("rebalance", *_PART).write.mode("overwrite").partitionBy(*_PART)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all parts; a run's name is text also if it looks like a number."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, _KINDS.get(f.name, f.dataType)) for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)
