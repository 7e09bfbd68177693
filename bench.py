"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ITEMS (rows of the big
packing job, default 10 million, 0 leaves it out).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "items_derive",
    "pack_global",
    "pack_by_source",
    "pack_turns_by_conv",
    "pack_collect",
    "waves",
    "waves_mixed_caps",
    "missing_outputs",
    "retry_batches",
    "upsert_items",
    "tpm_usage",
    "day_quota",
    "lane_state_asof",
    "job_outcome",
    "redact_props",
    "apply_echo",
)
RUNS = 3


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def big_job(spark, n: int):
    """`n` items: a third in one job, the rest in a hundred thousand jobs."""
    from pyspark.sql import functions as F

    job = F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("job"), (F.col("id") % 100_000).cast("string"))
    )
    return spark.range(n).select(
        job.alias("job_id"),
        F.col("id").alias("ord"),
        F.format_string("work_%06d", "id").alias("work_item_id"),
        (F.pmod(F.xxhash64("id"), F.lit(346)) + 517).alias("estimated_input_tokens"),
    )


def main() -> None:
    from batchloom.operators.packing import pack_items, pack_totals
    from batchloom.queries import QUERIES
    from batchloom.schemas import PackLimits
    from batchloom.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n = int(os.environ.get("BENCH_ITEMS", "10000000"))
    spark = get_spark(
        app_name="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="batchloom-bench-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run = lambda: consume(QUERIES[name](spark, sf_dir))
        run()
        times[name] = round(min(seconds(run) for _ in range(RUNS)), 3)
    result = {
        "metric": "sum of headline query times, best of three after a warm-up",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    if n:
        items, limits = big_job(spark, n), PackLimits()
        for name, pack in (("pack_items", pack_items), ("pack_totals", pack_totals)):
            took = seconds(lambda: consume(pack(items, ["ord"], limits, group_cols=["job_id"])))
            result[f"{name}_big"] = {
                "items": n,
                "seconds": round(took, 2),
                "items_per_second": round(n / took),
            }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
