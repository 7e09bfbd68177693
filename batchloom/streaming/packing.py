"""Packing on a stream of items.

Each micro-batch is packed by the batch operator, so one busy job spreads over all tasks. Between
micro-batches only this is kept: per job the next expected `ord` and batch number, the items of
the batch still open, and items that came before their turn. Where items have an event time, the
largest one is kept as well: what lies a delay behind it waits no longer.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.ordered import number_rows
from batchloom.operators.packing import batch_id, pack_items
from batchloom.schemas import PackLimits
from batchloom.session import durable
from batchloom.sources.tables import current_version, is_written, read_version, write_version

_ITEM = ["job_id", "ord", "work_item_id", "estimated_input_tokens"]
_PACKED = [*_ITEM, "batch_seq", "batch_id", "pos"]
_HELD = "job_id string, ord bigint, work_item_id string, estimated_input_tokens bigint, event_time timestamp"
_CLOCK = "event_time timestamp"
_NEXT = "job_id string, next_ord bigint, next_seq bigint"


def pack_sink(
    path: str,
    limits: PackLimits,
    first_ord: int = 0,
    stream: str = "items",
    time_col: str | None = None,
    delay: str = "1 hour",
) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`: packs items (job, `ord`, id, tokens) into `path`.

    `ord` counts the items of a job from `first_ord` without gaps. Items may come in any order; an
    item waits until all before it are there. Items whose place was packed already go to `late`. State
    is kept in versions that name `stream` and epoch: an epoch that is written already is not done
    again. A stream with a new checkpoint needs a new name, and goes on from the state there is.

    With `time_col` nothing waits for ever: an item whose event time lies `delay` or more behind the largest one seen
    in any job gives up the items that are still missing before it (they are late if they come), and a last batch whose
    items all lie that far behind is given out as it is. An item without an event time waits as if there were none.
    """
    if not stream.isidentifier():
        raise ValueError("a stream's name is letters, digits and _")

    def pack(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        if is_written(spark, f"{path}/next", stream, epoch):
            return
        held, positions = _state(spark, path)
        time = F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")
        rows = rows.select(*_ITEM, time.alias("event_time"))
        new = rows.join(positions, "job_id", "left").withColumns(
            {
                "next_ord": F.coalesce("next_ord", F.lit(first_ord).cast("bigint")),
                "next_seq": F.coalesce("next_seq", F.lit(1).cast("bigint")),
            }
        )
        late = F.col("ord") < F.col("next_ord")
        new = durable(new)
        new.where(late).select(*_ITEM).write.mode("overwrite").parquet(
            f"{path}/late/stream={stream}/epoch={epoch}"
        )
        waiting = held.join(positions, "job_id").unionByName(new.where(~late))
        times = new.select("event_time").unionByName(_clock(spark, path))
        clock = times.agg(F.max("event_time").alias("event_time"))
        until = clock.select(F.col("event_time") - F.expr(f"INTERVAL {delay}")).first()[0]
        _advance(waiting, positions, path, stream, epoch, limits, clock, until)

    return pack


def tail_packs(spark: SparkSession, path: str, limits: PackLimits) -> DataFrame:
    """The items still held, packed as the last batches, also behind gaps in `ord`.

    For a stream that has ended; add them to `read_packs`. The state stays as it is, so the stream
    may also go on.
    """
    held, positions = _state(spark, path)
    return _pack(held.join(positions.drop("next_ord"), "job_id"), limits).select(*_PACKED)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """All assignments given out so far."""
    return spark.read.parquet(f"{path}/batch_items").select(*_PACKED)


def _state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    before = current_version(spark, f"{path}/next")
    if before is None:
        return spark.createDataFrame([], _HELD), spark.createDataFrame([], _NEXT)
    held = read_version(spark, f"{path}/held", before)
    if "event_time" not in held.columns:  # stored before items had one
        held = held.withColumn("event_time", F.lit(None).cast("timestamp"))
    return held, read_version(spark, f"{path}/next", before)


def _clock(spark: SparkSession, path: str) -> DataFrame:
    """The largest event time seen so far."""
    before = current_version(spark, f"{path}/clock")
    if before is None:
        return spark.createDataFrame([], _CLOCK)
    return read_version(spark, f"{path}/clock", before)


def _pack(items: DataFrame, limits: PackLimits) -> DataFrame:
    """Batches of each job, numbered from the job's `next_seq`."""
    kept = ["next_seq", "event_time"]
    packed = pack_items(items, ["ord"], limits, group_cols=["job_id"], keep=kept)
    return packed.withColumn(
        "batch_seq", F.col("batch_seq") + F.col("next_seq") - 1
    ).withColumn("batch_id", batch_id("batch_seq"))


def _advance(
    waiting: DataFrame,
    positions: DataFrame,
    path: str,
    stream: str,
    epoch: int,
    limits: PackLimits,
    clock: DataFrame,
    until: datetime | None,
) -> None:
    """Pack the items whose turn it is, give out closed batches, store the rest as the new state.

    With `until`, items up to that event time wait for none before them, and end the batch they are the last of.
    """
    ranked = number_rows(waiting.dropDuplicates(["job_id", "ord"]), ["job_id"], ["ord"])
    in_turn = F.col("ord") == F.col("next_ord") + F.col("rn") - 1
    waited = F.lit(False)
    if until is not None:
        waited = F.coalesce(F.col("event_time") <= F.lit(until), F.lit(False))
        ranked = durable(ranked)
        # where a job goes on after the last item that has waited long enough
        given_up = ranked.where(waited).groupBy("job_id").agg(
            F.max("ord").alias("go_on"), F.max("rn").alias("go_on_rn")
        )
        ranked = ranked.join(given_up, "job_id", "left")
        behind = F.col("ord") - F.col("go_on") <= F.greatest(F.col("rn") - F.col("go_on_rn"), F.lit(0))
        in_turn = in_turn | F.coalesce(behind, F.lit(False))
    ranked = ranked.withColumn("in_turn", in_turn)
    in_turn = F.col("in_turn")
    packed = _pack(ranked.where(in_turn).select(*_ITEM, "event_time", "next_seq"), limits)
    totals = packed.groupBy("job_id", "batch_seq").agg(
        F.sum("estimated_input_tokens").alias("tokens"),
        F.count("*").alias("n"),
        F.every(waited).alias("waited"),
    )
    full = F.col("waited") | (F.col("tokens") >= limits.safe) | (F.col("n") >= limits.max_items)
    # only the last batch of a job can be open; joins by (job, batch) stay even where jobs are not
    keys = ["job_id", "batch_seq"]
    last = packed.groupBy("job_id").agg(F.max("batch_seq").alias("batch_seq"))
    unfilled = totals.join(last, keys, "left_semi").where(~full)
    marked = durable(
        packed.join(unfilled.select(*keys, F.lit(False).alias("closed")), keys, "left").withColumn(
            "closed", F.coalesce("closed", F.lit(True))
        )
    )
    marked.where("closed").select(*_PACKED).write.mode("overwrite").parquet(
        f"{path}/batch_items/stream={stream}/epoch={epoch}"
    )

    unclosed = marked.where("NOT closed").select(*_ITEM, "event_time")
    early = ranked.where(~in_turn).select(*_ITEM, "event_time")
    held = unclosed.unionByName(early)
    # an open batch is packed again from its first item when more arrive
    moved = marked.groupBy("job_id").agg(
        F.min(F.when(~F.col("closed"), F.col("ord"))).alias("open_ord"),
        F.max("ord").alias("last_ord"),
        F.max(F.when(F.col("closed"), F.col("batch_seq"))).alias("closed_seq"),
        F.min("next_seq").alias("start_seq"),
    ).select(
        "job_id",
        F.coalesce("open_ord", F.col("last_ord") + 1).alias("next_ord"),
        F.coalesce(F.col("closed_seq") + 1, F.col("start_seq")).alias("next_seq"),
    )
    seen = waiting.groupBy("job_id").agg(
        F.min("next_ord").alias("next_ord"), F.min("next_seq").alias("next_seq")
    )
    still = positions.join(seen.select("job_id"), "job_id", "left_anti").unionByName(
        seen.join(moved.select("job_id"), "job_id", "left_anti")
    )
    spark = waiting.sparkSession
    version = (current_version(spark, f"{path}/next") or 0) + 1
    write_version(held, f"{path}/held", version)
    write_version(clock, f"{path}/clock", version)
    # the new positions make the epoch count; a repeat before that starts from the same state
    write_version(still.unionByName(moved), f"{path}/next", version, stream, epoch)
