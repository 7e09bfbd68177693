"""Run jobs to their end: pack, apply, retry what failed or is missing, until nothing is open.

Each round is written to its own folder and committed by a row in `commits`, so lineage stays one
round long and a restarted run continues after the last committed round. Later rounds read only
the rows that are still open; the big item table is never rewritten.

A call with items that no committed queue holds packs them as further batches of the next round, so a round
may hold batches at different attempts. Folders and commits are numbered by round.

Where items have an `input_text_hash`, a run keeps the hashes in buckets of ids, and one digest per bucket. A
later call compares digests, and only the items of buckets that differ row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.functions.columns import is_retry_id
from batchloom.operators.audit import checkpoint_batches, checkpoint_snapshot, job_outcome
from batchloom.operators.execute import BatchFn, apply_batches, attempts_of
from batchloom.operators.ordered import number_rows
from batchloom.operators.outcomes import number_retries, reconcile_by_hash
from batchloom.operators.packing import batch_id, pack_items
from batchloom.operators.ranges import RANGE, join_in_ranges, joined_by_range, orderable
from batchloom.plans.lanes import place_in_windows
from batchloom.schemas import DEFAULT_MAX_ATTEMPTS, PackLimits, as_table

_BATCH = ["job_id", "batch_id"]
_ITEM = ["job_id", "work_item_id"]
_HASH = "input_text_hash"
_PLACE = ["lane_id", "virtual_window"]
_KEEP = ["queue_pos", "parent_batch_id", "pos", "estimated_input_tokens", "first_round", *_PLACE]
_SETTINGS = "safe bigint, hard bigint, max_items bigint, allow_overflow boolean, buckets int"
_CHANGED = "job_id string, work_item_id string, stored_hash string, resubmitted_hash string"
# items in a bucket of hashes, about, and the most buckets there are
BUCKET_ITEMS, MOST_BUCKETS = 1 << 20, 4096
_COMMIT = "attempt_number int, open_items bigint, resumed boolean"


def run_rounds(
    items: DataFrame,
    fn: BatchFn,
    out_schema: T.StructType,
    limits: PackLimits,
    path: str,
    *,
    order_cols: Sequence[str] = ("ord",),
    payload: DataFrame | None = None,
    payload_order: Sequence[str] | None = None,
    max_attempts: int = DEFAULT_MAX_ATTEMPTS,
    requeue_missing: bool = True,
    stop_after: int | None = None,
    partitions: int | None = None,
    lanes: DataFrame | None = None,
) -> Rounds:
    """Run the open rounds of the run stored at `path`, each item at most `max_attempts` times in all.

    Items that the run does not hold yet are packed and run as well, from their first attempt on.

    `items` needs job, item id, token estimate and the order columns. `payload` holds what `fn`
    needs besides, such as texts, by (job, item); it is joined for each round and never stored. Where it
    has the order columns of the items as well, under the names `payload_order` (`fn` does not get these), the first
    round moves it once: by ranges of that order that batches do not cross. It must then have the items' values there.
    `stop_after` limits the rounds of this call, `partitions` is that of `apply_batches`.

    With `lanes` the queue of each round is spread over them as in `plan_waves_by_class`, and attempts have
    their lane and window. A round's first window comes after the last one of the rounds before, and begins a
    new day where lanes have daily limits. Only columns: batches run side by side, and one that no lane can
    take runs without a lane. Without lanes the window is the round.

    The limits of a run stay what they were in its first call. If items have an `input_text_hash`, those whose hash
    is not the one the run began with do not run again; `changed` lists them, and they stay pending.
    """
    spark = items.sparkSession
    rounds = Rounds(spark, path, items, max_attempts, requeue_missing)
    done = rounds.committed()
    rounds.check_settings(limits)
    held = rounds.hold_changed(max(done) + 1) if done else None
    ran = 0
    while stop_after is None or ran < stop_after:
        last = max(done, default=0)
        in_order = last == 0 and payload is not None and payload_order is not None
        in_order = in_order and orderable(items.schema, order_cols)
        queue = rounds.next_queue(limits, order_cols, grown=ran == 0, with_order=in_order)
        if queue is None:
            break
        number = last + 1
        if held is not None and ran == 0:
            queue = queue.join(held, _ITEM, "left_anti")
            if queue.isEmpty():
                break
        if ran == 0:
            rounds.keep_hashes(number)
        if lanes is None:
            window = F.lit(number).cast("bigint")
            queue = queue.withColumns({"lane_id": F.lit(None).cast("string"), "virtual_window": window})
        else:
            queue = rounds.placed(queue, lanes)
        queue.write.mode("overwrite").parquet(rounds.folder("queue", number))
        queue = spark.read.parquet(rounds.folder("queue", number)).withColumn(
            "attempt_number", number - F.col("first_round") + 1
        )
        if in_order:
            order = _order_names(order_cols)
            queue = join_in_ranges(queue, payload, order, payload_order, _ITEM, partitions)
        elif payload is not None:
            rest = payload.drop(*(name for name in payload_order or () if name not in _ITEM))
            queue = _with_payload(queue, rest, whole=number == 1)
        within = RANGE if in_order else None
        results = apply_batches(queue, fn, out_schema, keep=_KEEP, partitions=partitions, within=within)
        with joined_by_range(spark) if in_order else nullcontext():
            results.drop("attempt_number").write.mode("overwrite").parquet(
                rounds.folder("results", number)
            )
        open_items = rounds.open_after(number).count()
        commit = spark.createDataFrame([(number, open_items, bool(done) and ran == 0)], _COMMIT)
        commit.coalesce(1).write.mode("append").parquet(f"{rounds.path}/commits")
        done = {**done, number: open_items}
        ran += 1
    return rounds


def _order_names(order_cols: Sequence[str]) -> list[str]:
    return [f"order_{i}" for i in range(len(order_cols))]


def _first_queue(
    items: DataFrame,
    limits: PackLimits,
    order_cols: Sequence[str],
    first_round: int = 1,
    with_order: bool = False,
) -> DataFrame:
    packed = pack_items(items, order_cols, limits, group_cols=["job_id"])
    order = [F.col(f"`{c}`").alias(name) for c, name in zip(order_cols, _order_names(order_cols))]
    return packed.select(
        *_BATCH,
        F.col("batch_seq").alias("queue_pos"),
        F.lit(None).cast("string").alias("parent_batch_id"),
        "work_item_id",
        "pos",
        "estimated_input_tokens",
        F.lit(first_round).alias("first_round"),
        *(order if with_order else []),
    )


def _further_queue(queue: DataFrame, held: DataFrame) -> DataFrame:
    """A first queue, its batches counted after those of the queues before.

    As in `number_retries` both are numbered together, so no join by job is needed.
    """
    columns = [*_BATCH, "queue_pos"]
    before = held.where(~is_retry_id(F.col("batch_id"))).select(*columns).distinct()
    rows = before.withColumn("_new", F.lit(0)).unionByName(
        queue.select(*columns).distinct().withColumn("_new", F.lit(1))
    )
    numbers = number_rows(rows, ["job_id"], ["_new", "queue_pos"], "number").where("_new = 1")
    return queue.join(numbers.select(*_BATCH, "number"), _BATCH).select(
        "job_id",
        batch_id("number").alias("batch_id"),
        F.col("number").cast(queue.schema["queue_pos"].dataType).alias("queue_pos"),
        *queue.columns[3:],
    )


def _with_payload(queue: DataFrame, payload: DataFrame, whole: bool) -> DataFrame:
    """Items with their payload. Retries need little of it: a semi join, for which Spark can
    broadcast the few open ids, cuts it down before it is shuffled."""
    keys = ["job_id", "work_item_id"]
    if not whole:
        payload = payload.join(queue.select(*keys), keys, "left_semi")
    return queue.join(payload, keys, "left")


class Rounds:
    """The tables of a run, read from its folder when asked for, as of its last or a given round."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        items: DataFrame,
        max_attempts: int = DEFAULT_MAX_ATTEMPTS,
        requeue_missing: bool = True,
        upto: int | None = None,
    ):
        self.spark, self.path, self.items = spark, path.rstrip("/"), items
        self.max_attempts, self.requeue_missing = max_attempts, requeue_missing
        self.upto = upto

    def as_of(self, attempt: int) -> Rounds:
        return Rounds(
            self.spark, self.path, self.items, self.max_attempts, self.requeue_missing, attempt
        )

    def folder(self, table: str, attempt: int) -> str:
        return f"{self.path}/{table}/attempt_number={attempt}"

    def _commits(self) -> DataFrame | None:
        try:
            commits = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return commits if self.upto is None else commits.where(F.col("attempt_number") <= self.upto)

    def committed(self) -> dict[int, int]:
        """Finished rounds and the number of items each left open."""
        commits = self._commits()
        rows = commits.collect() if commits is not None else []
        return {row["attempt_number"]: row["open_items"] for row in rows}

    def _read(self, table: str) -> DataFrame:
        last = max(self.committed(), default=0)
        rows = self.spark.read
        if last:
            # the latest files have all columns; those of a run begun before rounds had a first round do not
            rows = rows.schema(self.spark.read.parquet(self.folder(table, last)).schema)
        rows = rows.parquet(f"{self.path}/{table}").where(F.col("attempt_number") <= last)
        rows = _numbered(rows.withColumnRenamed("attempt_number", "round"))
        return rows.where(F.col("attempt_number") <= self.max_attempts)

    def _stored(self, table: str) -> DataFrame | None:
        """A table of the run's folder besides queues and results; None if there is none."""
        try:
            return self.spark.read.parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    # -- what a later call must have in common with the first ---------------------------------

    def check_settings(self, limits: PackLimits) -> None:
        """Keep the limits of a new run; those of a later call must be the same."""
        asked = (limits.safe, limits.hard, limits.max_items, limits.allow_overflow)
        stored = self._stored("settings")
        if stored is not None:
            known = tuple(stored.first())[:4]
            if known != asked:
                raise ValueError(f"the run at {self.path} was packed with {known}, not {asked}")
            return
        n = self.items.count() if _HASH in self.items.columns else 0
        buckets = min(MOST_BUCKETS, 1 + n // BUCKET_ITEMS)
        row = self.spark.createDataFrame([(*asked, buckets)], _SETTINGS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settings")

    def _bucketed(self, items: DataFrame) -> DataFrame:
        settings = self._stored("settings")
        buckets = settings.first()["buckets"] if settings is not None else 1
        bucket = F.pmod(F.xxhash64(*_ITEM), F.lit(buckets)).cast("int")
        return items.select(*_ITEM, F.col(_HASH), bucket.alias("bucket"))

    @staticmethod
    def _digests(bucketed: DataFrame) -> DataFrame:
        """One row per bucket, whatever the order of its items; 128 bits."""
        marks = [F.bit_xor(F.xxhash64(F.lit(i), *_ITEM, _HASH)).alias(f"mark{i}") for i in range(2)]
        return bucketed.groupBy("bucket").agg(F.count("*").alias("n"), *marks)

    def keep_hashes(self, number: int) -> None:
        """Store the hashes of the items that round `number` packs for the first time."""
        if _HASH not in self.items.columns:
            return
        new = self._bucketed(self.new_items()).repartition("bucket")
        folder = f"{self.path}/hashes/round={number}"
        new.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        schema = f"job_id string, work_item_id string, {_HASH} string, bucket int"
        stored = self.spark.read.schema(schema).parquet(folder)
        digests = self._digests(stored).coalesce(1)
        digests.write.mode("overwrite").parquet(f"{self.path}/digests/round={number}")

    def differences(self) -> DataFrame | None:
        """`reconcile_by_hash` of the stored items and the resubmitted ones, where their buckets differ.

        None if the run keeps no hashes. Items in buckets without a difference are not listed.
        """
        digests = self._stored("digests")
        if digests is None or _HASH not in self.items.columns:
            return None
        done = list(self.committed())
        known = digests.where(F.col("round").isin(done)).groupBy("bucket").agg(
            F.sum("n").alias("n"), *[F.bit_xor(f"mark{i}").alias(f"mark{i}") for i in range(2)]
        )
        own = self._bucketed(self.items)
        sides = known.withColumn("side", F.lit(1)).unionByName(
            self._digests(own).withColumn("side", F.lit(2))
        )
        differ = sides.groupBy("bucket", "n", "mark0", "mark1").agg(F.sum("side").alias("sides"))
        # as many rows as there are buckets at most
        rows = differ.where("sides <> 3").select("bucket").distinct().collect()
        buckets = [row["bucket"] for row in rows]
        stored = self._stored("hashes").where(F.col("round").isin(done))
        inside = F.col("bucket").isin(buckets) if buckets else F.lit(False)
        return reconcile_by_hash(stored.where(inside), own.where(inside))

    def hold_changed(self, number: int) -> DataFrame | None:
        """Ids of items that are not what the run began with, stored as found before round `number`."""
        found = self.differences()
        if found is None:
            return None
        changed = found.where("verdict = 'changed'").drop("verdict")
        folder = f"{self.path}/changed/round={number}"
        changed.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(_CHANGED).parquet(folder).select(*_ITEM)

    def changed(self) -> DataFrame:
        """Items that a call held back, with the hash of the first call and the one it was given."""
        found = self._stored("changed")
        if found is None:
            return self.spark.createDataFrame([], f"{_CHANGED}, round int")
        return found.select(*_ITEM, "stored_hash", "resubmitted_hash", "round")

    def _held(self, last: int) -> DataFrame | None:
        """Attempts of items that were to run again after a round before the last one, and were held."""
        if self._stored("changed") is None:
            return None
        again = self.results().where(self._runs_again() & (F.col("round") < last))
        later = self.results().where(~self._runs_again() | (F.col("round") == last))
        held = again.join(self.changed().select(*_ITEM), _ITEM, "left_semi")
        held = held.join(later.select(*_ITEM), _ITEM, "left_anti")
        return held.groupBy(*_ITEM).agg(F.max("attempt_number").alias("attempt_number"))

    def placed(self, queue: DataFrame, lanes: DataFrame) -> DataFrame:
        """A queue with lane and window; windows go on after those of the committed rounds."""
        before = None
        if self.committed():
            before = self._read("queue").groupBy("job_id").agg(F.max("virtual_window").alias("last"))
        totals = queue.groupBy(*_BATCH, "queue_pos").agg(
            F.sum("estimated_input_tokens").alias("estimated_input_tokens")
        )
        plan = place_in_windows(totals, lanes, ["job_id"], ["queue_pos", "batch_id"], before)
        return queue.join(plan.select(*_BATCH, *_PLACE), _BATCH, "left")

    def results(self) -> DataFrame:
        """Every item of every attempt with its outcome and outputs."""
        return self._read("results")

    def new_items(self) -> DataFrame:
        """Items that no committed queue holds."""
        if not self.committed():
            return self.items
        return self.items.join(self._read("queue"), ["job_id", "work_item_id"], "left_anti")

    def next_queue(
        self, limits: PackLimits, order_cols: Sequence[str], grown: bool = True, with_order: bool = False
    ) -> DataFrame | None:
        """What runs again after the last round and, if the items may have grown, new ones; or None.

        The first queue has its order columns, if asked for.
        """
        rounds = self.committed()
        last = max(rounds, default=0)
        if not last:
            return _first_queue(self.items, limits, order_cols, with_order=with_order)
        queue = None
        if rounds[last] and not self.open_after(last).isEmpty():
            queue = self.queue_after(last)
        if grown and not (items := self.new_items()).isEmpty():
            more = _further_queue(_first_queue(items, limits, order_cols, last + 1), self._read("queue"))
            queue = more if queue is None else queue.unionByName(more)
        return queue

    def _runs_again(self) -> Column:
        missing = (F.col("outcome") == "missing") & F.lit(self.requeue_missing)
        return (F.col("attempt_number") < self.max_attempts) & (
            (F.col("batch_status") == "failed") | missing
        )

    def open_after(self, number: int) -> DataFrame:
        """Item rows of a round that have to run again."""
        results = self.spark.read.parquet(self.folder("results", number))
        return _numbered(results.withColumn("round", F.lit(number))).where(self._runs_again())

    def queue_after(self, number: int) -> DataFrame:
        """Failed batches under their own id, and a child batch for the missing items of others.

        Both keep the place of the batch they come from, so the queue order stays.
        """
        again = self.open_after(number).select(*_BATCH, "work_item_id", "batch_status", *_KEEP)
        parents = again.where("batch_status <> 'failed'").select(*_BATCH, "queue_pos").distinct()
        earlier = self.as_of(number)._read("queue").where(is_retry_id(F.col("batch_id")))
        children = number_retries(
            parents, ["queue_pos", "batch_id"], existing=earlier.select(*_BATCH).distinct()
        ).select(*_BATCH, F.col("retry_batch_id").alias("child_id"))
        child = F.col("child_id")
        return again.join(children, _BATCH, "left").select(
            "job_id",
            F.coalesce(child, "batch_id").alias("batch_id"),
            "queue_pos",
            F.when(child.isNotNull(), F.col("batch_id"))
            .otherwise(F.col("parent_batch_id"))
            .alias("parent_batch_id"),
            "work_item_id",
            "pos",
            "estimated_input_tokens",
            "first_round",
        )

    def attempts(self) -> DataFrame:
        keys = [*_BATCH, "attempt_number", "round", "queue_pos", *_PLACE]
        return attempts_of(self.results(), keys)

    def attempt_log(self) -> DataFrame:
        """`attempts` as rows of the attempt table, numbered in the order of rounds, windows and queue."""
        columns = [*_BATCH, "attempt_number", *_PLACE, "status", "error_code", "input_tokens"]
        numbered = number_rows(
            self.attempts().select(*columns, "round", "queue_pos"),
            [],
            ["round", "virtual_window", "queue_pos", "job_id", "batch_id"],
            "attempt_id",
        )
        return as_table(numbered.drop("round", "queue_pos"), "batch_attempts")

    def batches(self) -> DataFrame:
        """Every batch with its status after its last attempt, and children that wait for theirs."""
        rounds = self.committed()
        last_round = max(rounds, default=0)
        retried = (F.col("status") == "failed") & (F.col("attempt_number") < self.max_attempts)
        attempts = self.attempts()
        # a batch runs again in the very next round or never, so this is its last attempt
        is_last = ~retried | (F.col("round") == last_round)
        if self._stored("changed") is not None:
            # but for those all of whose items were held
            next_of = attempts.select(*_BATCH, (F.col("round") - 1).alias("round"), F.lit(True).alias("ran_again"))
            attempts = attempts.join(next_of, [*_BATCH, "round"], "left")
            is_last = is_last | F.col("ran_again").isNull()
        latest = attempts.where(is_last)
        status = (
            F.when(retried, "queued")
            .when(F.col("status") == "failed", "failed")
            .when(F.col("status") == "succeeded", "completed")
            .otherwise("partially_completed")
        )
        done = latest.select(
            *_BATCH,
            status.alias("status"),
            F.col("attempt_number").alias("attempt_count"),
            F.when(status == "failed", F.col("error_code")).alias("error_code"),
            F.col("input_tokens").alias("estimated_input_tokens"),
            "n_items",
        )
        if not rounds or rounds[last_round] == 0:
            return done
        waiting = (
            self.queue_after(last_round)
            .where(is_retry_id(F.col("batch_id")))
            .groupBy(*_BATCH)
            .agg(
                F.lit("queued").alias("status"),
                F.max(last_round - F.col("first_round") + 1).alias("attempt_count"),
                F.sum("estimated_input_tokens").alias("estimated_input_tokens"),
                F.count("*").alias("n_items"),
            )
            .join(latest.select(*_BATCH), _BATCH, "left_anti")
        )
        return done.unionByName(waiting, allowMissingColumns=True)

    def item_states(self) -> DataFrame:
        """Every item with its status and number of attempts."""
        last_round = max(self.committed(), default=0)
        if not last_round:
            states = self.items.withColumns({"outcome": F.lit(None), "attempt_number": F.lit(0)})
        else:
            # an item runs again in the very next round or never, so each has one row at most
            again = self._runs_again()
            latest = (
                self.results()
                .where(~again | (F.col("round") == last_round))
                .withColumn("outcome", F.when(~again, F.col("outcome")))
                .select("job_id", "work_item_id", "outcome", "attempt_number")
            )
            if (held := self._held(last_round)) is not None:
                nothing = F.lit(None).cast("string").alias("outcome")
                latest = latest.unionByName(held.select(*_ITEM, nothing, "attempt_number"))
            states = self.items.join(latest, _ITEM, "left")
        status = (
            F.when(F.col("outcome").isNull(), "pending")
            .when(F.col("outcome") == "completed", "completed")
            .otherwise("failed")
        )
        return states.select(
            "job_id",
            "work_item_id",
            "estimated_input_tokens",
            status.alias("status"),
            F.coalesce("attempt_number", F.lit(0)).alias("attempt_count"),
        )

    def outcome(self) -> DataFrame:
        """Final status of each job; its items that are not packed yet, or held, count as one open batch."""
        waiting = self.new_items().select("job_id")
        if (held := self._held(max(self.committed(), default=0))) is not None:
            waiting = waiting.unionByName(held.select("job_id"))
        waiting = waiting.distinct().select("job_id", F.lit("queued").alias("status"))
        batches = self.batches().select("job_id", "status").unionByName(waiting)
        return job_outcome(self.item_states(), batches)

    def checkpoint(self) -> tuple[DataFrame, DataFrame]:
        """Counts per job and batch ids after the last round, numbered by it."""
        last = max(self.committed(), default=0)
        mark = F.lit(last).cast("bigint").alias("checkpoint_id")
        batches = self.batches()
        return (
            checkpoint_snapshot(self.item_states(), batches, last).select("*", mark),
            checkpoint_batches(batches).select("*", mark),
        )

    def events(self) -> DataFrame:
        """What happened in the run as rows of the event log, numbered in order."""
        attempts = self.attempts().withColumn("tokens", F.col("input_tokens"))
        retry = F.col("attempt_number") < self.max_attempts
        requeued = retry & (F.col("status") == "failed")
        missing = retry & F.lit(self.requeue_missing) & (F.col("n_missing") > 0)
        per_batch = attempts.select(
            *_BATCH,
            *_PLACE,
            "round",
            "queue_pos",
            F.inline(
                F.filter(
                    F.array(
                        _event(2, "batch_dispatched", estimated_input_tokens="tokens"),
                        F.when(
                            requeued,
                            _event(
                                3,
                                "batch_requeued",
                                attempt_count="attempt_number",
                                error_code="error_code",
                            ),
                        ),
                        F.when(
                            missing,
                            _event(3, "missing_outputs_requeued", missing_outputs="n_missing"),
                        ),
                    ),
                    lambda event: event.isNotNull(),
                )
            ),
        )
        started = attempts.groupBy("job_id").agg(F.min("round").alias("started"))
        again = F.when(requeued, F.col("n_items")).when(missing, F.col("n_missing")).otherwise(0)
        counts = attempts.groupBy("job_id", "round").agg(
            F.max("virtual_window").alias("virtual_window"),
            F.count("*").alias("n_batches"),
            F.count_if(requeued | missing).alias("queued_batches"),
            F.count_if(~requeued).alias("ended"),
            F.sum("n_completed").alias("completed"),
            F.sum(F.col("n_items") - F.col("n_completed") - again).alias("failed"),
        )
        # a job has one row for each of its rounds
        so_far = Window.partitionBy("job_id").orderBy("round")
        counts = counts.withColumns(
            {
                "terminal_batches": F.sum("ended").over(so_far),
                "completed_work_items": F.sum("completed").over(so_far),
                "failed_work_items": F.sum("failed").over(so_far),
                # what is missing is queued again or has failed
                "missing_outputs": F.lit(0).cast("bigint"),
            }
        )
        resumed = self._commits().where("resumed").select(
            F.col("attempt_number").alias("round"), "resumed"
        )
        per_round = counts.join(started, "job_id").join(resumed, "round", "left").select(
            "job_id",
            "virtual_window",
            "round",
            F.inline(
                F.filter(
                    F.array(
                        F.when(
                            F.col("round") == F.col("started"),
                            _event(0, "job_started", planned_batches="n_batches"),
                        ),
                        F.when(
                            F.col("resumed"), _event(1, "job_resumed", queued_batches="n_batches")
                        ),
                        _event(
                            4,
                            "checkpoint_saved",
                            queued_batches="queued_batches",
                            terminal_batches="terminal_batches",
                            completed_work_items="completed_work_items",
                            failed_work_items="failed_work_items",
                            missing_outputs="missing_outputs",
                        ),
                    ),
                    lambda event: event.isNotNull(),
                )
            ),
        )
        events = [per_batch, per_round]
        rounds = self.committed()
        last = max(rounds, default=0)
        if rounds and rounds[last] == 0:
            finished = _event(5, "job_finished", status="status")
            windows = counts.groupBy("job_id").agg(F.max("virtual_window").alias("virtual_window"))
            ended = self.outcome().where("open_batches = 0").join(windows, "job_id")
            events.append(
                ended.select(
                    "job_id",
                    "virtual_window",
                    F.lit(last).alias("round"),
                    F.inline(F.array(finished)),
                )
            )
        log = events[0]
        for more in events[1:]:
            log = log.unionByName(more, allowMissingColumns=True)
        ordered = ["round", "step", "job_id", "queue_pos", "batch_id", "event_type"]
        numbered = number_rows(log, [], ordered, "event_id")
        return as_table(numbered.drop("round", "step", "queue_pos"), "scheduler_events")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their attempt, from the round and the one in which their items began."""
    if "first_round" not in rows.columns:
        rows = rows.withColumn("first_round", F.lit(1))
    rows = rows.withColumn("first_round", F.coalesce("first_round", F.lit(1)))
    # runs stored before rounds had lanes
    if "lane_id" not in rows.columns:
        window = F.col("round").cast("bigint")
        rows = rows.withColumns({"lane_id": F.lit(None).cast("string"), "virtual_window": window})
    return rows.withColumn("attempt_number", F.col("round") - F.col("first_round") + 1)


def _event(step: int, event_type: str, **details: str) -> Column:
    """Place in the round, type, message and details of an event; details name columns."""
    columns = [F.col(column).alias(name) for name, column in sorted(details.items())]
    return F.struct(
        F.lit(step).alias("step"),
        F.lit(event_type).alias("event_type"),
        F.lit(event_type.replace("_", " ").capitalize()).alias("message"),
        F.to_json(F.struct(*columns)).alias("details_json"),
    )
