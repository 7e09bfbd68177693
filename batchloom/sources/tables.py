"""Read and write the tables: Parquet folders partitioned by job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.functions.redaction import DEFAULT_RULES, KeyRules, redact_json
from batchloom.schemas import LANES, as_table

JOB_TABLES = (
    "jobs",
    "work_items",
    "batches",
    "lanes",
    "batch_attempts",
    "scheduler_events",
    "checkpoints",
    "checkpoint_batches",
)
# What Spark escapes in partition folder names, besides control characters.
_ESCAPED = "\"#%'*/:=?\\\x7f{}[]^"


def _write(df: DataFrame, path: str, mode: str, partition_cols: Sequence[str]) -> None:
    """Files per partition value are joined or split by size, also where one job is most rows."""
    if partition_cols:
        df = df.hint("rebalance", *partition_cols)
    df.write.mode(mode).partitionBy(*partition_cols).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    _write(df, path, "overwrite", ["job_id"])


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a log table. The caller numbers them, so that a rerun gives the same ids."""
    _write(df, path, "append", ["job_id"])


_RUN = ["run", "epoch"]


def put_rows(df: DataFrame, path: str, run: str, epoch: int) -> None:
    """Add rows to a log table as part `epoch` of a run; what that part held of these jobs before is replaced.

    So a repeat adds nothing. A log is filled either in this way or by `append_rows`; both are read by `read_rows`.
    """
    part = df.withColumns({"run": F.lit(run), "epoch": F.lit(epoch)})
    keys = ["job_id", *_RUN]
    writer = part.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def _add(df: DataFrame, path: str, run: str | None, epoch: int) -> None:
    if run is None:
        append_rows(df, path)
    else:
        put_rows(df, path, run, epoch)


def append_attempts(
    attempts: DataFrame, path: str, run: str | None = None, epoch: int = 0
) -> None:
    """Add attempts; with `run` a repeat of the same part replaces it (see `put_rows`)."""
    _add(as_table(attempts, "batch_attempts"), path, run, epoch)


def append_checkpoint(
    snapshot: DataFrame, batches: DataFrame, root: str, run: str | None = None, epoch: int = 0
) -> None:
    """Add the counts of a checkpoint and its batch ids to the two checkpoint tables; `run` as in `put_rows`."""
    root = root.rstrip("/")
    _add(as_table(batches, "checkpoint_batches"), f"{root}/checkpoint_batches", run, epoch)
    _add(as_table(snapshot, "checkpoints"), f"{root}/checkpoints", run, epoch)


def append_events(
    events: DataFrame,
    path: str,
    rules: KeyRules = DEFAULT_RULES,
    run: str | None = None,
    epoch: int = 0,
) -> None:
    """Add events, with `run` as in `put_rows`; sensitive keys are dropped from `details_json` before anything is written.

    Details that cannot be parsed could hold anything: they become `{}`, and `details_unparsed` says so.
    """
    log = as_table(events, "scheduler_events").withColumn(
        "_safe", redact_json(F.col("details_json"), rules)
    )
    unparsed = F.col("details_json").isNotNull() & F.col("_safe").isNull()
    log = log.withColumns(
        {"details_unparsed": unparsed, "details_json": F.coalesce("_safe", F.lit("{}"))}
    )
    _add(log.drop("_safe"), path, run, epoch)


def read_rows(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """Rows of a table; with `job_id` only that job's folder is read.

    Job ids are text, also if they look like numbers: `007` and `7` are two jobs.
    """
    rows = _with_run(spark, path)
    # a log that is filled in parts has them as folders below each job
    if rows.columns[-3:] == ["job_id", *_RUN]:
        rows = rows.drop(*_RUN)
    return rows if job_id is None else rows.where(F.col("job_id") == job_id)


def _with_run(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path).schema
    fields = [
        T.StructField(f.name, T.StringType() if f.name in ("job_id", "run") else f.dataType)
        for f in found.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_items(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """Items of a job by id."""
    return read_rows(spark, path, job_id).orderBy("work_item_id")


def job_folder(path: str, job_id: str) -> str:
    escaped = "".join(
        f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 else c for c in job_id
    )
    return f"{path.rstrip('/')}/job_id={escaped}"


def reset_job(spark: SparkSession, root: str, job_id: str, tables: Sequence[str] = JOB_TABLES):
    """Empty the job's folder of every table below `root` that has one; other jobs stay."""
    for table in tables:
        path = f"{root.rstrip('/')}/{table}"
        if not _has_job(spark, path, job_id):
            continue
        rows = _with_run(spark, path).limit(0)
        parts = _RUN if rows.columns[-3:] == ["job_id", *_RUN] else []
        emptied = rows.drop("job_id").write.mode("overwrite")
        emptied.partitionBy(*parts).parquet(job_folder(path, job_id))


def _has_job(spark: SparkSession, path: str, job_id: str) -> bool:
    try:
        return not read_rows(spark, path, job_id).isEmpty()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


_MARKER = "version bigint, stream string, epoch bigint"


def write_version(
    df: DataFrame, path: str, version: int, stream: str | None = None, epoch: int | None = None
) -> None:
    """Store a snapshot as its own version, then make it the current one.

    Plain Parquet cannot be overwritten while it is read. Writing a version again replaces it. The
    marker names the micro-batch that the version comes from, if any (see `is_written`).
    """
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/data/version={version}")
    marker = df.sparkSession.createDataFrame([(version, stream, epoch)], _MARKER).coalesce(1)
    marker.write.mode("append").parquet(f"{path.rstrip('/')}/versions")


def _markers(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MARKER).parquet(f"{path.rstrip('/')}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, path: str) -> int | None:
    """The newest version."""
    versions = _markers(spark, path)
    return None if versions is None else versions.agg(F.max("version")).first()[0]


def is_written(spark: SparkSession, path: str, stream: str, epoch: int) -> bool:
    """Has this micro-batch of this stream made a version?"""
    versions = _markers(spark, path)
    if versions is None:
        return False
    return not versions.where((F.col("stream") == stream) & (F.col("epoch") == epoch)).isEmpty()


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version of a table, or an older one."""
    version = current_version(spark, path) if version is None else version
    return spark.read.parquet(f"{path.rstrip('/')}/data/version={version}")


def load_lanes(
    spark: SparkSession, source: DataFrame | str, file_format: str = "json"
) -> DataFrame:
    """Lanes from a table or file of limits; run-time columns not given get their defaults.

    Lanes that belong to jobs bring a `job_id`, which is kept.
    """
    rows = source
    if isinstance(source, str):
        given = spark.read.format(file_format).load(source).columns
        by_job = [T.StructField("job_id", T.StringType())] if "job_id" in given else []
        schema = T.StructType([*by_job, *LANES.fields])
        rows = spark.read.format(file_format).schema(schema).load(source)
    start = {
        "state": "ready",
        "requests_used_current_window": 0,
        "input_tokens_used_current_window": 0,
        "requests_used_today": 0,
        "input_tokens_used_today": 0,
        "failure_count": 0,
    }
    columns = [F.col("job_id").cast("string")] if "job_id" in rows.columns else []
    for field in LANES.fields:
        given = F.col(field.name) if field.name in rows.columns else F.lit(None)
        value = given.cast(field.dataType)
        if field.name in start:
            value = F.coalesce(value, F.lit(start[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return rows.select(*columns)
