"""Missing outputs, redaction and status updates on streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.redaction import DEFAULT_RULES, KeyRules, redact_columns, redact_json
from batchloom.operators.outcomes import latest_per_key, upsert
from batchloom.sources.tables import current_version, read_version, write_version


def unanswered_stream(
    sent: DataFrame,
    returned: DataFrame,
    keys: Sequence[str],
    within: str,
    sent_time: str = "sent_at",
    returned_time: str = "returned_at",
    delay: str = "10 minutes",
) -> DataFrame:
    """Items sent for which no output came `within` the time; given out after it has passed.

    Key columns must have the same names on both sides, the other columns different ones.
    """
    s = sent.withWatermark(sent_time, delay).alias("s")
    r = returned.withWatermark(returned_time, delay).alias("r")
    condition = (F.col(f"r.{returned_time}") >= F.col(f"s.{sent_time}")) & (
        F.col(f"r.{returned_time}") <= F.col(f"s.{sent_time}") + F.expr(f"INTERVAL {within}")
    )
    for key in keys:
        condition &= F.col(f"s.{key}") == F.col(f"r.{key}")
    return (
        s.join(r, condition, "left_outer")
        .where(F.col(f"r.{returned_time}").isNull())
        .select("s.*")
    )


def redact_stream(
    rows: DataFrame, json_columns: Sequence[str] = (), rules: KeyRules = DEFAULT_RULES
) -> DataFrame:
    """Drop sensitive columns, fields and map keys, and sensitive keys of the JSON columns."""
    return redact_columns(rows, rules=rules).withColumns(
        {name: redact_json(F.col(name), rules) for name in json_columns}
    )


def status_sink(
    path: str, keys: Sequence[str], update_cols: Sequence[str], by: str, stream: str | None = None
) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`: the last row per key of each micro-batch is added to the changes.

    A micro-batch writes what changed, not the table: `read_status` merges, `compact_status` makes a
    new version now and then. Older updates never replace newer ones, by `by`, within a micro-batch,
    across them and against the table, so a micro-batch that is written twice changes nothing. A sink
    writes below its own `stream`, a new name unless one is given.
    """
    stream = stream or uuid.uuid4().hex

    def apply(rows: DataFrame, epoch: int) -> None:
        version = current_version(rows.sparkSession, path)
        newest = latest_per_key(rows, keys, by)
        folder = f"{_changes(path, version)}/stream={stream}/epoch={epoch}"
        newest.write.mode("overwrite").parquet(folder)

    return apply


def _changes(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/changes/version={version}"


def read_status(
    spark: SparkSession, path: str, keys: Sequence[str], update_cols: Sequence[str], by: str
) -> DataFrame:
    """The table as of now: the current version with all changes since the one before it."""
    keys = list(keys)
    version = current_version(spark, path)
    target = read_version(spark, path, version)
    changes = None
    # a micro-batch that began before the last compaction wrote below the version before
    for number in (version - 1, version):
        try:
            found = spark.read.schema(target.schema).option("recursiveFileLookup", "true").parquet(
                _changes(path, number)
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        changes = found if changes is None else changes.unionByName(found)
    if changes is None:
        return target
    newest = latest_per_key(changes, keys, by)
    stored = target.select(*keys, F.col(by).alias("_stored"))
    newer = newest.join(stored, keys, "left").where(
        F.col("_stored").isNull() | (F.col(by) > F.col("_stored"))
    )
    return upsert(target, newer.drop("_stored"), keys, update_cols, small_source=True)


def compact_status(
    spark: SparkSession, path: str, keys: Sequence[str], update_cols: Sequence[str], by: str
) -> int:
    """Store the table with its changes as a new version; changes written before the last one are not
    read any more. Call it from time to time; streams go on meanwhile."""
    merged = read_status(spark, path, keys, update_cols, by)
    version = current_version(spark, path) + 1
    write_version(merged, path, version)
    return version
