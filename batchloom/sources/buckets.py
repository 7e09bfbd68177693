"""Tables kept in buckets of their keys, so that an upsert reads and writes only the buckets it touches.

A table is a Parquet folder, bucketed as Spark's own tables are: the rows of a bucket lie together, so a join on the
keys takes them as they lie and shuffles only the other side. Every write is a part of its own; a commit says for the
buckets that it wrote that this part holds them now. What is not committed is never read, and a reader that
began before a commit goes on with the parts it found. Parts that no bucket needs any more stay until removed.

The session's catalog gets an external table for each folder, under a name made from its path.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.operators.outcomes import upsert
from batchloom.session import durable

MOST_BUCKETS = 4096
_COMMIT = "bucket int, part string, number bigint"
_LAYOUT = "keys string, buckets int, columns string"
_IN = ["in_bucket", "in_part"]


def create_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Store `df`, one row per key, as a new table in so many buckets; a bucket should fit into a task.

    At most `MOST_BUCKETS`, since commits name each bucket. Rows with a null key are rows of their own.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"a table has 1 to {MOST_BUCKETS} buckets")
    clash = {*_IN} & set(df.columns)
    if clash:
        raise ValueError(f"names of the table's own columns: {sorted(clash)}")
    spark = df.sparkSession
    if _layout(spark, path) is not None:
        raise ValueError(f"there is a table at {path}")
    row = (json.dumps(list(keys)), buckets, df.schema.json())
    layout = spark.createDataFrame([row], _LAYOUT)
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/layout")
    _write(df.repartition(buckets, *keys), path, range(buckets), 1)


def upsert_buckets(source: DataFrame, path: str, update_cols: Sequence[str]) -> int:
    """`upsert` into the table at `path`; returns how many buckets were written anew.

    Only the buckets of the source's keys are read, joined where they lie, and replaced. One writer at a time.
    """
    spark = source.sparkSession
    keys, buckets, schema = _known(spark, path)
    # read for its buckets and for its rows, but found once
    source = durable(source.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)))
    # as many rows as there are buckets at most
    rows = source.select(_bucket(keys, buckets).alias("bucket")).distinct().collect()
    touched = sorted(row["bucket"] for row in rows)
    if touched:
        number = _commits(spark, path).agg(F.max("number")).first()[0] + 1
        _write(merged_buckets(source, path, update_cols, touched), path, touched, number)
    return len(touched)


def merged_buckets(
    source: DataFrame, path: str, update_cols: Sequence[str], touched: Sequence[int]
) -> DataFrame:
    """What the touched buckets hold after an upsert; no exchange of the table."""
    keys, _, _ = _known(source.sparkSession, path)
    return upsert(_rows(source.sparkSession, path, touched), source, keys, update_cols)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last commit; joins and groupings on its keys need not shuffle it."""
    return _rows(spark, path)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row, as Spark's bucketed tables number them."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


def _rows(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    table = _table(spark, path)
    # parts that other sessions have written
    spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)
    newest = F.max_by("part", "number").alias("part")
    # as many rows as there are buckets at most
    current = _commits(spark, path).groupBy("bucket").agg(newest).collect()
    wanted = None if only is None else set(only)
    held = [f"{b}/{part}" for b, part in current if wanted is None or b in wanted]
    # on folder names only, so other parts are not read
    return spark.table(table).where(F.concat_ws("/", *_IN).isin(held)).drop(*_IN)


def _write(df: DataFrame, path: str, touched: Sequence[int], number: int) -> None:
    """Write the rows as a part, then commit that it holds the touched buckets."""
    spark = df.sparkSession
    keys, buckets, schema = _known(spark, path)
    part = uuid.uuid4().hex
    placed = df.select(
        *schema.fieldNames(), _bucket(keys, buckets).alias(_IN[0]), F.lit(part).alias(_IN[1])
    )
    placed.write.insertInto(_table(spark, path))
    commit = spark.createDataFrame([(bucket, part, number) for bucket in touched], _COMMIT)
    commit.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/commits")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_COMMIT).parquet(f"{path.rstrip('/')}/commits")


def _layout(spark: SparkSession, path: str) -> tuple[list[str], int, T.StructType] | None:
    try:
        row = spark.read.schema(_LAYOUT).parquet(f"{path.rstrip('/')}/layout").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads(row["keys"]), row["buckets"], T.StructType.fromJson(json.loads(row["columns"]))


def _known(spark: SparkSession, path: str) -> tuple[list[str], int, T.StructType]:
    layout = _layout(spark, path)
    if layout is None:
        raise ValueError(f"there is no table at {path}")
    return layout


def _table(spark: SparkSession, path: str) -> str:
    """The session's name of the table."""
    path = path.rstrip("/")
    name = f"batchloom_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        keys, buckets, schema = _known(spark, path)
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(map(_quoted, keys))
        location = f"{path}/data".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}, in_bucket int, in_part string) USING parquet "
            f"PARTITIONED BY (in_bucket, in_part) CLUSTERED BY ({by}) SORTED BY ({by}) "
            f"INTO {buckets} BUCKETS LOCATION '{location}'"
        )
    return name


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"
