import os
import random
import re

import pytest

from batchloom.operators.outcomes import upsert
from batchloom.sources import buckets
from batchloom.sources.buckets import create_buckets, merged_buckets, read_buckets, upsert_buckets

COLUMNS = "job string, id long, status string, n int"


def rows_of(df):
    return sorted(map(tuple, df.select("job", "id", "status", "n").collect()), key=str)


@pytest.fixture()
def table(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"job {i % 9}", i, "pending", i) for i in range(300)]
    return spark.createDataFrame(rows + [(None, 1, "null", 0)], COLUMNS)


def source_of(spark):
    rows = [("hot", i, "done", -i) for i in range(0, 300, 2)] + [("new", 1, "done", 5), (None, 1, "other null", 6)]
    return spark.createDataFrame(rows, COLUMNS)


def test_same_as_a_whole_upsert(spark, table, folder):
    source = source_of(spark)
    create_buckets(table, folder, ["job", "id"], 16)
    assert rows_of(read_buckets(spark, folder)) == rows_of(table)
    upsert_buckets(source, folder, ["status"])
    expected = upsert(table, source, ["job", "id"], ["status"])
    assert rows_of(read_buckets(spark, folder)) == rows_of(expected)
    assert read_buckets(spark, folder).columns == table.columns
    more = spark.createDataFrame([("new", 1, "again", 9), ("newer", 2, "x", 1)], COLUMNS)
    assert upsert_buckets(more, folder, ["n"]) <= 2
    expected = upsert(expected, more, ["job", "id"], ["n"])
    assert rows_of(read_buckets(spark, folder)) == rows_of(expected)


def files(folder):
    return {
        os.path.join(root, name): os.stat(os.path.join(root, name)).st_mtime_ns
        for root, _, names in os.walk(f"{folder}/data".removeprefix("file:"))
        for name in names
        if name.endswith(".parquet")
    }


def test_untouched_buckets_stay(spark, table, folder):
    create_buckets(table, folder, ["job", "id"], 16)
    before = files(folder)
    assert len(before) == 16
    one = spark.createDataFrame([("hot", 2, "done", 1)], COLUMNS)
    assert upsert_buckets(one, folder, ["status"]) == 1
    after = files(folder)
    assert before.items() <= after.items() and len(after) == 17
    assert upsert_buckets(one.limit(0), folder, ["status"]) == 0
    assert files(folder) == after


def test_the_table_is_not_exchanged(spark, table, folder):
    create_buckets(table, folder, ["job", "id"], 16)
    plan = merged_buckets(source_of(spark).coalesce(1), folder, ["status"], range(16))
    lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    assert len(exchanges) == 1 and scan < exchanges[0], lines
    assert "hashpartitioning" in lines[exchanges[0]] and ", 16)" in lines[exchanges[0]]
    read = merged_buckets(source_of(spark), folder, ["status"], [3])
    read.collect()
    assert re.search(r"PartitionFilters: \[.*concat_ws", read._jdf.queryExecution().executedPlan().toString())


def test_what_is_not_committed_is_not_read(spark, table, folder, monkeypatch):
    create_buckets(table, folder, ["job", "id"], 4)
    reader = read_buckets(spark, folder)
    with monkeypatch.context() as patch:
        patch.setattr(buckets, "_COMMIT", "no such type")
        with pytest.raises(Exception):
            upsert_buckets(source_of(spark), folder, ["status"])
    part = read_buckets(spark, folder)
    monkeypatch.setattr(spark, "createDataFrame", None)
    source = table.selectExpr("job", "id", "'done' status", "n")
    with pytest.raises(TypeError):
        upsert_buckets(source, folder, ["status"])  # written, but not committed
    monkeypatch.undo()
    assert rows_of(part) == rows_of(read_buckets(spark, folder)) == rows_of(table)
    upsert_buckets(source, folder, ["status"])
    assert rows_of(reader) == rows_of(table)
    assert rows_of(read_buckets(spark, folder)) == rows_of(upsert(table, source, ["job", "id"], ["status"]))


def test_another_session(spark, table, folder):
    create_buckets(table, folder, ["job", "id"], 4)
    spark.sql(f"DROP TABLE {buckets._table(spark, folder)}")
    upsert_buckets(source_of(spark), folder, ["status"])
    assert rows_of(read_buckets(spark, folder)) == rows_of(upsert(table, source_of(spark), ["job", "id"], ["status"]))


def test_layouts(spark, table, folder):
    with pytest.raises(ValueError, match="no table"):
        read_buckets(spark, folder)
    with pytest.raises(ValueError, match="buckets"):
        create_buckets(table, folder, ["id"], 0)
    with pytest.raises(ValueError, match="own columns"):
        create_buckets(table.withColumnRenamed("n", "in_part"), folder, ["id"], 2)
    create_buckets(table.limit(0), folder, ["job", "id"], 3)
    assert read_buckets(spark, folder).count() == 0
    upsert_buckets(table, folder, ["status"])
    assert rows_of(read_buckets(spark, folder)) == rows_of(table)
    with pytest.raises(ValueError, match="there is a table"):
        create_buckets(table, folder, ["job", "id"])
