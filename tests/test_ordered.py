import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from batchloom.operators import ordered
from batchloom.operators.ordered import number_rows, order_items, running


def rows(n=700, seed=0):
    rng = random.Random(seed)
    return [
        (
            rng.choice(["hot", "hot", "hot", None, "a", f"g{rng.randint(0, 40)}"]),
            i,
            rng.choice([None, 1, 5, 100]),
        )
        for i in rng.sample(range(10 * n), n)
    ]


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_running_counts_and_sums(spark, partitions):
    data = rows()
    df = spark.createDataFrame(data, "g string, o long, v long").repartition(6)
    got = running(df, ["g"], ["o"], "n", {"total": "v"}, partitions=partitions, piece_rows=60)
    pdf = pd.DataFrame(data, columns=["g", "o", "v"]).sort_values("o")
    pdf["g"], pdf["v"] = pdf["g"].fillna("<null>"), pdf["v"].fillna(0).astype(int)
    pdf["n"] = pdf.groupby("g").cumcount() + 1
    pdf["total"] = pdf.groupby("g")["v"].cumsum()
    expected = {int(r.o): (r.g, int(r.n), int(r.total)) for r in pdf.itertuples()}
    assert {
        r["o"]: (r["g"] or "<null>", r["n"], r["total"]) for r in got.collect()
    } == expected


def test_numbering_without_groups(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("o"))
    got = number_rows(df, [], ["o"], partitions=9)
    assert got.where("rn <> o + 1").count() == 0 and got.count() == 1000


def test_scans_split_at_will(spark, monkeypatch):
    """Files are read whole however small the splits; files that are not are noticed."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = spark.range(20_000).select(F.xxhash64("id").alias("o"), "id")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        got = number_rows(df, [], ["o"], partitions=3, piece_rows=5_000)
        assert got.rdd.getNumPartitions() > 20
        rows = [r["rn"] for r in got.orderBy("o").collect()]
        assert rows == list(range(1, 20_001))

        monkeypatch.setattr(ordered, "_ROW_GROUP_BYTES", 1024)
        with pytest.raises(Exception, match="read in parts"):
            number_rows(df, [], ["o"], partitions=3).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_blocks_stay_whole_when_joins_become_broadcasts(spark):
    """A shuffle that is read by mapper, as Spark may do once sizes are known, takes no block apart."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "3000",
    }
    before = {name: spark.conf.get(name, None) for name in conf}
    df = spark.range(900).select((899 - F.col("id")).alias("o"))
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        got = number_rows(df, [], ["o"], partitions=3, piece_rows=4, fanout=4)
        assert [r["rn"] for r in got.orderBy("o").collect()] == list(range(1, 901))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_order_items_is_a_total_order(spark):
    df = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), "id")
    got = [tuple(r) for r in order_items(df, "a", "id", partitions=5).collect()]
    assert got == sorted(got)
    with pytest.raises(ValueError):
        order_items(df)
