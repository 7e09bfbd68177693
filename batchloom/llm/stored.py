"""Intermediate results as tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from batchloom.session import new_folder


def stored(df: DataFrame) -> DataFrame:
    """`df`, written once; what follows reads the files.

    Unlike a checkpoint the table brings nothing of its plan along (known orders, partitionings and
    constraints multiply when rounds of joins follow each other), and its size is known to
    the planner. It survives lost executors.
    """
    folder = new_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
