"""Run a user function once per batch and account for every item it was given."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.functions.columns import DEFAULT_ERROR_CODE

BatchFn = Callable[[dict, pd.DataFrame], pd.DataFrame]


class BatchFailed(Exception):
    """Raised by a user function to fail its batch with a code that is safe to store."""

    def __init__(self, error_code: str | None = None):
        super().__init__(error_code or DEFAULT_ERROR_CODE)
        self.error_code = error_code or DEFAULT_ERROR_CODE


def apply_batches(
    batch_items: DataFrame,
    fn: BatchFn,
    out_schema: T.StructType,
    *,
    batch_cols: Sequence[str] = ("job_id", "batch_id", "attempt_number"),
    keep: Sequence[str] = ("pos", "estimated_input_tokens"),
    id_col: str = "work_item_id",
    order_col: str = "pos",
    partitions: int | None = None,
    within: str | None = None,
) -> DataFrame:
    """One row per item of every batch: outcome, error code, kept columns and the outputs of `fn`.

    `fn(key, items)` gets the batch columns as a dict and the batch's rows in order, and returns
    rows with the item id and the columns of `out_schema`; items it leaves out are `missing`, rows
    with a true `failed` column are `failed`. An exception fails the batch: all its items are
    `failed`, with the code of `BatchFailed` or the default one. Messages are not stored.

    Rows are spread by size; give `partitions` to spread a function that is slow on few rows. Rows that are spread
    by a column which each batch has one value of stay where they are if `within` names it.
    Spark may run a task again, so `fn` should treat the key as an idempotency key; write the
    result before using it twice.
    """
    batch_cols, kept, outputs = list(batch_cols), [id_col, *keep], out_schema.fieldNames()
    fields = [batch_items.schema[name] for name in [*batch_cols, *kept]]
    fields += [
        T.StructField("outcome", T.StringType()),
        T.StructField("batch_status", T.StringType()),
        T.StructField("error_code", T.StringType()),
        *(T.StructField(field.name, field.dataType) for field in out_schema.fields),
    ]

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        if not items[order_col].is_monotonic_increasing:
            items = items.sort_values(order_col, ignore_index=True)
        if within is not None:
            items = items.drop(columns=within)
        ids, code = items[id_col].tolist(), None
        values: dict[str, list] = {}
        try:
            returned = fn(dict(zip(batch_cols, key[-len(batch_cols) :])), items)
            row_of = {item: row for row, item in enumerate(returned[id_col])}
            if len(row_of) < len(returned) or not row_of.keys() <= set(ids):
                raise ValueError("returned ids must be ids of the batch, once each")
            # as lists of objects: gaps would turn whole numbers into floats
            values = {name: returned[name].astype(object).tolist() for name in outputs}
            failed = returned["failed"].tolist() if "failed" in returned else [False] * len(row_of)
            rows = [row_of.get(item) for item in ids]
            outcome = [
                "missing" if row is None else "failed" if failed[row] else "completed"
                for row in rows
            ]
            done = all(state == "completed" for state in outcome)
            status = "succeeded" if done else "partially_succeeded"
        except Exception as error:
            rows, outcome, status = [None] * len(ids), ["failed"] * len(ids), "failed"
            code = getattr(error, "error_code", DEFAULT_ERROR_CODE)
        columns = {name: items[name] for name in [*batch_cols, *kept]}
        columns |= {"outcome": outcome, "batch_status": status, "error_code": code}
        for name in outputs:
            found = [None if row is None else values[name][row] for row in rows]
            columns[name] = pd.Series([None if _is_nan(v) else v for v in found], dtype=object)
        return pd.DataFrame(columns)

    if partitions and within is None:
        batch_items = batch_items.repartition(partitions, *batch_cols)
    groups = batch_cols if within is None else [within, *batch_cols]
    return batch_items.groupBy(*groups).applyInPandas(run, T.StructType(fields))


def _is_nan(value: object) -> bool:
    return value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value)


def echo_fn(key: dict, items: pd.DataFrame) -> pd.DataFrame:
    """A function that completes everything and uses exactly the estimate."""
    return pd.DataFrame(
        {
            "work_item_id": items["work_item_id"],
            "input_tokens_used": items["estimated_input_tokens"],
        }
    )


ECHO_SCHEMA = T.StructType([T.StructField("input_tokens_used", T.LongType())])


def attempts_of(
    results: DataFrame, batch_cols: Sequence[str] = ("job_id", "batch_id", "attempt_number")
) -> DataFrame:
    """One row per attempt from the item rows of `apply_batches`.

    Status and error code are the same in all rows of an attempt; as grouping columns they leave
    only numbers to aggregate, which is done by hashing, partly before the shuffle.
    """
    status = F.col("batch_status").alias("status")
    return results.groupBy(*batch_cols, status, "error_code").agg(
        F.sum("estimated_input_tokens").alias("input_tokens"),
        F.count("*").alias("n_items"),
        F.count_if(F.col("outcome") == "completed").alias("n_completed"),
        F.count_if(F.col("outcome") == "missing").alias("n_missing"),
        F.count_if(F.col("outcome") == "failed").alias("n_failed"),
    )
