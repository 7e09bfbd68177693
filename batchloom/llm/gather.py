"""Sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64


def slices(name: str, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An array as rows (name, slice, values)."""
    parts = np.array_split(values.astype("<f8"), SLICES)
    yield pa.RecordBatch.from_pydict(
        {
            "name": pa.array([name] * SLICES, pa.string()),
            "slice": pa.array(range(SLICES), pa.int32()),
            "values": pa.array([p.tobytes() for p in parts], pa.binary()),
        }
    )


SCHEMA = "name string, slice int, values binary"


def total(rows: DataFrame) -> dict[str, np.ndarray]:
    """The sum of all arrays of each name; every slice of it is added up by a task of its own.

    What reaches the driver is one array per name, however many tasks gave one.
    """

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for name, at, values in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values = np.frombuffer(values, "<f8")
                key = (name, at)
                sums[key] = sums[key] + values if key in sums else values
        if sums:
            yield pa.RecordBatch.from_pydict(
                {
                    "name": pa.array([n for n, _ in sums], pa.string()),
                    "slice": pa.array([s for _, s in sums], pa.int32()),
                    "values": pa.array([v.tobytes() for v in sums.values()], pa.binary()),
                }
            )

    found = rows.repartition(SLICES, "name", "slice").mapInArrow(add, SCHEMA).collect()
    out: dict[str, dict[int, np.ndarray]] = {}
    for row in found:
        out.setdefault(row["name"], {})[row["slice"]] = np.frombuffer(row["values"], "<f8")
    return {name: np.concatenate([parts[i] for i in range(SLICES)]) for name, parts in out.items()}
