"""Sums of vectors of a fixed size over all tasks, by a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that one adder adds up, about, and those that the driver gets at most.
FAN, LAST = 32, 8
_VECTOR = "task int, total binary"


def _vector(total: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "total"])


def tree_sum(rows: DataFrame, size: int, vector: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray:
    """Sum of the vectors (``size`` doubles) that ``vector`` makes of each partition's batches; None adds nothing. A task
    hands on one vector, and a tree of adders, each of ``FAN`` vectors or so, adds them one by one, so nothing holds more
    than two and the levels grow with the logarithm of the tasks."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vector(batches)
        if own is not None:
            yield _vector(own)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(1):
                own = np.frombuffer(x.as_buffer(), np.float64)
                total = own.copy() if total is None else np.add(total, own, out=total)
        if total is not None:
            yield _vector(total)

    n, sums = rows.rdd.getNumPartitions(), rows.mapInArrow(made, _VECTOR)
    while n > LAST:
        n = -(-n // FAN)
        sums = sums.select((F.col("task") % n).alias("task"), "total").repartition(n, "task").mapInArrow(added, _VECTOR)
    return sum((np.frombuffer(r.total, np.float64) for r in sums.toLocalIterator()), np.zeros(size))
