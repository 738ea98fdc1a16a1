"""Aggregates with mergeable states over Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _state(values: np.ndarray) -> tuple[float, float, float, float]:
    """Number, mean, and sums of the second and third powers of the distances from it."""
    mean = values.mean()
    d = values - mean
    return float(len(values)), float(mean), float((d**2).sum()), float((d**3).sum())


def merge(a: tuple, b: tuple) -> tuple[float, float, float, float]:
    """The state of two parts together."""
    n, d = a[0] + b[0], b[1] - a[1]
    mean = a[1] + d * b[0] / n
    two = a[2] + b[2] + d * d * a[0] * b[0] / n
    three = a[3] + b[3] + d**3 * a[0] * b[0] * (a[0] - b[0]) / n**2 + 3 * d * (a[0] * b[2] - b[0] * a[2]) / n
    return n, mean, two, three


def skewness(df: DataFrame, value: str, by: str) -> DataFrame:
    """``by``, n and skewness (of the whole, not of a sample; null where all values are equal) of each group's not null
    values. Tasks hand on a state for each group and batch, four numbers, which a grouped Arrow function merges."""
    kind = df.schema[by]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            codes, values = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            states = [_state(v) for v in np.split(values[order], starts[1:])] if len(codes) else []
            at = pa.array([None if codes[order[s]] == len(keys.dictionary) else int(codes[order[s]]) for s in starts], pa.int64())
            columns = [pa.array([s[k] for s in states], pa.float64()) for k in range(4)]
            yield pa.record_batch([keys.dictionary.take(at), *columns], [by, "n", "mean", "two", "three"])

    @F.arrow_udf(T.DoubleType())
    def skew(n: pa.Array, mean: pa.Array, two: pa.Array, three: pa.Array) -> float:
        now = None
        for s in zip(*(x.to_pylist() for x in (n, mean, two, three)), strict=True):
            now = s if now is None else merge(now, s)
        return now[3] / now[0] / (now[2] / now[0]) ** 1.5 if now[2] > 0 else None

    states = df.select(by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL").mapInArrow(partial, T.StructType([kind, *(T.StructField(c, T.DoubleType()) for c in ("n", "mean", "two", "three"))]))
    out = states.groupBy(by).agg(skew("n", "mean", "two", "three").alias("skewness"))
    return out.join(df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n")), F.col(by).eqNullSafe(F.col("_by"))).select(by, "n", "skewness")
