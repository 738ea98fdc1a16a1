"""Joins of two live streams within a span of time.

``interval_join`` is the engine's join, whose state store takes in every row of a micro-batch and gives it up again, one
by one. ``JoinedBatches`` is the same join for large micro-batches: rows of one batch meet in a shuffle, and only those that
later ones may still meet are handed on, as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sinks.streams import Batches


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, least: str, most: str, late: str = "10 seconds", how: str = "inner") -> DataFrame:
    """Rows of two streams that are equal in ``on`` and of which the right one comes ``least`` to ``most`` after the left one
    (both included). Rows of either may come ``late`` behind the latest one. The bounds give each side's state an end: a
    left row goes once no right row within ``most`` of it can come, a right row once no left row ``least`` before it can.
    ``how`` may be leftOuter: a left row without a partner comes out when it leaves the state, with nulls.

    All columns of the left and those of the right that aren't in ``on``; names must differ otherwise. A null in ``on`` or
    in a time meets nothing."""
    apart = set(left.columns) & set(right.columns) - set(on)
    if apart:
        raise ValueError(f"both streams have columns {sorted(apart)}")
    here = left.withColumn(left_ts, F.col(left_ts).cast("timestamp")).withWatermark(left_ts, late)
    there = right.withColumn(right_ts, F.col(right_ts).cast("timestamp")).withWatermark(right_ts, late)
    there = there.select(*(F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns))
    after = F.expr(f"{right_ts} >= {left_ts} + INTERVAL {least} AND {right_ts} <= {left_ts} + INTERVAL {most}")
    for c in on:
        after = after & (F.col(c) == F.col(f"_{c}"))
    return here.join(there, after, how).drop(*(f"_{c}" for c in on))


#: Width of the spans of time that rows are dealt by, in lengths of the join's own: a right row falls in one or two.
_SPANS = 4


class JoinedBatches:
    """``interval_join`` as a sink of micro-batches: ``write`` takes the rows of a stream, of which ``sides`` makes the left
    and the right ones; ``read`` gives what was joined. ``least``, ``most`` and ``late`` are seconds, 0 <= least <= most.

    A batch's rows are dealt by key and span of time, so a hot key is as many groups as it covers spans. What a batch hands
    on are the rows of the last ``most`` + ``late`` seconds. A replayed batch goes on from what its forerunner handed on,
    and replaces its first attempt. A row is late if it is more than ``late`` behind the latest one of the batches before."""

    def __init__(self, path: str, schema: T.StructType, sides: Callable[[DataFrame], tuple[DataFrame, DataFrame]], on: list[str], left_ts: str, right_ts: str, least: float, most: float, late: float = 10.0, how: str = "inner"):
        if not 0 <= least <= most:
            raise ValueError("least and most have to be in order, and not below 0")
        if how not in ("inner", "leftOuter"):
            raise ValueError(f"no join {how}")
        self.path, self.schema, self.sides, self.on, self.how = path, schema, sides, on, how
        self.times = {"left": left_ts, "right": right_ts}
        self.least, self.most, self.late = (round(x * 1e6) for x in (least, most, late))

    def _timed(self, df: DataFrame, side: str) -> DataFrame:
        """Rows with their time in microseconds; those without one meet nothing."""
        return df.withColumn("_us", F.unix_micros(F.col(self.times[side]).cast("timestamp"))).filter("_us IS NOT NULL")

    def _end(self, left: DataFrame, right: DataFrame) -> int | None:
        """The time that no row to come is behind."""
        none = F.lit(None).cast("long")
        last = tuple(left.select(F.col("_us").alias("a"), none.alias("b")).union(right.select(none, "_us")).agg(F.max("a"), F.max("b")).first())
        return None if None in last else min(last) - self.late

    def _joined(self, left: DataFrame, right: DataFrame, end: int | None) -> DataFrame:
        """New pairs, and for leftOuter the rows that met nothing by their end. Pairs of two old rows came out before, but
        keep their left row from counting as one that met nothing."""
        width = _SPANS * max(1, self.most - self.least)
        span = lambda us: F.expr(f"({us} - pmod({us}, {width})) div {width}")
        columns = [*left.columns[:-2], *(c for c in right.columns[:-2] if c not in self.on)]
        there = right.select(*(F.col(c).alias({"_us": "_later", "_new": "_fresh"}.get(c, f"_{c}" if c in self.on else c)) for c in right.columns))
        there = there.withColumn("_there", F.explode(F.sequence(span(f"(_later - {self.most})"), span(f"(_later - {self.least})"))))
        meet = (F.col("_span") == F.col("_there")) & (F.col("_later") - F.col("_us")).between(self.least, self.most)
        for c in self.on:
            meet = meet & (F.col(c) == F.col(f"_{c}"))
        both = left.withColumn("_span", span("_us")).join(there, meet, self.how)
        over = F.lit(False) if end is None else F.col("_us") + self.most < end
        return both.filter(F.when(F.col("_later").isNull(), over).otherwise(F.col("_new") | F.col("_fresh"))).select(*columns)

    def write(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        old, new = {}, {}
        for side, df in zip(("left", "right"), self.sides(rows), strict=True):
            old[side] = self._timed(Batches(f"{self.path}/{side}", df.schema).last(spark, number), side)
            new[side] = self._timed(df, side)
        apart = set(new["left"].columns) & set(new["right"].columns) - {*self.on, "_us"}
        if apart:
            raise ValueError(f"both sides have columns {sorted(apart)}")
        before = self._end(*old.values())
        if before is not None:
            new = {side: df.filter(F.col("_us") >= before) for side, df in new.items()}
        every = {side: old[side].withColumn("_new", F.lit(False)).union(new[side].withColumn("_new", F.lit(True))) for side in old}
        end = self._end(*every.values())
        out = self._joined(*every.values(), end)
        Batches(f"{self.path}/joined", out.schema).write(out, number)
        for side, first in (("left", -self.most), ("right", self.least - self.most)):
            kept = every[side] if end is None else every[side].filter(F.col("_us") >= end + first)
            Batches(f"{self.path}/{side}", kept.schema).write(kept.drop("_us", "_new"), number)

    def read(self, spark: SparkSession) -> DataFrame:
        """All joined rows with the number of their ``batch``."""
        left, right = (x.withColumns({"_us": F.lit(0), "_new": F.lit(True)}) for x in self.sides(spark.createDataFrame([], self.schema)))
        return Batches(f"{self.path}/joined", self._joined(left, right, None).schema).read(spark)
