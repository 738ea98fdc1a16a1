"""As-of join: to each row the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(df: DataFrame, ts: str) -> Column:
    """A time as a number: microseconds of a timestamp, else as it is."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(F.col(ts).cast("timestamp"))
    return F.col(ts)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, span: float, within: float | None = None, equal: bool = True) -> DataFrame:
    """All rows of ``left`` with the columns of that row of ``right`` that is equal in ``by`` and the last at or before it
    (before it, unless ``equal``; of several at one time the greatest by all columns); nulls where there is none, none
    within ``within``, or a null in ``by`` or the time. Times are numbers or timestamps, ``span`` and ``within`` in their
    unit or seconds. Names but those of ``by`` must differ.

    Both tables are one, sorted within spans of time: a key's rows of one span are a group, so a key with a third of all
    rows is as many groups as it covers spans, and the last row before each is carried on within a group. What a span
    hands on to later ones is a row for each key and span, found apart; it comes in by a join on what the groups are
    already dealt by. So the rows are shuffled once."""
    apart = set(left.columns) & set(right.columns) - set(by)
    if apart:
        raise ValueError(f"both tables have columns {sorted(apart)}")
    unit = 10**6 if isinstance(left.schema[left_ts].dataType, T.TimestampType | T.TimestampNTZType) else 1
    more = [c for c in right.columns if c not in by]
    here = left.select(*by, _number(left, left_ts).alias("_t"), F.struct(*[left[c] for c in left.columns]).alias("_left"))
    there = right.select(*by, _number(right, right_ts).alias("_t"), F.struct(*[right[c] for c in more]).alias("_right")).filter("_t IS NOT NULL")
    here, there = (x.withColumn("_span", F.floor(F.col("_t") / (span * unit))) for x in (here, there))
    for c in by:
        there = there.filter(F.col(c).isNotNull())
    kind = there.schema["_right"].dataType
    found = F.struct("_t", "_right")
    rows = here.select(*by, "_span", "_t", F.lit(equal).alias("_late"), "_left", F.lit(None).cast(kind).alias("_right"), F.lit(None).cast(T.StructType([there.schema["_t"], there.schema["_right"]])).alias("_found"))
    rows = rows.unionByName(there.select(*by, "_span", "_t", F.lit(not equal).alias("_late"), F.lit(None).cast(here.schema["_left"].dataType).alias("_left"), "_right", found.alias("_found")))
    w = Window.partitionBy(*by, "_span").orderBy("_t", "_late", "_right").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_found", F.last("_found", ignorenulls=True).over(w)).filter("_left IS NOT NULL")

    marks = here.select(*by, "_span", F.lit(None).cast(T.StructType([there.schema["_t"], there.schema["_right"]])).alias("_last")).distinct()
    marks = marks.unionByName(there.groupBy(*by, "_span").agg(F.max(found).alias("_last"))).groupBy(*by, "_span").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*by, "_span", F.last("_last", ignorenulls=True).over(before).alias("_before")).filter("_before IS NOT NULL")
    rows = rows.join(marks, [*by, "_span"], "left").withColumn("_found", F.coalesce("_found", "_before"))
    near = F.lit(True) if within is None else F.col("_t") - F.col("_found._t") <= within * unit
    near = near & F.col("_t").isNotNull()
    for c in by:
        near = near & F.col(c).isNotNull()
    return rows.withColumn("_found", F.when(near, F.col("_found"))).select("_left.*", *(F.col(f"_found._right.{c}").alias(c) for c in more))
