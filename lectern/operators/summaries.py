"""Summaries that can be merged, and exact percentiles without a sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.sinks.shared import written

#: Logarithm of an HLL sketch's registers (an error of 0.8 % at 14), and a quantile sketch's size (of ranks: 0.33 % at 800).
REGISTERS, SIZE = 14, 800


def sketches(df: DataFrame, by: list[str], distinct: str | None = None, values: str | None = None) -> DataFrame:
    """A row for each group with its number of rows ``n``, ``seen`` (a sketch of different values) and ``spread`` (one of
    numbers). They have a fixed size, can be stored, and merge with those of other groups or days."""
    made = [F.count("*").alias("n")]
    if distinct:
        made.append(F.hll_sketch_agg(distinct, REGISTERS).alias("seen"))
    if values:
        made.append(F.kll_sketch_agg_double(F.col(values).cast("double"), F.lit(SIZE)).alias("spread"))
    return df.groupBy(*by).agg(*made)


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches of finer groups as those of ``by``."""
    made = [F.sum("n").alias("n")]
    if "seen" in stored.columns:
        made.append(F.hll_union_agg("seen").alias("seen"))
    if "spread" in stored.columns:
        made.append(F.kll_merge_agg_double("spread").alias("spread"))
    return stored.groupBy(*by).agg(*made)


def rolled_up(stored: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the groups, of those without their last column, and so on to one of all; what a row leaves out is null."""
    levels = []
    for k in range(len(by), -1, -1):
        own = merged(stored, by[:k])
        levels.append(own.select(*by[:k], *(F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in by[k:]), F.lit(k).alias("level"), *[c for c in own.columns if c not in by[:k]]))
    return reduce(DataFrame.unionByName, levels)


def percentiles(df: DataFrame, value: str, by: list[str], shares: list[float], buckets: int = 1024, most: int = 64) -> DataFrame:
    """``by``, ``share``, ``value``: of each group the least value that a share of its (not null) values doesn't exceed.

    Counting selection: the span of values that holds a wanted rank is cut into ``buckets``, rows inside it are counted by
    bucket where they are, and the bucket that holds the rank is the next span, down to a single value. Rows never move
    or sort; each round reads the table once and shuffles ``buckets`` counts a group and share at most. A span's two ends
    are values and fall into different buckets, so every round narrows it. NaN is a value above all others, as in sorting,
    and counts as the greatest number."""
    spark = df.sparkSession
    number = F.col(value).cast("double")
    rows = df.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(by)), F.when(F.isnan(number), F.lit(float("inf"))).otherwise(number).alias("_v")).filter("_v IS NOT NULL")
    keys = [f"_{k}" for k in range(len(by))]
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in shares)))
    state = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = state.select(*keys, wanted.alias("share"), "n", "lo", "hi").withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n"))))
    state = written(state.select(*keys, "share", "lo", "hi", F.col("rank").cast("long").alias("rank")), "percentiles")
    names = [*keys, "share"]
    same = [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys]
    for _ in range(most):
        if state.filter("lo < hi").isEmpty():
            break
        spans = state.filter("lo < hi").select(*(F.col(k).alias(f"{k}s") for k in keys), "share", "lo", "hi", "rank")
        inside = rows.join(spans, reduce(lambda a, b: a & b, same, (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))))
        width = (F.col("hi") / 2 - F.col("lo") / 2) * 2 / buckets
        place = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), buckets - 1).otherwise(F.least(F.lit(buckets - 2), F.greatest(F.lit(0), F.coalesce(F.floor((F.col("_v") - F.col("lo")) / width), F.lit(0)))))
        counts = inside.groupBy(*names, "rank", place.alias("bucket")).agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("m").over(Window.partitionBy(*names).orderBy("bucket"))
        held = counts.withColumn("upto", upto).filter("upto >= rank AND upto - m < rank")
        state = written(state.filter("NOT lo < hi").unionByName(held.select(*names, "lo", "hi", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"))), "percentiles")
    return state.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "share", F.col("lo").alias("value"))


def stratified(df: DataFrame, stratum: str, key: str, shares: dict) -> DataFrame:
    """Of each stratum the given share of rows, drawn by a hash of ``key``: the same rows in every run, on every engine
    with MD5. Strata that aren't named have no rows."""
    drawn = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    share = F.lit(None).cast("double")
    for name, p in shares.items():
        share = F.when(F.col(stratum) == name, F.lit(float(p))).otherwise(share)
    return df.filter(drawn < share)
