"""State machines over finished streams: a shuffle by stream, a sort, and one pass that holds one stream's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _none(value):
    return None if value is None or value is pd.NaT or value != value else value


#: Tasks for each part of a table whose rows are heavy.
_TASKS = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as shuffles have, without merging small ones: for work that is heavy a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out, for work that is heavy a row: to ``_TASKS`` tasks for each part that a table is read in, and at least
    as many as there are cores. Parts of a file are cut by bytes, and may hold all its rows or none."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, _TASKS * df.rdd.getNumPartitions()))


def folded(df: DataFrame, key: str, order: list[str], machine, keep: list[str] | None = None) -> DataFrame:
    """``key`` and the ``keep`` columns (the order's, unless given) of each row with what ``machine`` puts out for it. Rows
    of a stream pass in order, batch by batch, so a task holds a batch and one stream's state however long it is. Null
    keys are a stream of their own; equal order values pass in any order."""
    keep = order if keep is None else keep
    names = [f.name for f in T._parse_datatype_string(machine.schema).fields]
    schema = T.StructType([df.schema[key], *(df.schema[c] for c in keep), *T._parse_datatype_string(machine.schema).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for frame in frames:
            out = []
            fixed = list(zip(*(frame[c] for c in [key, *keep]), strict=True))
            for own, row in zip(fixed, frame.astype(object).where(frame.notna(), None).itertuples(index=False), strict=True):
                k = _none(own[0])
                if state is None or k != now:
                    now, state = k, machine.start()
                out += [(*map(_none, own), *made) for made in machine.step(state, row)]
            yield pd.DataFrame(out, columns=[key, *keep, *names])

    return dealt(df, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def last_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each stream's last row."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def repeats_last(df: DataFrame, key: str, order: str, text: str, similarity, least: float = 0.8) -> DataFrame:
    """Rows with ``skipped``: whether a text is more than ``least`` like the stream's text before it. ``similarity`` takes
    two columns and ``least``, and may be any value up to that where it is no more."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    rows = dealt(df, key).withColumn("_before", before)
    return rows.withColumn("skipped", F.coalesce(similarity(F.col(text), F.col("_before"), least) > least, F.lit(False))).drop("_before")


def without_pauses(df: DataFrame, key: str, order: str, at: Column, pause: Column) -> DataFrame:
    """Rows with ``played``: a clock that stands still during pauses (seconds paused before each row)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("played", at - F.sum(F.coalesce(pause, F.lit(0.0))).over(w))


def after_warm_up(df: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Rows of each stream from ``seconds`` after its first row on."""
    first = df.groupBy(key).agg(F.min(at).alias("_first"))
    return df.join(first, key).filter(F.col(at) >= F.col("_first") + seconds).drop("_first")


def merged(streams: dict[str, DataFrame], primary: str) -> DataFrame:
    """Rows of several languages' streams in one, with ``language`` and ``is_primary``."""
    out = None
    for language, df in streams.items():
        own = df.withColumn("language", F.lit(language)).withColumn("is_primary", F.lit(language == primary))
        out = own if out is None else out.unionByName(own)
    return out


def fanned_out(df: DataFrame, languages: list[str]) -> DataFrame:
    """A row for each target language, in the order given, each once."""
    return df.withColumn("language", F.explode(F.array(*(F.lit(x) for x in dict.fromkeys(languages)))))
