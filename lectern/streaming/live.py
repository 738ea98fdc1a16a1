"""State machines on streams, and windows over event time with a bound on lateness.

The state of a stream is one JSON text in the state store (RocksDB: ``STATE_STORE`` has to be set), so checkpoints and
replays are the engine's. Rows of one micro-batch pass in order; a row that comes in a later batch than its successor
passes after it, so sources should deliver streams in order or be held back by a window first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.streams import _none

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Machine(StatefulProcessor):
    def __init__(self, machine, order: list[str], columns: list[str], ttl: int | None):
        self.machine, self.order, self.columns, self.ttl = machine, order, columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start()
        out = []
        fixed = list(zip(*(frame[c] for c in self.order), strict=True))
        for own, row in zip(fixed, frame.astype(object).where(frame.notna(), None).itertuples(index=False), strict=True):
            out += [(_none(key[0]), *map(_none, own), *made) for made in self.machine.step(state, row)]
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def live(df: DataFrame, key: str, order: list[str], machine, ttl_ms: int | None = None) -> DataFrame:
    """``folded`` of a stream: ``key`` and ``order`` of each row with what ``machine`` puts out for it. With ``ttl_ms`` a
    stream that is silent for so long begins anew."""
    more = T._parse_datatype_string(machine.schema).fields
    schema = T.StructType([df.schema[key], *(df.schema[c] for c in order), *more])
    processor = _Machine(machine, order, schema.names, ttl_ms)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def timed(df: DataFrame, ts: str, late: str = "10 seconds") -> DataFrame:
    """A stream whose rows may come ``late`` behind the latest one; later ones are dropped by the windows below. A time
    without a zone counts as in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, width: str, *by: str) -> DataFrame:
    return df.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sliding(df: DataFrame, ts: str, width: str, slide: str, *by: str, start: str = "0 seconds") -> DataFrame:
    return df.groupBy(F.window(ts, width, slide, start), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(df: DataFrame, ts: str, gap: str, *by: str) -> DataFrame:
    """Spans of a key's rows with gaps under ``gap``; an end is ``gap`` after the last row."""
    return df.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def dropped_late(query) -> int:
    """Rows that came too late for the windows of a streaming query so far."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
