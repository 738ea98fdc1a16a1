"""Numbers that a plan counts while it runs: once for a finished table, after each micro-batch for a stream."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str, **numbers: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and the numbers (aggregates) that are known once an action has passed them. They cost no pass of
    their own."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in numbers.items())), seen


def policy_counters(df: DataFrame, name: str, by: str, values: list[str], seconds: str) -> tuple[DataFrame, Observation]:
    """``observed`` with how often each value of ``by`` was applied and the seconds it took."""
    own = {}
    for v in values:
        mine = F.col(by) == v
        own |= {f"{v}_applied": F.count_if(mine), f"{v}_seconds": F.coalesce(F.sum(F.when(mine, F.col(seconds))), F.lit(0.0))}
    return observed(df, name, **own)


def stream_counters(df: DataFrame, name: str, **numbers: Column) -> DataFrame:
    """A stream whose progress reports the numbers of each micro-batch under ``name``; ``Heartbeats`` listens."""
    return df.observe(name, *(c.alias(k) for k, c in numbers.items()))


class Heartbeats(StreamingQueryListener):
    """Collects the numbers observed under ``name`` and hands a heartbeat line to ``write`` when ``every`` seconds have
    passed since the last (by the progress' own time), the first at once: a JSON object of the time, rows of the batch,
    rows a second, and the numbers, with rounded seconds."""

    def __init__(self, name: str, write, every: float = 60.0):
        self.name, self.write, self.every, self.last = name, write, every, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        own = progress.observedMetrics.get(self.name)
        if own is None:
            return
        from datetime import datetime

        at = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")).timestamp()
        if self.last is not None and at - self.last < self.every:
            return
        self.last = at
        numbers = {k: round(v, 3) if isinstance(v, float) else v for k, v in own.asDict().items()}
        self.write(json.dumps({"timestamp": at, "rows": progress.numInputRows, "rows_per_second": round(progress.processedRowsPerSecond or 0.0, 3), **numbers}))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
