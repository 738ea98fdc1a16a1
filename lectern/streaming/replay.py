"""A finished table as the stream that it was: it arrives in slices of time, and the query stops after each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sinks.shared import folder
from lectern.sinks.streams import Batches
from lectern.streaming.live import STATE_STORE


def cuts(df: DataFrame, ts: str, slices: int) -> list[float]:
    """Times (seconds) that cut a table into slices of about equal size."""
    found = df.select(F.col(ts).cast("timestamp").cast("double").alias("t")).approxQuantile("t", [k / slices for k in range(1, slices)], 0.01)
    return [-float("inf"), *found, float("inf")]


def replayed(df: DataFrame, ts: str, live: Callable[[DataFrame], DataFrame], slices: int = 3, sink=None) -> DataFrame:
    """What ``live`` puts out for a stream of ``df``'s rows. Each slice is a micro-batch; after each, the query ends, and the
    next one goes on from its checkpoint. ``sink`` makes of a path and a schema the sink to write to and read from; without
    it ``Batches``. Rows whose time is null come with the first slice."""
    spark, path = df.sparkSession, folder(df.sparkSession, "replay")
    second = F.coalesce(F.col(ts).cast("timestamp").cast("double"), F.lit(-1e300))
    bounds, out = cuts(df, ts, slices), None
    own = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        for low, high in zip(bounds, bounds[1:], strict=False):
            if low < high:
                df.filter((second > low) & (second <= high)).write.mode("append").parquet(f"{path}/in")
                result = live(spark.readStream.schema(df.schema).parquet(f"{path}/in"))
                out = (sink or Batches)(f"{path}/out", result.schema)
                query = result.writeStream.foreachBatch(out.write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
                query.awaitTermination()
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return out.read(spark)
