"""Named queries on live streams: tables arrive in slices, and each query stops and goes on between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.queries import query, table
from lectern.sinks.streams import ResultQueue
from lectern.streaming.joins import JoinedBatches
from lectern.streaming.replay import replayed
from lectern.streaming.translation import translations


@query(
    "SELECT a.event_id, coalesce(b.event_id, -1) AS other FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts BETWEEN a.ts + INTERVAL 3 SECOND AND a.ts + INTERVAL 1 HOUR "
    "WHERE b.event_id IS NOT NULL OR a.ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR - INTERVAL 10 SECOND"
)
def answered_events(spark, sf):
    """Each event with those of its user and type that follow it within 3 seconds to an hour; one without any comes out
    once the stream's time is past its hour."""

    def sides(events):
        one = events.select("event_id", "user_id", "event_type", F.col("ts").alias("at"))
        return one, events.select(F.col("event_id").alias("other"), "user_id", "event_type", F.col("ts").alias("later"))

    def joined(path, schema):
        return JoinedBatches(path, schema, sides, ["user_id", "event_type"], "at", "later", least=3.0, most=3600.0, how="leftOuter")

    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return replayed(events, "ts", lambda s: s, sink=joined).select("event_id", F.coalesce("other", F.lit(-1)).alias("other"))


_BASE = 1704067200


def _marked(text: str, lang: str) -> str:
    """Stands in for a translator."""
    return f"[{lang}] {text}"


@query(
    "SELECT c.conv_id, c.turn, lang, '[' || lang || '] ' || coalesce(a.text, '') AS translated, CASE WHEN 7 * (c.turn % 7) <= 30 THEN 'buffer' ELSE 'cache' END AS found "
    "FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - c.turn % 7, (SELECT unnest(['es', 'fr']) AS lang)"
)
def buffered_translations(spark, sf):
    """Turns 7 seconds apart are translated as they come; each asks again for the turn that its group of seven began with,
    which the buffer has for 30 seconds, and after that the cache."""
    turns = table(spark, sf, "conversations")
    first = turns.select("conv_id", F.col("turn").alias("first"), F.col("text").alias("asked_text"), (F.col("turn") * 7.0 + _BASE).alias("asked"))
    rows = turns.withColumn("first", F.col("turn") - F.col("turn") % 7).join(first, ["conv_id", "first"], "left")
    rows = rows.select("conv_id", "turn", (F.col("turn") * 7.0 + _BASE).alias("at"), "text", "asked", "asked_text").withColumn("ts", F.timestamp_seconds("at"))
    return replayed(rows, "ts", lambda s: translations(s, "conv_id", ["es", "fr"], _marked)).select("conv_id", "turn", "lang", "translated", "found")


_QUEUE = 1000


@query(f"WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS place, count(*) OVER () AS n FROM events WHERE event_type = 'error') SELECT event_id, value, CAST(greatest(0, n - {_QUEUE}) AS BIGINT) AS dropped FROM r WHERE place <= {_QUEUE}")
def queued_results(spark, sf):
    """Errors put to a queue of bounded room that nobody reads: what fits, and how many were dropped. The bound is the
    feature."""
    held = []

    def queue(path, schema):
        held.append(ResultQueue(path, _QUEUE, ["ts", "event_id"], schema))
        return held[-1]

    out = replayed(table(spark, sf, "events"), "ts", lambda s: s.filter("event_type = 'error'").select("ts", "event_id", "value"), sink=queue)
    return out.select("event_id", "value", F.lit(held[-1].dropped(spark)).cast("long").alias("dropped"))
