"""Live joins, translations, sinks and queues: what they put out equals the batch, also after a stop at any point."""

import datetime
import os
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.sinks.streams import Batches, ResultQueue
from lectern.streaming import live
from lectern.streaming import metrics as ME
from lectern.streaming.joins import JoinedBatches, interval_join
from lectern.streaming.replay import replayed
from lectern.streaming.translation import Translations, translations

START = datetime.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def at(seconds):
    return None if seconds is None else START + datetime.timedelta(seconds=seconds)


class Steps:
    """A stream that gets rows batch by batch; the query ends after each, and goes on from its checkpoint."""

    def __init__(self, spark, tmp_path, schema, make, sink):
        self.spark, self.path, self.schema, self.make, self.sink, self.progress = spark, str(tmp_path), schema, make, sink, []

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        self.run()

    def run(self):
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        query = self.make(stream).writeStream.foreachBatch(self.sink).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress += query.recentProgress


@pytest.fixture
def rocks(spark):
    own = {k: spark.conf.get(k, None) for k in live.STATE_STORE}
    for k, v in live.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in own.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Interval join

EVENTS = "id long, key string, ts timestamp"


def joined(stream):
    one = stream.select("id", "key", F.col("ts").alias("t1"))
    two = stream.select(F.col("id").alias("other"), "key", F.col("ts").alias("t2"))
    return interval_join(one, two, ["key"], "t1", "t2", "3 SECONDS", "60 SECONDS", "10 seconds", "leftOuter").select("id", "other")


def plain_joined(rows, until):
    out = set()
    for i, k, t in rows:
        met = {(i, j) for j, x, u in rows if None not in (k, t, x, u) and k == x and 3 <= (u - t).total_seconds() <= 60}
        out |= met or ({(i, None)} if t is not None and t + datetime.timedelta(seconds=60) < until else set())
    return out


def test_interval_join_over_restarts(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, r.choice(["a", "b", "hot", "hot"]), at(k * 2.5 + r.random())) for k in range(240)] + [(1000, None, at(5)), (1001, "a", at(20.125))]
    sink = Batches(f"{tmp_path}/out", spark.createDataFrame([], "id long, other long").schema)
    steps = Steps(spark, tmp_path, EVENTS, joined, sink.write)
    for k in range(4):
        steps.put([x for x in rows if k * 150 <= (x[2] - START).total_seconds() < (k + 1) * 150])
    last = max(x[2] for x in rows) - datetime.timedelta(seconds=10)
    got = [(x.id, x.other) for x in sink.read(spark).collect()]
    # a null key meets nothing and comes out once its time is over
    assert len(got) == len(set(got)) and set(got) == plain_joined(rows, last)
    # rows leave the state once nothing can meet them
    held = [p.stateOperators[0].numRowsTotal for p in steps.progress if p.stateOperators]
    assert max(held) > 100 and held[-1] < 80
    # a row behind the watermark is dropped, and counted
    steps.put([(2000, "a", at(1.0))])
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in steps.progress if p.stateOperators) >= 1
    with pytest.raises(ValueError):
        interval_join(spark.range(1).withColumn("t", F.now()), spark.range(1).withColumn("t", F.now()), ["id"], "t", "t", "1 SECOND", "2 SECONDS")


def two_sides(stream):
    return stream.select("id", "key", F.col("ts").alias("t1")), stream.select(F.col("id").alias("other"), "key", F.col("ts").alias("t2"))


@pytest.mark.parametrize("how", ["inner", "leftOuter"])
def test_joined_batches_over_restarts(spark, tmp_path, how):
    r = random.Random(4)
    rows = [(k, r.choice(["a", "b", "hot", "hot"]), at(k * 2.5 + r.random())) for k in range(240)] + [(1000, None, at(5)), (1001, "a", at(20.125)), (1002, "a", None), (1003, "a", at(23.125)), (1004, "a", at(80.125)), (1004, "a", at(80.125))]
    made = lambda: JoinedBatches(f"{tmp_path}/out", spark.createDataFrame([], EVENTS).schema, two_sides, ["key"], "t1", "t2", 3.0, 60.0, 10.0, how)
    failing = [2]

    def write(batch, number):
        made().write(batch, number)
        if number in failing:
            failing.remove(number)
            raise RuntimeError("ends after the write")

    steps = Steps(spark, tmp_path, EVENTS, lambda s: s, write)
    parts = [[x for x in rows if k * 150 <= ((x[2] or START) - START).total_seconds() < (k + 1) * 150] for k in range(4)]
    for k, part in enumerate(parts):
        if k == 2:
            with pytest.raises(Exception, match="ends after the write"):
                steps.put(part)
            steps.run()  # goes on from what batch 1 handed on
        else:
            steps.put(part)
    last = max(x[2] for x in rows if x[2]) - datetime.timedelta(seconds=10)
    got = [(x.id, x.other) for x in made().read(spark).collect()]
    want = {x for x in plain_joined(rows, last) if how == "leftOuter" or x[1] is not None}
    assert set(got) == want and (how == "inner") != any(x[1] is None for x in want)
    # both copies of 1004 are met, and meet something, once for each
    assert [x for x in got if x[1] == 1004 and x[0] == 1001] == [(1001, 1004)] * 2 and sum(x[0] == 1004 for x in got) == 2 * len({x for x in want if x[0] == 1004})
    # only rows that later ones may meet are handed on, and older hand-overs are gone
    held = [p for side in ("left", "right") for p in (tmp_path / "out" / side).iterdir() if p.name.startswith("batch=")]
    assert max(spark.read.parquet(str(p)).count() for p in held) < 40 and len(held) == 4
    # a row behind all rows of the batches before, and more than 10 seconds, meets nothing
    steps.put([(2000, "hot", at(570.0)), (2001, "hot", at(600.0))])
    assert 2001 in {x.other for x in made().read(spark).collect()} and not {x.id for x in made().read(spark).collect()} & {2000}


def test_joined_batches_bounds():
    for least, most, how in ((5.0, 3.0, "inner"), (-1.0, 3.0, "inner"), (1.0, 3.0, "rightOuter")):
        with pytest.raises(ValueError):
            JoinedBatches("path", None, two_sides, ["key"], "t1", "t2", least, most, how=how)


def state_updates(spark, query, sf):
    """Rows that a registered query's streams put to state stores."""
    from pyspark.sql.streaming import StreamingQueryListener

    from lectern import queries, queries_streams  # noqa: F401

    class Seen(StreamingQueryListener):
        updates, begun, ended = 0, 0, 0

        def onQueryStarted(self, event):
            self.begun += 1

        def onQueryProgress(self, event):
            self.updates += sum(op.numRowsUpdated for op in event.progress.stateOperators)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            self.ended += 1

    seen = Seen()
    spark.streams.addListener(seen)
    try:
        queries.QUERIES[query](spark, sf).count()
        for _ in range(100):
            if seen.ended >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert seen.begun == seen.ended == 3
    return seen.updates


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_answered_events_puts_no_row_to_a_state_store(spark):
    assert state_updates(spark, "answered_events", SF) == 0


# Sinks


def test_a_batch_counts_once_if_the_query_ends_between_write_and_commit(spark, tmp_path):
    sink = Batches(f"{tmp_path}/out", spark.createDataFrame([], "id long, key string, ts timestamp").schema)
    failing = [1]

    def write(rows, number):
        sink.write(rows, number)
        if number in failing:
            failing.remove(number)
            raise RuntimeError("ends after the write")

    steps = Steps(spark, tmp_path, EVENTS, lambda s: s, write)
    steps.put([(1, "a", at(0)), (2, "a", at(1))])
    with pytest.raises(Exception, match="ends after the write"):
        steps.put([(3, "b", at(2))])
    assert sorted(x.id for x in sink.read(spark).collect()) == [1, 2, 3]
    steps.run()  # the batch is written again in place of its first attempt
    steps.put([(4, "b", at(3))])
    assert sorted((x.id, x.batch) for x in sink.read(spark).collect()) == [(1, 0), (2, 0), (3, 1), (4, 2)]


def test_a_batch_cut_off_while_it_was_written_does_not_count(spark, tmp_path):
    sink = Batches(f"{tmp_path}/out", spark.createDataFrame([], "x int").schema)
    assert sink.read(spark).count() == 0
    sink.write(spark.createDataFrame([(1,)], "x int"), 0)
    sink.write(spark.createDataFrame([(2,)], "x int"), 1)
    (tmp_path / "out" / "batch=1" / "_SUCCESS").unlink()
    assert [x.x for x in sink.read(spark).collect()] == [1]


def test_result_queue(spark, tmp_path):
    queue = ResultQueue(f"{tmp_path}/queue", 3, ["x"], spark.createDataFrame([], "x int").schema)
    put = lambda number, *xs: queue.write(spark.createDataFrame([(x,) for x in xs], "x int"), number)
    seen = []
    take = lambda: queue.take(spark, lambda rows: seen.append(sorted(x.x for x in rows.collect())))
    put(0, 5, 1)
    put(1, 9, 7, 8)  # room for one
    assert sorted(x.x for x in queue.waiting(spark).collect()) == [1, 5, 7] and queue.dropped(spark) == 2
    put(1, 9, 7, 8)  # the same batch again
    assert sorted(x.x for x in queue.waiting(spark).collect()) == [1, 5, 7] and queue.dropped(spark) == 2
    put(2, 4)
    assert queue.dropped(spark) == 3
    take()
    put(3, 6)
    take()
    take()
    assert seen == [[1, 5, 7], [6], []] and queue.waiting(spark).count() == 0 and queue.dropped(spark) == 3


def test_replayed_rows_are_the_table(spark):
    df = spark.range(50).select("id", F.when(F.col("id") > 4, F.timestamp_seconds(F.col("id") + 1)).alias("ts"))
    out = replayed(df, "ts", lambda s: s.select("id"), slices=4)
    got = out.groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).orderBy("batch").collect()
    assert sum(x.n for x in got) == 50 and len(got) == 4 and all(a.last < b.first for a, b in zip(got, got[1:], strict=False))


# Translations


def plain_translations(rows, langs, keep, most, evicted):
    buffer, cache, out = {}, {}, []

    def translated(text, lang):
        if (text, lang) in cache:
            return "cache"
        cache[text, lang] = True
        if len(cache) > most:
            for k in list(cache)[:evicted]:
                del cache[k]
        return "translator"

    for turn, t, text, asked, asked_text in rows:
        for lang in langs:
            translated(text or "", lang)
            if f"{lang}:{text or ''}".strip():
                buffer[t, lang] = text or ""
        for k in [k for k in buffer if t - k[0] > keep]:
            del buffer[k]
        if asked is not None:
            for lang in langs:
                if (asked, lang) in buffer:
                    out.append((turn, lang, f"{lang}:{buffer[asked, lang]}", "buffer"))
                else:
                    out.append((turn, lang, f"{lang}:{asked_text or ''}", translated(asked_text or "", lang)))
    return out


@pytest.mark.parametrize("most,evicted", [(1000, 100), (5, 2)])
def test_translations(spark, tmp_path, rocks, most, evicted):
    r, streams = random.Random(6), {}
    for key in ("one", "two", None):
        times = [1000.0 + 4 * k for k in range(40)]
        texts = [r.choice(["good morning", "thanks", "bye", f"text {k}", None, f"line {k}"]) for k in range(40)]
        rows = []
        for k in range(40):
            back = r.choice([None, 0, 1, 5, 9])
            there = back is not None and k >= back
            rows.append((k, times[k], texts[k], times[k - back] if there else None, texts[k - back] if there else None))
        streams[key] = rows
    made = lambda s: translations(s, "stream", ["fr", "es"], lambda text, lang: f"{lang}:{text}", most=most, evicted=evicted)
    schema = "stream string, turn long, at double, text string, asked double, asked_text string"
    sink = Batches(f"{tmp_path}/out", spark.createDataFrame([], "stream string, turn long, lang string, asked double, translated string, found string").schema)
    steps = Steps(spark, tmp_path, schema, made, sink.write)
    for lo, hi in ((0, 13), (13, 14), (14, 40)):
        steps.put([(key, *x) for key, xs in streams.items() for x in xs if lo <= x[0] < hi])
    got = {}
    for x in sink.read(spark).orderBy("batch", "turn").collect():
        got.setdefault(x.stream, []).append((x.turn, x.lang, x.translated, x.found))
    for key, rows in streams.items():
        want = plain_translations(rows, ["fr", "es"], 30.0, most, evicted)
        assert sorted(got[key]) == sorted(want), key
        assert len({w[3] for w in want}) >= 2


class Held:
    """A state variable that counts its calls."""

    def __init__(self):
        self.calls, self.entries = 0, {}

    def iterator(self):
        self.calls += 1
        return iter(list(self.entries.items()))

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.entries[key]

    def get(self):
        self.calls += 1
        return self.entries.get(())

    def update(self, value):
        self.updateValue((), value)


def test_translations_call_the_state_store_a_few_times_a_batch():
    made = Translations(["fr", "es"], lambda text, lang: f"{lang}:{text}", ["stream", "turn", "lang", "asked", "translated", "found"], most=20, evicted=6)
    own, cache, timers = Held(), Held(), []

    class Handle:
        def getValueState(self, name, schema):
            return own

        def getMapState(self, name, key, value):
            return cache

        def registerTimer(self, ms):
            timers.append(ms)

    made.init(Handle())
    row = Row("turn", "at", "text", "asked", "asked_text")
    rows = [row(k, 2.0 * k, f"text {k % 30}", 2.0 * (k - 1) if k else None, f"text {(k - 1) % 30}") for k in range(200)]
    got = []
    for low, high in ((0, 90), (90, 91), (91, 200)):
        before = own.calls + cache.calls + len(timers)
        got += made.handleInputRows(("one",), iter(rows[low:high]), None)
        # its numbers and buffer, the cache, and at most the blocks that it has room for
        assert own.calls + cache.calls + len(timers) - before <= 2 + 1 + 2 * 4 + 1
        assert len(cache.entries) <= 4 and sum(len(x[0]) for x in cache.entries.values()) <= 20
    want = plain_translations([tuple(x) for x in rows], ["fr", "es"], 30.0, 20, 6)
    assert [(x.turn, x.lang, x.translated, x.found) for x in got] == want
    # one timer at a time; the stream's buffer is empty once its last one is over
    assert len(timers) == 1
    while timers:
        at_ms = timers.pop()
        assert not list(made.handleExpiredTimer(("one",), None, type("Info", (), {"getExpiryTimeInMs": lambda self, at_ms=at_ms: at_ms})()))
    assert own.entries[()][2:] == (False, [], [], [])
    with pytest.raises(ValueError):
        Translations(["fr"], str, [], most=5, evicted=6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_buffered_translations_write_a_streams_state_once_a_batch(spark):
    streams = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    # in each of three slices its numbers, and a block of the cache; then its timers
    assert state_updates(spark, "buffered_translations", SF) <= 10 * streams


# Metrics


def test_heartbeats(spark, tmp_path):
    lines = []
    listener = ME.Heartbeats("beat", lines.append, every=0.0)
    spark.streams.addListener(listener)
    try:
        sink = Batches(f"{tmp_path}/out", spark.createDataFrame([], "id long, key string, ts timestamp").schema)
        steps = Steps(spark, tmp_path, EVENTS, lambda s: ME.stream_counters(s, "beat", hot=F.count_if(F.col("key") == "hot"), mean=F.avg("id")), sink.write)
        steps.put([(1, "hot", at(0)), (2, "a", at(1)), (4, "hot", at(2))])
        steps.put([(7, "hot", at(3))])
        for _ in range(50):
            if len(lines) >= 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    import json

    found = [json.loads(x) for x in lines]
    assert [(x["rows"], x["hot"], x["mean"]) for x in found if x["rows"]] == [(3, 2, 2.333), (1, 1, 7.0)]
    listener = ME.Heartbeats("other", lines.append)
    assert listener.last is None
