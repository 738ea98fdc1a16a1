"""Named queries that write tables as the library's files and read them back, and live windows and machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.machines import BoundedBuffer
from lectern.operators import corpus as K
from lectern.plans import jobs
from lectern.queries import _TERMS, _UNIQUE, _events, query, table
from lectern.queries_more import _COUNTED, _SEEN
from lectern.sinks import files as sinks
from lectern.sinks.shared import folder
from lectern.sources import files as sources
from lectern.streaming import live
from lectern.streaming.replay import replayed

# Files


@query("SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS malformed FROM documents GROUP BY source")
def corpus_lines(spark, sf):
    """Documents as JSON lines among broken ones, read back and counted."""
    docs, path = table(spark, sf, "documents"), folder(spark, "corpus")
    rows = docs.select(
        F.concat(F.lit("doc://"), "doc_id").alias("url"), F.lit("").alias("title"), "text", (F.col("doc_id") % 18 + 1).cast("int").alias("chapter"), F.lit("general").alias("verse"), "source",
        F.lit(0.0).alias("timestamp"), F.col("n_chars").cast("int").alias("word_count"),
    )
    sinks.corpus(rows, f"{path}/lines")
    docs.filter("doc_id % 10 = 0").select(F.concat(F.lit('{"url": '), "doc_id").alias("value")).write.mode("append").text(f"{path}/lines")
    broken = sources.malformed(spark, f"{path}/lines").agg(F.count("*").alias("malformed"))
    found = sources.corpus(spark, f"{path}/lines").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return found.crossJoin(F.broadcast(broken))  # one row


@query(f"WITH {_UNIQUE}, {_SEEN}, {_TERMS}, {_COUNTED} SELECT token, strip_accents(lower(token)) AS ascii, n, array_to_string(chapters, ',') AS chapters, array_to_string(sources, ',') AS sources FROM g")
def vocabulary_table(spark, sf):
    """The vocabulary job over all documents, and the token table that it wrote."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text", (F.col("doc_id") % 18 + 1).cast("int").alias("chapter"), "source")
    path = folder(spark, "vocabulary")
    jobs.vocabulary_of(rows, path, table="tokens")
    terms = spark.read.schema("token string, ascii string, n long, chapters string, sources string, contexts string").option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/tokens")
    return terms.drop("contexts")


@query(r"SELECT DISTINCT lower(word) AS wrong, 'the word ' || lower(word) AS canonical FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM benchmark)")
def dictionary_file(spark, sf):
    """The benchmark's words as a dictionary file with remarks and blank lines."""
    path = folder(spark, "dictionary")
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    lines = words.select(F.explode(F.array(F.concat(F.lit(" "), "word", F.lit(" -> the word "), F.lower("word"), F.lit("  ")), F.lit("# a remark"), F.lit(""))).alias("value"))
    lines.write.text(path)
    return sources.dictionary(spark, path).select("wrong", "canonical")


@query(
    "WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations), q AS (SELECT regexp_replace(text, '\\s+', ' ', 'g') AS english, regexp_replace(reply, '\\s+', ' ', 'g') AS spanish FROM p WHERE reply IS NOT NULL) "
    "SELECT md5(english) AS english, md5(spanish) AS spanish, count(*) AS n FROM q GROUP BY ALL"
)
def parallel_file(spark, sf):
    """Turns and their replies as a tab-separated parallel corpus."""
    from pyspark.sql import Window

    reply = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    rows = table(spark, sf, "conversations").withColumn("reply", reply).filter("reply IS NOT NULL")
    path = folder(spark, "parallel")
    rows.select(F.concat_ws("\t", flat("text"), flat("reply"), F.lit("meta")).alias("value")).write.text(path)
    return sources.parallel(spark, path).groupBy(F.md5("english").alias("english"), F.md5("spanish").alias("spanish")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT event_id, epoch(ts) AS t, floor(epoch(ts) / 86400) AS day FROM events) SELECT event_id, round(t, 3) AS at FROM e QUALIFY row_number() OVER (PARTITION BY day ORDER BY t) = 1")
def heartbeat_lines(spark, sf):
    """The first event of each day as a heartbeat line."""
    rows = _events(spark, sf).select("event_id", F.col("ts").cast("double").alias("timestamp"), "value")
    lines = sinks.heartbeats(rows, every=86400.0)
    return lines.select(F.from_json("line", "event_id long").event_id.alias("event_id"), F.round("timestamp", 3).alias("at"))


@query(
    "WITH s AS (SELECT vec_id, embedding AS e, greatest(1, CAST(ceil(greatest(0, len(embedding) - 8) / 6.0) AS BIGINT) + 1) AS n FROM embeddings), c AS (SELECT vec_id, e, unnest(range(0, n)) AS chunk FROM s) "
    "SELECT vec_id, chunk, chunk * 6 / 8.0::DOUBLE AS start, round(list_sum(list_transform(list_slice(e, chunk * 6 + 1, chunk * 6 + 8), lambda x: x::DOUBLE)), 4) + 0.0::DOUBLE AS total FROM c"
)
def sound_chunks(spark, sf):
    """Vectors as sound of eight samples a second, cut into overlapping seconds, the last one filled with zeros."""
    rows = sources.audio_chunks(table(spark, sf, "embeddings").select("vec_id", "embedding"), rate=8, size=1.0, overlap=0.25)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select(F.col("stream").alias("vec_id"), "chunk", "start", (F.round(total, 4) + 0.0).alias("total"))


@query(
    "SELECT conv_id, turn, coalesce(name, 'none') AS chapter, CASE WHEN name IS NULL THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN name IS NULL THEN 0 ELSE length(glossary) END AS chars "
    "FROM conversations LEFT JOIN (SELECT 'bg' || item_id AS name, text AS glossary FROM benchmark) ON name = 'bg' || (conv_id % 50)"
)
def guessed_glossaries(spark, sf):
    """The glossary of the chapter that a recording's name tells."""
    names = table(spark, sf, "benchmark").select(F.concat(F.lit("bg"), "item_id").alias("name"), "text")
    turns = table(spark, sf, "conversations").withColumn("path", F.concat(F.lit("talks/BG_"), F.col("conv_id") % 50, F.lit(".mp4"))).withColumn("previous", F.lit(""))
    out = K.chosen_glossary(turns, "chapter_guess", glossaries=names, path="path", previous="previous")
    chars = F.when(F.col("guessed_chapter").isNotNull(), F.length("glossary")).otherwise(0).cast("long")
    return out.select("conv_id", "turn", F.coalesce("guessed_chapter", F.lit("none")).alias("chapter"), "confidence", chars.alias("chars"))


# Live windows and machines

_CLOSED = "(SELECT epoch(max(ts)) - 10 FROM events)"


@query(f"WITH w AS (SELECT event_type, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM w WHERE start + 21600 <= {_CLOSED}")
def live_window_counts(spark, sf):
    """Six-hour windows of a stream; one comes out once the stream's time is ten seconds past its end."""
    out = replayed(table(spark, sf, "events"), "ts", lambda s: live.tumbling(live.timed(s, "ts"), "ts", "6 hours", "event_type"))
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "n")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 21600 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), "
    f"x AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, CAST(floor(epoch(first)) AS BIGINT) AS start, n FROM x WHERE epoch(last) + 21600 <= {_CLOSED}"
)
def live_session_counts(spark, sf):
    """Sessions of a stream, closed by six hours of silence."""
    out = replayed(table(spark, sf, "events"), "ts", lambda s: live.sessions(live.timed(s, "ts"), "ts", "6 hours", "user_id"))
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("SELECT event_id, CASE WHEN row_number() OVER w <= 25 THEN 'added' ELSE 'dropped oldest' END AS event, coalesce(CAST(lag(event_id, 25) OVER w AS VARCHAR), '') AS dropped, least(25, row_number() OVER w) AS size FROM events WINDOW w AS (PARTITION BY event_type, user_id % 20 ORDER BY event_id)")
def live_buffers(spark, sf):
    """Bounded buffers as state machines of a stream, over restarts."""
    rows = table(spark, sf, "events").select(F.concat_ws(":", "event_type", F.col("user_id") % 20).alias("stream"), "event_id", F.col("event_id").cast("string").alias("item"), "ts")
    out = replayed(rows, "ts", lambda s: live.live(s, "stream", ["event_id"], BoundedBuffer(25)))
    return out.select("event_id", "event", F.coalesce("dropped", F.lit("")).alias("dropped"), "size")
