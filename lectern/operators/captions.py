"""Captions as rows (stream, id, text, start, end): frames, lookups, removal, layers, and two sources side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import columns as C


def frames(captions: DataFrame, fps: int, start: str = "s", end: str = "e", seek: float = 0.0) -> DataFrame:
    """A row for each frame (``frame``, ``t`` = frame / fps, from ``seek`` on) at which a caption is active. Frames lie on
    a grid, so a caption knows its own and nothing has to meet."""
    first = F.greatest(F.ceil(F.col(start) * fps), F.lit(int(-(-seek * fps // 1))).cast("long"), F.lit(0).cast("long"))
    last = F.floor(F.col(end) * fps)
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return captions.withColumn("frame", F.explode(numbers)).withColumn("t", F.col("frame") / F.lit(float(fps)))


def added(segments: DataFrame, stream: str, order: str, text: str, at: str, duration: Column, absolute: Column | None = None, start: Column | None = None) -> DataFrame:
    """Captions with ids from 1 by stream: blank texts are left out, absolute times count from the stream's start, and
    nothing starts before 0."""
    t = F.col(at) if absolute is None else F.when(absolute, F.col(at) - start).otherwise(F.col(at))
    out = segments.filter(C.strip(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("start_time", F.greatest(t, F.lit(0.0)))
    number = F.row_number().over(Window.partitionBy(stream).orderBy(order)).cast("long")
    return out.withColumn("end_time", F.col("start_time") + duration).withColumn("caption_id", number)


def pruned(captions: DataFrame, now: Column, end: str = "end_time", buffer: float = 1.0) -> DataFrame:
    """Captions that ended less than ``buffer`` seconds ago or are still to end."""
    return captions.filter(F.col(end) > now - buffer)


def without_overlap(captions: DataFrame, since: Column, until: Column, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Captions outside a span; touching it is not overlapping."""
    return captions.filter(~((F.col(start) < until) & (F.col(end) > since)))


def removed(captions: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Captions without those of the given ids."""
    return captions.join(ids, on, "left_anti")


def upcoming(captions: DataFrame, stream: str, at: Column, most: int = 3, start: str = "start_time") -> DataFrame:
    """Each stream's next captions after a time."""
    w = Window.partitionBy(stream).orderBy(start, "caption_id")
    return captions.filter(F.col(start) > at).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def layered(active: DataFrame, stream: str, frame: str, start: str = "start_time", primary: str = "is_primary") -> DataFrame:
    """Active captions of each frame with ``layer`` from 0: those of the primary language first, by start."""
    w = Window.partitionBy(stream, frame).orderBy(F.desc(F.coalesce(F.col(primary), F.lit(True))), start, "caption_id")
    return active.withColumn("layer", (F.row_number().over(w) - 1).cast("int"))


def latest_only(active: DataFrame, stream: str, frame: str, start: str = "start_time") -> DataFrame:
    """Of each frame's active captions the one that started last."""
    w = Window.partitionBy(stream, frame).orderBy(F.desc(start), F.desc("caption_id"))
    return active.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def subtitled(captions: DataFrame, subtitles: DataFrame, at: str = "start_time") -> DataFrame:
    """``subtitle``: the external text (start, text) at exactly the caption's time (as its shortest decimal text), else
    the caption's own. The first of several texts in their order counts."""
    other = subtitles.groupBy(F.col("start").cast("string").alias("_at")).agg(F.min("text").alias("_text"))
    out = captions.join(other, F.col(at).cast("string") == F.col("_at"), "left")
    return out.withColumn("subtitle", F.coalesce("_text", "text")).drop("_at", "_text")


def translated(captions: DataFrame, buffered: DataFrame, at: str, language: str, direct: Column) -> DataFrame:
    """``translation``: the buffered one (ts, lang, text) of that time and language, else the direct one; rows whose
    translation is blank or says the same are left out."""
    keyed = buffered.groupBy(F.concat_ws(":", F.col("ts").cast("string"), "lang").alias("_key")).agg(F.max_by("text", "ts").alias("_text"))
    out = captions.join(keyed, F.concat_ws(":", F.col(at).cast("string"), F.col(language)) == F.col("_key"), "left")
    out = out.withColumn("translation", F.coalesce("_text", direct)).drop("_key", "_text")
    return out.filter((C.strip(F.coalesce("translation", F.lit(""))) != "") & (F.col("translation") != F.col("text")))


def compared(one: DataFrame, two: DataFrame, on: list[str]) -> DataFrame:
    """Two sources' texts side by side: ``one`` and ``two``, null where a source has none, and how alike they are."""
    a, b = one.select(*on, F.col("text").alias("one")), two.select(*on, F.col("text").alias("two"))
    return a.join(b, on, "full").withColumn("similarity", C.text_similarity(F.col("one"), F.col("two")))


def scheduled(spark, now: float, after: tuple[float, ...] = (1.0, 3.0, 5.0), duration: float = 10.0) -> DataFrame:
    """Test captions at fixed times from now."""
    rows = [(k, f"Test caption {k}", now + x, now + x + duration) for k, x in enumerate(after, 1)]
    return spark.createDataFrame(rows, "caption_id long, text string, start_time double, end_time double")
