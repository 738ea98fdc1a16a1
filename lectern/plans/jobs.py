"""The three jobs end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.functions.machines import CaptionTimeline
from lectern.operators import corpus as K
from lectern.operators.correction import corrected
from lectern.operators.library import glossary_rows
from lectern.operators.streams import folded
from lectern.sinks import files as sinks
from lectern.sinks.shared import written
from lectern.sources import files as sources


def vocabulary(spark: SparkSession, source: str, target: str, common: int = 200, each: int = 100, ascending: bool = True, table: str = "gita_tokens") -> dict[str, bool]:
    """Corpus rows (JSON lines) to the token table (of the given name), glossaries and summary under ``target``; what is
    valid of them. The terms are written once and read again for each of these."""
    return vocabulary_of(sources.corpus(spark, source), target, common, each, ascending, table)


def vocabulary_of(corpus: DataFrame, target: str, common: int = 200, each: int = 100, ascending: bool = True, table: str = "gita_tokens") -> dict[str, bool]:
    """``vocabulary`` of corpus rows with their order ``seq``, such as ``samples.sample_corpus``."""
    spark = corpus.sparkSession
    terms = written(glossary_rows(corpus, "text", "seq", "chapter", "source"), "terms")
    sinks.token_table(terms, f"{target}/{table}")
    sinks.glossaries(terms, f"{target}/glossaries", common, each, ascending=ascending)
    sinks.summary(terms, K.stats(terms), f"{target}/glossaries")
    return sinks.validated(spark, f"{target}/glossaries", common)


def captions(segments: DataFrame, stream: str, order: list[str], seek: float = 0.0, level: str = "MODERATE") -> DataFrame:
    """Captions that a finished stream of segments (text, start_time, end_time, now) leads to."""
    out = folded(segments, stream, order, CaptionTimeline(seek=seek, level=level))
    return out.filter("action = 'added'").select(stream, *order, "caption_id", F.col("caption").alias("text"), F.col("caption_start").alias("start_time"), F.col("caption_end").alias("end_time"))


def transcripts(results: DataFrame, terms: DataFrame, key: str = "stream") -> DataFrame:
    """Transcription results (key, segments array<struct<text, start, end>>, glossary) with the joined text, how many
    glossary words it has, its correction by a dictionary, and the whole as JSON."""
    text = C.strip(F.array_join(F.transform("segments", lambda s: C.strip(s.text)), " "))
    out = results.withColumn("text", text).withColumn("glossary_matches", C.glossary_matches(F.col("text"), F.col("glossary")))
    return sinks.transcripts(corrected(out, terms, key, "text"), "json")
