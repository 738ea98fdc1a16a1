"""Corpus rows, token tables, glossaries, transcripts and heartbeats as files.

Tables are written by all tasks. Glossaries are single small files of a fixed number of terms (parameters), which the
driver writes through the file system of their path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.operators.library import chapter_glossary


def corpus(rows: DataFrame, path: str) -> None:
    """JSON lines; what is at the path goes."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def token_table(terms: DataFrame, path: str) -> None:
    """The glossary job's tokens as CSV, most frequent first, in one file for each range of counts."""
    text = F.transform("chapters", lambda c: c.cast("string"))
    rows = terms.orderBy(F.desc("n"), "first").select("token", "ascii", F.col("n").alias("count"), F.array_join(text, ",").alias("chapters"), F.array_join("sources", ",").alias("sources"), F.array_join("contexts", " | ").alias("contexts"))
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _written(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to)


def glossary_text(terms: list[str], kind: str, ascending: bool = True) -> str:
    """A glossary file: six lines about it, then a term a line, the most frequent last (or first)."""
    head = [
        f"# Bhagavad Gita Glossary ({kind.upper()})", "# Generated from corpus analysis", "# Terms sorted by frequency (ascending - most frequent at bottom)",
        "# This order optimizes Whisper transcription accuracy", f"# Total terms: {len(terms)}", "#",
    ]
    return "\n".join([*head, *(reversed(terms) if ascending else terms)]) + "\n"


def glossaries(terms: DataFrame, path: str, common: int = 200, each: int = 100, chapters: int = 18, ascending: bool = True) -> None:
    """``common_<n>[_ascii].txt`` and ``by_chapter/NN[_ascii].txt``."""
    spark = terms.sparkSession
    files = {f"common_{common}": [(r.token, r.ascii) for r in terms.orderBy(F.desc("n"), "first").limit(common).collect()]}
    ranked = chapter_glossary(terms.select("token", "ascii", "n", "chapters", "first"), each).filter(F.col("chapter").between(1, chapters))
    for r in ranked.join(terms.select("token", "ascii"), "token").orderBy("chapter", "rank").collect():
        files.setdefault(f"by_chapter/{r.chapter:02d}", []).append((r.token, r.ascii))
    for name, own in files.items():
        for k, kind in enumerate(("utf8", "ascii")):
            _written(spark, f"{path}/{name}{'_ascii' if k else ''}.txt", glossary_text([x[k] for x in own], kind, ascending))


def summary(terms: DataFrame, stats: DataFrame, path: str, most: int = 20) -> None:
    """A page with the corpus' numbers and its most frequent terms."""
    s, top = stats.first(), terms.orderBy(F.desc("n"), "first").limit(most).collect()
    lines = [
        "# Bhagavad Gita Glossaries", "", "Generated from comprehensive corpus analysis.", "", "## Statistics", "", f"- **Unique tokens**: {s.unique_tokens:,}", f"- **Total occurrences**: {s.total_occurrences:,}",
        f"- **Chapters covered**: {len(s.chapters)}", f"- **Sources**: {', '.join(s.sources)}", "", "## Files", "", "- `common_200.txt` - Top 200 most frequent terms", "- `by_chapter/01.txt` through `18.txt` - Chapter-specific terms",
        "", "## Top 20 Terms", "", *(f"{k:2d}. **{r.token}** - {r.n:,} occurrences" for k, r in enumerate(top, 1)),
    ]
    _written(terms.sparkSession, f"{path}/README.md", "\n".join(lines) + "\n")


def validated(spark: SparkSession, path: str, common: int = 200, chapters: int = 18, least: int = 10) -> dict[str, bool]:
    """Whether the common glossary and enough chapters' are there."""
    out = {"common_glossary": exists(spark, f"{path}/common_{common}.txt")}
    out["chapter_glossaries"] = sum(exists(spark, f"{path}/by_chapter/{k:02d}.txt") for k in range(1, chapters + 1)) >= least
    return out | {"all_valid": all(out.values())}


def subtitles(segments: DataFrame, stream: str = "stream") -> DataFrame:
    """A row for each segment (start, end, text) of a stream with its subtitle block: number from 1, times, text."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(stream).orderBy("start", "end"))
    block = F.concat(number.cast("string"), F.lit("\n"), C.srt_time(F.col("start")), F.lit(" --> "), C.srt_time(F.col("end")), F.lit("\n"), C.strip(F.col("text")), F.lit("\n"))
    return segments.withColumn("number", number.cast("long")).withColumn("block", block)


def transcripts(results: DataFrame, kind: str) -> DataFrame:
    """``out``: transcription results (text, segments, ...) as json (all columns) or plain text."""
    if kind == "json":
        return results.withColumn("out", F.to_json(F.struct(*results.columns)))
    if kind == "text":
        return results.withColumn("out", F.col("text"))
    raise ValueError(f"no such output: {kind}")


def heartbeats(metrics: DataFrame, at: str = "timestamp", every: float = 60.0) -> DataFrame:
    """One row of metrics for each ``every`` seconds, the first in it, as JSON with rounded seconds."""
    from pyspark.sql import Window

    span = F.floor(F.col(at) / every)
    first = F.row_number().over(Window.partitionBy("_span").orderBy(at))
    rows = metrics.withColumn("_span", span).withColumn("_r", first).filter("_r = 1").drop("_r", "_span")
    return rows.select(F.col(at), F.to_json(F.struct(*metrics.columns)).alias("line"))
