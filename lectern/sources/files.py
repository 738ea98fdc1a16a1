"""Corpus rows, dictionaries, glossaries, parallel texts, pages and sound as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import columns as C

CORPUS = "url string, title string, text string, chapter int, verse string, source string, timestamp double, word_count int"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus rows of JSON lines in the order of the file (``seq``); blank and malformed lines are left out, and so are
    rows without a text."""
    rows = spark.read.schema(CORPUS + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt IS NULL AND text IS NOT NULL").drop("_corrupt").withColumn("seq", F.monotonically_increasing_id())


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``corpus`` leaves out as malformed."""
    lines = spark.read.text(path).filter(C.strip("value") != "")
    parsed = F.from_json("value", CORPUS + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.filter(parsed._corrupt.isNotNull()).select(F.col("value").alias("line"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """wrong (lower case), canonical, entry of a text file: ``wrong -> right`` or one term a line; blank lines and those
    that begin with # are left out. A later entry for the same spelling replaces an earlier one."""
    lines = spark.read.text(path).select(C.strip("value").alias("line"), F.monotonically_increasing_id().alias("entry"))
    lines = lines.filter("line <> '' AND NOT startswith(line, '#')")
    sides = F.split("line", "->", 2)
    arrow = F.contains("line", F.lit("->"))
    wrong = F.lower(F.when(arrow, C.strip(sides[0])).otherwise(F.col("line")))
    right = F.when(arrow, C.strip(F.try_element_at(sides, F.lit(2)))).otherwise(F.col("line"))
    rows = lines.select(wrong.alias("wrong"), right.alias("canonical"), "entry").filter("wrong <> ''")
    return rows.groupBy("wrong").agg(F.max_by("canonical", "entry").alias("canonical"), F.min("entry").alias("entry"))


def glossaries(spark: SparkSession, path: str) -> DataFrame:
    """Glossary files as they are: ``name`` (the file's in lower case, without its ending) and ``text``."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.lower(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", ""))
    return rows.select(name.alias("name"), C.strip("value").alias("text"))


def parallel(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a tab-separated parallel corpus, without their metadata."""
    return spark.read.schema("english string, spanish string, metadata string").option("sep", "\t").option("quote", "").csv(path).drop("metadata")


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """An external caption table: JSON lines of start and text."""
    return spark.read.schema("start double, text string").json(path).filter("start IS NOT NULL")


def chapter_pages(spark: SparkSession, base: str, chapters: int = 18, visited: DataFrame | None = None) -> DataFrame:
    """chapter and url of the pages still to be read."""
    pages = spark.range(1, chapters + 1).select(F.col("id").cast("int").alias("chapter"), F.concat(F.lit(base), F.col("id"), F.lit("/")).alias("url"))
    return pages if visited is None else pages.join(visited.select("url"), "url", "left_anti").select("chapter", "url")


class _Text(HTMLParser):
    """All text of a page; of each ``div.verse-container`` the first ``div.sanskrit`` apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.verses: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            names = (dict(attrs).get("class") or "").split()
            inside = "box" in self.open or "done" in self.open
            kind = "box" if "verse-container" in names else "verse" if "sanskrit" in names and "box" in self.open else ""
            if kind == "verse":
                self.open[max(k for k, x in enumerate(self.open) if x == "box")] = "done"
                self.verses.append("")
            self.open.append(kind if kind or not inside else "")

    def handle_endtag(self, tag):
        if tag == "div" and self.open:
            self.open.pop()

    def handle_data(self, data):
        self.text.append(data)
        if "verse" in self.open:
            self.verses[-1] += data


def page_parts(page: str | None) -> tuple[str, list[str]]:
    """A page's text, and the texts of its verses."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    return "".join(parser.text), [v.strip() for v in parser.verses if v.strip()]


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns with ``text`` and ``verse_texts``; null pages have neither."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("verse_texts", T.ArrayType(T.StringType()))]))
    def parts(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_parts(p) for p in x], columns=["text", "verse_texts"])

    return pages.withColumn("_parts", parts(html)).select(*pages.columns, "_parts.*")


def mono(samples: np.ndarray, channels: int, size: int) -> np.ndarray:
    """Interleaved samples as their channels' mean, with zeros up to ``size``; silence where there is nothing."""
    whole = samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1) if len(samples) else samples
    out = np.zeros(size, np.float32)
    out[: min(size, len(whole))] = whole[:size]
    return out


#: Zero crossings of the resampling kernel on each side.
CROSSINGS = 32


def resampled(samples: np.ndarray, given: int, rate: int) -> np.ndarray:
    """Samples at another rate, by a windowed sinc kernel below the lower of both half rates: ceil(n * rate / given) of
    them. Up and down factors are reduced, so the kernel has one set of weights for each of the target's phases."""
    if given == rate or not len(samples):
        return samples.astype(np.float32)
    up, down = (x // np.gcd(given, rate) for x in (rate, given))
    n, cut = -(-len(samples) * up // down), min(1.0, rate / given)
    reach = int(np.ceil(CROSSINGS / cut))
    padded = np.pad(samples.astype(np.float64), reach)
    out = np.empty(n, np.float32)
    offsets = np.arange(-reach, reach + 1)
    for phase in range(min(int(up), n)):  # targets of one phase lie equally between two samples
        places = np.arange(phase, n, up) * int(down)
        whole, part = places // int(up), (places[0] % int(up)) / up
        x = offsets - part
        kernel = cut * np.sinc(cut * x) * np.where(np.abs(x) <= reach, np.kaiser(4097, 12.0)[np.clip(np.round((x / reach + 1) * 2048), 0, 4096).astype(int)], 0.0)
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(offsets))
        for k in range(0, len(whole), 1 << 14):
            at = np.minimum(whole[k : k + (1 << 14)], len(windows) - 1)
            out[phase + k * int(up) : phase + (k + len(at)) * int(up) : int(up)] = windows[at] @ kernel
    return out


def audio_chunks(sound: DataFrame, rate: int = 16000, size: float = 1.0, overlap: float = 0.2, channels: int = 1, seek: float = 0.0, given: int | None = None) -> DataFrame:
    """Rows (stream, samples array<float>) cut into overlapping chunks: stream, chunk, start, samples. The last chunk of a
    stream is filled with zeros. ``given``: the samples' rate where it isn't ``rate``; chunks are made at that rate,
    mixed to one channel, and then resampled."""
    target, rate = rate, given or rate
    if not (size > 0 and 0 <= overlap < size):
        raise ValueError("a chunk has to be longer than its overlap")
    step, each = int((size - overlap) * rate), int(size * rate)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stream, samples in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                own = np.zeros(0, np.float32) if samples is None else np.asarray(samples, np.float32)
                own = own[int(seek * rate) * channels :]
                n = max(1, -(-max(0, len(own) // channels - each) // step) + 1)
                cut = [resampled(mono(own[k * step * channels : (k * step + each) * channels], channels, each), rate, target) for k in range(n)]
                yield pd.DataFrame({"stream": [stream] * n, "chunk": range(n), "start": [seek + k * step / rate for k in range(n)], "samples": [list(x) for x in cut]})

    schema = T.StructType([T.StructField("stream", sound.schema.fields[0].dataType), *T._parse_datatype_string("chunk long, start double, samples array<float>").fields])
    return sound.select(*sound.columns[:2]).mapInPandas(run, schema)


def durations(sound: DataFrame, rate: int = 16000, channels: int = 1, offset: float = 0.0) -> DataFrame:
    """Seconds of each stream's sound from an offset on."""
    return sound.select(sound.columns[0], F.greatest(F.lit(0.0), F.coalesce(F.size(sound.columns[1]), F.lit(0)) / (rate * channels) - offset).alias("seconds"))


def cached_media(requests: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """Requests with ``video_id``, ``remote`` (an address of a video site) and the cached ``path``, if there is one."""
    out = requests.withColumn("video_id", C.video_id(F.col(url))).withColumn("remote", F.col("video_id").isNotNull())
    return out.join(cache.select("video_id", "path"), "video_id", "left")
