"""Relational operators of the transcript and corpus engine, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.columns import SPACE, strip
from lectern.functions.lists import CANONICAL, STOP_WORDS
from lectern.functions.machines import SegmentCleaner
from lectern.functions.segments import ascii_fold, sentences
from lectern.operators import neighbourhood
from lectern.operators.streams import folded
from lectern.sinks.shared import written

TOKEN = r"[\p{L}\p{N}_]+"


def first_of_equal(df: DataFrame, text: str, order: str) -> DataFrame:
    """Keep one row of rows with equal texts, compared without case and white space: the first by ``order`` (nulls last;
    of rows equal in that too, any). Rows meet on a digest, and a task sends one row of each digest it has, so a text
    that a third of all rows share doesn't gather in one task."""
    norm = strip(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE + "+", " "))
    first = F.row_number().over(Window.partitionBy("_norm").orderBy(F.col(order).asc_nulls_last()))
    return df.withColumn("_norm", F.sha2(norm, 256)).withColumn("_row", first).filter("_row = 1").drop("_norm", "_row")


def tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each word: kept columns, ``pos`` and ``token``."""
    return df.select(*keep, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))


def is_term(token: Column) -> Column:
    """2 to 50 characters, no stop word, not only digits."""
    return F.length(token).between(2, 50) & ~F.lower(token).isin(STOP_WORDS) & ~token.rlike(r"^\p{N}+$")


def vocabulary(df: DataFrame, text: str, order: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of terms, by further columns if asked."""
    return tokens(df, text, order, *by).filter(is_term(F.col("token"))).groupBy("token", *by).agg(F.count("*").alias("n"), F.countDistinct(order).alias("docs"))


GLOSSARY_TOKEN = r"(?U)\b[\wऀ-ॿ]+\b"


#: Words that are counted at once in a task.
_AT_ONCE = 2_000_000


def _unique(df: DataFrame, text: str, seq: str, chapter: str, source: str) -> DataFrame:
    """Different texts: seq, text, chapter, source."""
    return first_of_equal(df.select(F.col(seq).alias("seq"), F.col(text).alias("text"), F.col(chapter).alias("chapter"), F.col(source).alias("source")), "text", "seq")


def _counted(unique: DataFrame, most: int) -> DataFrame:
    """The terms of texts: token, n, chapters, sources and the first ``places`` (seq, pos), ``most`` at the most. Texts are
    tokenised once; a task sends a row for each word of a batch."""
    kinds = {c: unique.schema[c].dataType.simpleString() for c in ("seq", "chapter", "source")}
    schema = f"token string, n long, chapters array<{kinds['chapter']}>, sources array<{kinds['source']}>, places array<struct<seq:{kinds['seq']},pos:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield _seen(part, most)

    words = unique.select("seq", F.when(F.col("chapter") != 0, F.col("chapter")).alias("chapter"), "source", F.regexp_extract_all("text", F.lit(GLOSSARY_TOKEN), F.lit(0)).alias("words"))
    each = words.mapInArrow(run, schema).filter(is_term(F.col("token")))
    every = lambda c: F.flatten(F.collect_list(c))
    return each.groupBy("token").agg(
        F.sum("n").alias("n"), F.array_sort(F.array_distinct(every("chapters"))).alias("chapters"), F.array_sort(F.array_distinct(every("sources"))).alias("sources"),
        F.slice(F.array_sort(every("places")), 1, most).alias("places"),
    )


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``_AT_ONCE`` words (last column) each."""
    until = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)) // _AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(until)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(low, high - low)


def _lists(owner: np.ndarray, values: pa.Array, owners: int) -> pa.ListArray:
    """Values, in order of the number of their owner, as a list for each owner."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))]), pa.int32()), values)


def _seen(batch: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """A row for each different word of the rows (seq, chapter, source, words): how often it occurs, where, and the first
    ``most`` places by (seq, pos), nulls first."""
    seq, chapter, source, words = batch.columns
    parent = pc.list_parent_indices(words).to_numpy().astype(np.int64)
    encoded = words.flatten().dictionary_encode()
    codes, size = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
    pos = np.arange(len(parent)) - np.searchsorted(parent, parent)
    place = pc.rank(seq, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)[parent]
    longest, rows = int(pos.max(initial=0)) + 1, batch.num_rows + 1
    order = np.argsort((codes * rows + place) * longest + pos) if size * rows * longest < 2**62 else np.lexsort((pos, place, codes))
    codes, parent, pos = codes[order], parent[order], pos[order]
    n = np.bincount(codes, minlength=size)
    early = np.arange(len(codes)) - (np.cumsum(n) - n)[codes] < most
    places = pa.StructArray.from_arrays([seq.take(pa.array(parent[early])), pa.array(pos[early], pa.int32())], ["seq", "pos"])

    def different(column: pa.Array) -> pa.ListArray:
        own = column.dictionary_encode()
        code = own.indices.fill_null(-1).to_numpy().astype(np.int64)[parent]
        found = np.unique(codes[code >= 0] * max(1, len(own.dictionary)) + code[code >= 0])
        owner, value = np.divmod(found, max(1, len(own.dictionary)))
        return _lists(owner, own.dictionary.take(pa.array(value)), size)

    columns = [encoded.dictionary, pa.array(n, pa.int64()), different(chapter), different(source), _lists(codes[early], places, size)]
    return pa.record_batch(columns, ["token", "n", "chapters", "sources", "places"])


def term_counts(df: DataFrame, text: str, seq: str, chapter: str, source: str) -> DataFrame:
    """The vocabulary job without contexts: token, ascii, n, chapters, sources and first sight (seq, pos). Texts are read
    and tokenised once; counts are summed in each task."""
    return _counted(_unique(df, text, seq, chapter, source), 1).withColumn("first", F.col("places")[0]).drop("places").withColumn("ascii", ascii_folded("token"))


def glossary(df: DataFrame, text: str, seq: str, chapter: str, source: str, most: int = 5, top: int | None = None) -> DataFrame:
    """The corpus-to-vocabulary job: token, ascii, n, chapters, sources, up to ``most`` contexts and first sight (seq,
    pos), in order of count and first sight; ``top``: only the first so many of them. A context is the text around the
    token's first occurrence in the document."""
    return glossary_rows(df, text, seq, chapter, source, most, top).orderBy(F.desc("n"), "first")


def glossary_rows(df: DataFrame, text: str, seq: str, chapter: str, source: str, most: int = 5, top: int | None = None) -> DataFrame:
    """``glossary`` in any order. The different texts and the counted terms are written once. Counts are partial sums
    without texts, and carry the first ``most`` places of a token; only those documents' texts meet them, of ``top``
    tokens where that is given."""
    unique = written(_unique(df, text, seq, chapter, source), "texts")
    counts = _counted(unique, most).withColumn("first", F.col("places")[0])
    counts = written(counts if top is None else counts.orderBy(F.desc("n"), "first").limit(top), "counts")
    early = counts.select("token", F.posexplode("places").alias("rank", "place"))
    wanted = early.groupBy(F.col("place.seq").alias("seq")).agg(F.collect_list(F.struct("token", "rank")).alias("tokens"))
    around = unique.select("seq", "text").join(wanted, "seq").select("text", "tokens").mapInArrow(_contexts, "token string, rank int, context string")
    contexts = around.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rank", "context"))).alias("_c"))
    out = counts.join(contexts, "token").withColumn("contexts", F.transform("_c", lambda c: c.context)).withColumn("ascii", ascii_folded("token"))
    return out.select("token", "ascii", "n", "chapters", "sources", "contexts", "first")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each token listed for a text, what stands around its first occurrence in any case: 30 characters on each side,
    stripped, 100 at most. A text is lowered once; a search for each token in the engine's own functions took 20 of 27 s
    at 10,000 documents. Only texts and contexts become objects of Python one by one."""
    for batch in batches:
        listed = batch.column(1).flatten()
        tokens, ranks = listed.field("token"), listed.field("rank")
        lowered, sizes = [t.lower() for t in tokens.to_pylist()], pc.utf8_length(tokens).to_pylist()
        out: list[str] = []
        for text, many in zip(batch.column(0), pc.list_value_length(batch.column(1)).to_pylist(), strict=True):
            text = text.as_py()
            low = text.lower()
            for k in range(len(out), len(out) + many):
                at = low.find(lowered[k])
                out.append(text[max(0, at - 30) : at + sizes[k] + 30].strip()[:100] if at >= 0 else "")
        yield pa.record_batch([tokens, ranks, pa.array(out, pa.string())], ["token", "rank", "context"])


@F.pandas_udf(T.StringType())
def ascii_folded(x: pd.Series) -> pd.Series:
    """``segments.ascii_fold`` of distinct values."""
    return x.map(lambda t: None if t is None else ascii_fold(t))


def chapter_glossary(terms: DataFrame, most: int = 100) -> DataFrame:
    """Of each chapter the terms with the greatest share (count over number of chapters)."""
    each = terms.select("token", F.floor(F.col("n") / F.size("chapters")).alias("score"), "first", F.explode("chapters").alias("chapter"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("score"), "first"))).filter(F.col("rank") <= most)


def dictionary(spark) -> DataFrame:
    """wrong (lower case), canonical and the order of entries."""
    return spark.createDataFrame([(w, c, i) for i, (w, c) in enumerate(CANONICAL.items())], "wrong string, canonical string, entry int")


def fuzzy_corrections(words: DataFrame, terms: DataFrame, most: int = 2, least: float = 80.0) -> DataFrame:
    """``neighbourhood.corrections``: by deletion neighbourhoods, against a dictionary of any size."""
    return neighbourhood.corrections(words, terms, most, least)


def range_join(points: DataFrame, spans: DataFrame, t: str, start: str, end: str, width: float = 1.0, key: str | None = None) -> DataFrame:
    """Rows of both where start <= t <= end: an equi-join on buckets of time (and a stream key), then the exact test."""
    p = points.withColumn("_b", F.floor(F.col(t) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    on = ["_b", key] if key else ["_b"]
    return p.join(s, on).filter((F.col(start) <= F.col(t)) & (F.col(t) <= F.col(end))).drop("_b")


def outside_overlap(spans: DataFrame, others: DataFrame, start: str, end: str, key: str, margin: float = 1.0, width: float = 16.0) -> DataFrame:
    """Spans that no other row's span (widened by ``margin``) overlaps; both hold ``key`` (stream) and ``id``."""
    a = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    b = others.select(F.col(key).alias("_k"), F.col("id").alias("_id"), (F.col(start) - margin).alias("_s"), (F.col(end) + margin).alias("_e")).withColumn("_b2", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    hit = a.join(b, (a["_b"] == b["_b2"]) & (a[key] == b["_k"]) & (F.col("id") > F.col("_id")) & (F.col(start) < F.col("_e")) & (F.col(end) > F.col("_s")), "left_semi").select("id").distinct()
    return spans.join(hit, "id", "left_anti")


def clean_streams(turns: DataFrame, stream: str = "conv_id", seq: str = "turn", text: str = "text", level: str = "OFF") -> DataFrame:
    """Every stream's segments in order through the history, repetition and (by level) profanity cleaners."""
    base = turns.select(F.col(stream).alias("stream"), F.col(seq).alias("seq"), F.col(text).alias("text"))
    return folded(base, "stream", ["seq"], SegmentCleaner(level))


def sentence_states(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each sentence: text, state, confidence, word_count."""

    @F.pandas_udf("array<struct<text:string,state:string,confidence:double,word_count:int>>")
    def split(x: pd.Series) -> pd.Series:
        return x.fillna("").map(sentences)

    return df.select(*keep, F.posexplode(split(text)).alias("pos", "s")).select(*keep, "pos", "s.*")


def trailing(df: DataFrame, key: str, seconds: Column, span: float, flag: Column, name: str) -> DataFrame:
    """Of each row's last ``span`` seconds (itself included) the number of flagged rows of its key."""
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-span, 0)
    return df.withColumn("_t", seconds).withColumn(name, F.sum(flag.cast("int")).over(w)).drop("_t")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Rows with the number of their session: a gap longer than ``gap_seconds`` starts a new one."""
    w = Window.partitionBy(key).orderBy(ts)
    fresh = (F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)) > gap_seconds).cast("int")
    return df.withColumn("session", F.sum(F.coalesce(fresh, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def keep_last(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """A bounded buffer that drops its oldest rows, once a stream is over."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_r") <= most).drop("_r")


def last_mean(df: DataFrame, key: str, order: list[str], value: str, keep: float = 0.9) -> DataFrame:
    """``key`` and ``ema``: each key's exponential mean after its last value, which the first value other than 0 seeds;
    null values are left out. The share of a value in it falls with the values after it, so a number of the rows from
    the end and a sum do."""
    here = F.struct(*order)
    rows = df.filter(F.col(value).isNotNull())
    seed = F.min(F.when(F.col(value) != 0, here)).over(Window.partitionBy(key))
    after = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))) - 1
    rows = rows.withColumn("_seed", seed).withColumn("_after", after).filter((here >= F.col("_seed")) | F.col("_seed").isNull())
    share = F.pow(F.lit(keep), F.col("_after")) * F.when(here == F.col("_seed"), 1.0).otherwise(1 - keep)
    return rows.groupBy(key).agg(F.sum(F.col(value) * share).alias("ema"))


def buffer_events(df: DataFrame, key: str, order: str, item: str, size: int) -> DataFrame:
    """What happens in a finished stream's bounded buffer at each row: ``event``, the item ``dropped`` and the ``size``
    after it."""
    w = Window.partitionBy(key).orderBy(order)
    place = F.row_number().over(w)
    return df.withColumn("event", F.when(place <= size, "added").otherwise("dropped oldest")).withColumn("dropped", F.lag(item, size).over(w)).withColumn("size", F.least(F.lit(size), place).cast("long"))
