"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``window`` consecutive words (a shorter item is one window). A window is treated as
a set of shingles that a document must contain whole, so by the prefix principle a match needs the window's first
shingle in any fixed order. The order is rarity in the corpus.

1. Windows and their shingles are a table; equal windows of several items are one row.
2. One pass over the documents puts out where shingles of items may occur: those that pass a bitmap of all items'
   shingles (2 MB, whatever the benchmark). Counted by shingle, they give the rarity.
3. Each window is joined on its rarest shingle only; a window with a shingle that no document has is gone before that.
   An occurrence fixes where the window would start (positional bound) and end in the document (length bound).
4. Candidates go back to their documents, and the words there are compared by two independent hashes of the whole run,
   128 bits. Documents without candidates don't move.

Documents are told apart by a hash of the text: equal texts have equal hits, and where two texts have one hash, the
comparison sorts their candidates out.

Edge cases: a null or empty text has no words and is never contaminated; a null or empty item has no windows; items
with the same text all count; repeated rows each get their own result; other columns travel in ``row`` untouched, so
their names can't clash; an item without an id removes words but is not listed; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import BITS, framed, perhaps_in, written
from lectern.llm.words import Grams, parts, starts, words

WINDOW, SHINGLE = 13, 5


def _windows(window: int):
    """A row for each window of each item: size, hashes, the item, and the hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in parts(batch.column(1)):
                w = words(data, offs, "alnum", True, True)
                one, two, n = Grams(w), Grams(w, 1), np.diff(w.first)
                size = np.minimum(n, window)
                count = np.where(n > 0, n - size + 1, 0)
                item = np.repeat(np.arange(j - i), count)
                at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.first[:-1], count)
                q = np.minimum(size, SHINGLE)[item]
                each = size[item] - q + 1
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(at, each)
                shingles = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))), pa.int32()), pa.array(one.at(place, np.repeat(q, each)).view(np.int64)))
                cols = [pa.array(size[item], pa.int32()), one.at(at, size[item]).view(np.int64), two.at(at, size[item]).view(np.int64), batch.column(0).slice(i, j - i).take(pa.array(item)), shingles]
                yield pa.record_batch(cols, ["size", "one", "two", "item", "shingles"])

    return run


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """Bits of the shingles' hashes, packed: 2 MB."""
    h = F.pmod("shingle", F.lit(BITS))
    pages = shingles.select((h / 32768).cast("long").alias("page"), (h % 32768).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in pages.toLocalIterator():
        out[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _hits(bits: np.ndarray, sizes: list[int]):
    """Where shingles that pass the bitmap occur: a row for each different one of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(1).to_numpy()
            for i, _, data, offs in parts(batch.column(0)):
                w = words(data, offs, "alnum", True)
                grams, n = Grams(w), np.diff(w.first)
                for q in sizes:
                    at, _ = starts(w.first, q)
                    h = grams.at(at, q).view(np.int64)
                    low = h & np.int64(BITS - 1)
                    some = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                    if not len(some):
                        continue
                    h, at = h[some], at[some]
                    doc = np.searchsorted(w.first, at, "right") - 1
                    order = np.lexsort((at, h, doc))
                    h, at, doc = h[order], at[order], doc[order]
                    begin = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
                    pos = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), pa.array((at - w.first[doc]).astype(np.int32)))
                    yield pa.record_batch([key[i + doc[begin]], h[begin], pos, n[doc[begin]].astype(np.int32)], ["key", "shingle", "pos", "n"])

    return run


_MATCHES = "n_words long, hit_from array<int>, hit_to array<int>, items array<string>"


def _verified(text: int):
    """Of a document's candidates those whose words are the window's, as disjoint runs, and their items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, marks = batch.column(0), batch.column(1)
            n_words, out_from, out_to, items = [], [], [], []
            for i, j, data, offs in parts(row.field(text)):
                own = marks.slice(i, j - i)
                some = own.null_count < len(own)
                w = words(data, offs, "alnum", True, some)
                n = np.diff(w.first)
                n_words.extend(n.tolist())
                ok = ()
                if some:
                    flat = own.flatten()
                    doc = np.repeat(np.arange(j - i), own.value_lengths().fill_null(0).to_numpy())
                    begin, size, one, two = (flat.field(c).to_numpy() for c in range(4))
                    fits = begin + size <= n[doc]
                    at = np.where(fits, w.first[doc] + begin, 0)
                    size_ = np.where(fits, size, 0)
                    same = fits & (Grams(w).at(at, size_).view(np.int64) == one) & (Grams(w, 1).at(at, size_).view(np.int64) == two)
                    ok = np.flatnonzero(same)
                found: list[list] = [[] for _ in range(j - i)]
                for k in ok:
                    found[doc[k]].append((int(begin[k]), int(begin[k] + size[k]), flat.field(4)[int(k)].as_py()))
                for own_hits in found:
                    a, b, ids = [], [], set()
                    for s, e, these in sorted(own_hits, key=lambda x: x[:2]):
                        ids.update(these)
                        if b and s <= b[-1]:
                            b[-1] = max(b[-1], e)
                        else:
                            a.append(s)
                            b.append(e)
                    out_from.append(a)
                    out_to.append(b)
                    items.append(sorted(ids))
            yield pa.record_batch([row, pa.array(n_words, pa.int64()), pa.array(out_from, pa.list_(pa.int32())), pa.array(out_to, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "hit_from", "hit_to", "items"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``row`` (all columns of a document), n_words, hit_from/hit_to (disjoint runs of word positions inside
    occurrences of windows) and items (ids as text, sorted), one row a document."""
    text = docs.columns.index(text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    windows = items.mapInArrow(_windows(window), "size int, one long, two long, item string, shingles array<long>")
    windows = written(windows.groupBy("size", "one", "two").agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("shingles").alias("shingles")), "windows")
    each = windows.select("size", "one", "two", F.posexplode("shingles").alias("offset", "shingle"))
    sizes = sorted(r.q for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("q")).distinct().collect())

    key = F.xxhash64(docs[text_col])
    hits = written(docs.select(docs[text_col].alias("text"), key.alias("key")).mapInArrow(_hits(_bitmap(each), sizes), "key long, shingle long, pos array<int>, n int"), "hits")
    counts = hits.groupBy("shingle").agg(F.sum(F.size("pos")).alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset")
    rarest = each.join(counts, "shingle", "left").groupBy("size", "one", "two").agg(F.min(F.struct(rarity.alias("by"), "shingle")).alias("best")).filter("best.by.n > 0")
    rarest = written(rarest.join(windows.drop("shingles"), ["size", "one", "two"]).select("best.shingle", F.col("best.by.offset").alias("offset"), "size", "one", "two", "items"), "rarest")
    begin = F.col("at") - F.col("offset")
    met = hits.join(rarest, "shingle").select("key", "n", F.explode("pos").alias("at"), "offset", "size", "one", "two", "items").filter((begin >= 0) & (begin + F.col("size") <= F.col("n")))
    marks = written(met.groupBy("key").agg(F.collect_set(F.struct(begin.alias("begin"), "size", "one", "two", "items")).alias("marks")), "marks")

    frame, schema = framed(docs, _MATCHES)
    frame = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    flagged = perhaps_in(frame, marks, "key")
    plain = flagged.filter("NOT met").select("row", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"))
    every = flagged.filter("met").join(marks, "key", "left").select("row", "marks").unionByName(plain)
    return every.mapInArrow(_verified(text), schema)


def n_hit():
    """Words inside hits."""
    return F.coalesce(F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long")


def contaminated(per_share: int = 20):
    """At least one word is hit, and at least one of ``per_share``."""
    return (n_hit() > 0) & (per_share * n_hit() >= F.col("n_words"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """A row a document: its words, those inside windows of items, the items, and whether it counts as contaminated. Null
    and empty texts have no words."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs.select("doc_id", "text"), items).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT item_id, least(13, len(w)) AS size, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS run
  FROM item_words, unnest(generate_series(1, greatest(1, len(w) - 12))) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
doc_runs AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS run
  FROM doc_words, sizes, unnest(generate_series(1, len(w) - size + 1)) AS t(p)),
hits AS (SELECT doc_id, p, d.size, item_id FROM doc_runs d JOIN windows i ON d.size = i.size AND d.run = i.run),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hits, unnest(generate_series(0, size - 1)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
