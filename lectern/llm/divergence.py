"""Source divergence audit: how far the term distributions of a language's sources lie apart.

1. Sketch: every task counts the documents of each (language, term) in a count-min sketch whose counters stop at the
   threshold; pages of the tasks' sketches are added up by page. A counter never underestimates, so a term one of whose
   counters stays below the threshold can't be kept. Only the answer, a bit for each counter, is broadcast: its size is
   ``width`` / 4 bytes, which grows with the number of documents up to ``WIDEST`` (32 MB); past that more terms pass.
2. Counting: a second pass puts out (language, source, term, occurrences, documents) of the terms that pass, summed up
   in each task before they are shuffled; sums over sources decide exactly which terms are kept.
3. Pairs: with b the value of a term that a source doesn't have, a pair's sum is  V * |b_g - b_h|  plus what the terms of
   either source alone add to that, which only needs a source's histogram of values, plus what the terms of both add,
   which is a sparse join on (language, term): a key has one row for each source at the most.

Shares are whole numbers, taken with decimals of 38 digits, so counts beyond 10^9 don't overflow. A source with a third
of all documents is no hot key anywhere: its rows are summed before they move.

Edge cases: null texts, languages and sources are empty strings; a group without terms is a group; a language without
kept terms has pairs of value 0 and no terms; repeated rows are documents of their own; an empty table gives an empty
result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.storage import scratch, written
from lectern.llm.words import mix, parts, words

#: Documents that a kept term is in, at least; and the ranks that terms are listed to.
LEAST, RANKS = 30, 50
#: Counters of a row of the sketch for each document, bounds of a row's width, rows, and counters of a page.
EACH, NARROWEST, WIDEST, DEPTH, PAGE = 16, 1 << 16, 1 << 27, 2, 1 << 15
#: Bytes of text handled at once, and rows that a task sums up before it hands them on.
SLICE, HELD = 1 << 20, 400_000


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _places(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """Where each row of the sketch counts the keys."""
    low = np.uint64(width - 1)
    return [((keys >> np.uint64(32 * k)) & low).astype(np.int64) for k in range(DEPTH)]


def _groups(*columns) -> tuple[np.ndarray, list[tuple]]:
    """Each row's number of its values, and the values of each number."""
    number: dict[tuple, int] = {}
    rows = [number.setdefault(r, len(number)) for r in zip(*(c.to_pylist() for c in columns), strict=True)]
    return np.array(rows, np.int64), list(number)


def _met(w, doc_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a slice's words, and for each distinct (word, text) the word's number, the text and the count."""
    hashes, inverse = np.unique(w.hash, return_inverse=True)
    codes, counts = np.unique(inverse * n + doc_of, return_counts=True)
    return hashes, codes // n, codes % n, counts


def _sketched(width: int, least: int):
    """Pages of a task's sketch, counters of which stop at ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            lang, names = _groups(batch.column(1))
            salts = np.array([_salt(x) for (x,) in names], np.uint64)
            for i, j, data, offs in parts(batch.column(0), SLICE):
                w = words(data, offs, "letters")
                hashes, word, doc, _ = _met(w, w.doc, j - i)
                pairs, docs = np.unique(word * len(names) + lang[i + doc], return_counts=True)
                for row, place in zip(sketch, _places(mix(hashes[pairs // len(names)] ^ salts[pairs % len(names)]), width), strict=True):
                    at, back = np.unique(place, return_inverse=True)
                    row[at] = np.minimum(row[at] + np.bincount(back, docs, len(at)), least)
        for k in range(0, DEPTH * width, PAGE):
            page = sketch.reshape(-1)[k : k + PAGE]
            if page.any():
                some = np.flatnonzero(page)
                yield pa.record_batch([pa.array([k // PAGE], pa.int32()), pa.array([some.astype(np.uint16).tobytes()], pa.binary()), pa.array([page[some].tobytes()], pa.binary())], ["page", "places", "counts"])

    return run


def _reached(least: int):
    """For each page a bit for each counter that comes to ``least`` over all tasks. Rows are sorted by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done():
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["page", "bits"])

        for batch in batches:
            for page, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page != now:
                    if now is not None:
                        yield done()
                    now, total = page, np.zeros(PAGE, np.uint16)
                places = np.frombuffer(places, np.uint16)
                total[places] = np.minimum(total[places] + np.frombuffer(counts, np.uint8), least)
        if now is not None:
            yield done()

    return run


def _possible(texts: DataFrame, width: int, least: int) -> np.ndarray:
    """The merged sketch's answer: a row of bits for each of its rows."""
    if least > 255:
        raise ValueError("a counter has one byte, so a term is kept from 255 documents on at most")
    pages = texts.mapInArrow(_sketched(width, least), "page int, places binary, counts binary")
    bits = written(pages.repartition("page").sortWithinPartitions("page").mapInArrow(_reached(least), "page int, bits binary"), "sketch")
    out = np.zeros(DEPTH * width // 8, np.uint8)
    for r in bits.toLocalIterator():
        out[r.page * PAGE // 8 : (r.page + 1) * PAGE // 8] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(DEPTH, -1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang, source, term with the sums of n and docs of each ``HELD`` rows or so."""
    held: list[pa.RecordBatch] = []

    def sums() -> Iterator[pa.RecordBatch]:
        out = pa.Table.from_batches(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        yield from out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"]).to_batches(20_000)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= HELD:
            yield from sums()
            held = []
    if held:
        yield from sums()


def _counted(bits: np.ndarray):
    """lang, source, term, n, docs of the terms that pass the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(slices(batches))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits.shape[1] * 8
        for batch in batches:
            group, names = _groups(batch.column(1), batch.column(2))
            salts = np.array([_salt(x) for x, _ in names], np.uint64)
            for i, j, data, offs in parts(batch.column(0), SLICE):
                w = words(data, offs, "letters", True, True)
                doc = w.doc
                hashes, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
                if (w.second[first][inverse] != w.second).any():
                    # two words of one hash: their second hashes tell them apart
                    _, first, inverse = np.unique(w.hash + mix(w.second), return_index=True, return_inverse=True)
                    hashes = w.hash[first]
                codes, n = np.unique(inverse * (j - i) + doc, return_counts=True)
                pairs, back, docs = np.unique(codes // (j - i) * len(names) + group[i + codes % (j - i)], return_inverse=True, return_counts=True)
                n = np.bincount(back, n, len(pairs)).astype(np.int64)
                word, own = pairs // len(names), pairs % len(names)
                ok = np.ones(len(pairs), bool)
                for row, place in zip(bits, _places(mix(hashes[word] ^ salts[own]), width), strict=True):
                    ok &= (row[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                if not ok.any():
                    continue
                word, own, n, docs = word[ok], own[ok], n[ok], docs[ok]
                used, at = np.unique(word, return_inverse=True)
                terms = pa.array([data[w.start[k] : w.end[k]].tobytes().lower().decode() for k in first[used]], pa.string())
                lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(own)) for k in (0, 1))
                yield pa.record_batch([lang, source, terms.take(pa.array(at)), pa.array(n), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    return run


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, width: int | None = None) -> DataFrame:
    """lang, source, term, n (occurrences) of every term that at least ``least`` documents of the language have."""
    texts = docs.select(F.coalesce(docs[text], F.lit("")).alias("text"), *(F.coalesce(docs[c], F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))))
    if width is None:
        width = 1 << int(np.clip(texts.count() * EACH, NARROWEST, WIDEST) - 1).bit_length()
    bits = _possible(texts.select("text", "lang"), width, least)
    each = texts.mapInArrow(_counted(bits), "lang string, source string, term string, n long, docs long")
    sums = written(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term")
    return sums.join(kept, ["lang", "term"]).select("lang", "source", "term", "n")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * terms))."""
    over, under = (10**9 * (n.cast("decimal(18,0)") + 5)).cast("decimal(29,0)"), (total + 5 * terms).cast("decimal(20,0)")
    return F.call_function("div", over, under) + 1


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: of every group its language's other sources by distance (``pair``), and the
    terms that it has oftener than the language has (``term``)."""
    with scratch() as keep:
        counts = written(term_counts(docs, text, lang, source, least), "kept")
        terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
        langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
        totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select(F.coalesce(docs[lang], F.lit("")).alias("lang"), F.coalesce(docs[source], F.lit("")).alias("source")).distinct()
        groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "all"])
        # b: the share of a term that the group doesn't have
        groups = written(groups.withColumn("b", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)), "groups")
        own = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
        own = written(own.select("lang", "source", "term", "n", "p", "b", "v", "all"), "shares")

        a, b = groups.select("lang", "source", "b", "v"), groups.select("lang", F.col("source").alias("item"), F.col("b").alias("b2"))
        pairs = a.join(b, "lang").filter("source <> item")
        level = F.abs(F.col("b") - F.col("b2"))
        # what a source's own terms add to V * level, from its histogram of shares
        values = own.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
        alone = values.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("b2")) - level)).alias("alone"))
        # what terms of both add: each pair once, the lesser source first
        here, there = own.select("lang", "term", "source", "p", "b"), own.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("b").alias("b2"))
        more = F.abs(F.col("p") - F.col("p2")) - F.abs(F.col("p") - F.col("b2")) - F.abs(F.col("p2") - F.col("b")) + level
        both = here.join(there, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(more).alias("both"))
        turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("turned"))
        both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both"))
        key = ["lang", "source", "item"]
        sums = pairs.join(alone, key, "left").join(turned, key, "left").join(both, key, "left").na.fill(0, ["alone", "turned", "both"])
        rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        distance = sums.select(*key, (F.col("v") * level + F.col("alone") + F.col("turned") + F.col("both")).alias("value"))
        distance = distance.withColumn("rank", rank())

        q = terms.join(langs, "lang").select("lang", "term", share(F.col("n"), F.col("all"), F.col("v")).alias("q"))
        over = own.join(q, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        over = over.withColumn("rank", rank()).filter(F.col("rank") <= ranks)
        out = distance.withColumn("part", F.lit("pair")).unionByName(over.withColumn("part", F.lit("term")))
        return keep(written(out.select("lang", "source", "part", "item", "value", "rank"), "divergence"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents, with the contract's threshold and ranks."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM kept JOIN langs USING (lang)),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_counts AS (SELECT lang, source, term, coalesce(c.n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM full_counts GROUP BY lang, source),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM full_counts JOIN totals USING (lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
