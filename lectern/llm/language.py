"""Language of web pages by Bayesian fusion of four kinds of evidence.

* The main text's likelihood under byte-trigram models of each language, counted over all labelled documents and
  tempered, since neighbouring trigrams are not independent.
* The language declared in the markup, by how often pages of each language (as their text says) declare it.
* The address suffix (top level domain), likewise.
* The host's prior: the mean of its other pages' text posteriors, smoothed towards its domain's, that towards all
  pages'. The page's own text is left out of every count, so it is used once.

All counts are grouped aggregations of posteriors; a host with a third of all pages is one row after map-side sums.

Edge cases: null or empty html has no text evidence, a null or broken url no host or suffix evidence (they count as
""); an unknown declared language is one more value; without labelled documents no language is known and no row's
language is (null); ties go to the language that sorts first; repeated rows count as pages of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.html_text import main_text_of, parse
from lectern.llm.storage import written
from lectern.llm.words import mix, parts

BUCKETS, TEMPER, STRENGTH = 8192, 0.2, 4.0
_LANG = re.compile(r"\s*([A-Za-z]+)")


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each byte trigram; ASCII letters in lower case, white space and digits alike."""
    low = data.astype(np.uint64)
    low = np.where((low >= 65) & (low <= 90), low + np.uint64(32), low)
    low = np.where((low < 65), np.uint64(32), low)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = low[:-2] | low[1:-1] << np.uint64(8) | low[2:] << np.uint64(16)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    same = doc[:-2] == doc[2:]
    return (mix(h[same]) % np.uint64(BUCKETS)).astype(np.int64), doc[:-2][same]


def _counts(langs: list[str]):
    place = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * BUCKETS, np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j, data, offs in parts(batch.column(0)):
                b, doc = trigrams(data, offs)
                total += np.bincount(lang[i:j][doc] * BUCKETS + b, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["place", "n"])

    return run


def text_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram log-probabilities, counted over all labelled documents."""
    own = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL")
    langs = sorted(r.lang for r in own.select("lang").distinct().collect())
    counts = np.full(len(langs) * BUCKETS, 0.5)
    if langs:
        for r in own.mapInArrow(_counts(langs), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r.place] += r.n
    table = counts.reshape(len(langs), BUCKETS)
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def address(url: str | None) -> tuple[str, str, str]:
    """Host, domain (last two labels) and suffix (last label) of an address."""
    try:
        host = (urlsplit(url or "").hostname or "").lower().strip(".")
    except ValueError:
        host = ""
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]), labels[-1] if labels else ""


def seen(page: str | None) -> tuple[str, str]:
    """Main text of a page and the language that its html element declares, wherever it stands."""
    if not page:
        return "", ""
    root = parse(page)
    m = _LANG.match(root.lang)
    return main_text_of(root), m[1].lower() if m else ""


def _evidence(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(table)
        for batch in batches:
            pages = [seen(x) for x in batch.column(2).to_pylist()]
            ll = np.zeros((len(pages), k))
            for i, j, data, offs in parts(pa.array([x[0] for x in pages], pa.large_string())):
                b, doc = trigrams(data, offs)
                for x in range(k):
                    ll[i:j, x] = TEMPER * np.bincount(doc, table[x][b], j - i)
            ll -= ll.max(1, keepdims=True)
            post = np.exp(ll) / np.exp(ll).sum(1, keepdims=True)
            where = [address(u) for u in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array([w[0] for w in where]), pa.array([w[1] for w in where]), pa.array([w[2] for w in where]), pa.array([x[1] for x in pages], pa.string()), pa.array(ll.tolist(), pa.list_(pa.float64())), pa.array(post.tolist(), pa.list_(pa.float64()))],
                ["page_id", "host", "domain", "suffix", "declared", "ll", "post"],
            )

    return run


def identified(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", strength: float = STRENGTH) -> DataFrame:
    """page_id, lang, probability, text_lang (by the text alone), declared, host for every page."""
    langs, table = text_models(docs)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    if not langs:
        none = F.lit(None).cast("string")
        return base.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    rows = written(base.mapInArrow(_evidence(table), "page_id long, host string, domain string, suffix string, declared string, ll array<double>, post array<double>"), "evidence")
    k = len(langs)

    def sums(*keys: str, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array(*(F.sum(F.col("post")[x]) for x in range(k))).alias(name))

    out = rows
    for key in ("host", "domain", "suffix", "declared"):
        out = out.join(sums(key, name=f"by_{key}"), key)
    total = rows.agg(F.array(*(F.coalesce(F.sum(F.col("post")[x]), F.lit(0.0)) for x in range(k))).alias("all_"))
    everything = F.lit(np.array(total.first()[0], float).tolist()).cast("array<double>")
    values = {key: rows.select(key).distinct().count() for key in ("suffix", "declared")}
    scores = []
    for x in range(k):
        own, rest = F.col("post")[x], F.lit(0.0)
        count = lambda c: F.greatest(c[x] - own, F.lit(0.0))  # noqa: E731, B023
        size = lambda c: F.greatest(F.aggregate(c, rest, lambda a, b: a + b) - 1, rest)  # noqa: E731, B023
        overall = (count(everything) + 1) / (size(everything) + k)
        domain = (count(F.col("by_domain")) + strength * overall) / (size(F.col("by_domain")) + strength)
        host = (count(F.col("by_host")) + strength * domain) / (size(F.col("by_host")) + strength)
        of = lambda key: (count(F.col(f"by_{key}")) + 1) / (count(everything) + values[key] + 1)  # noqa: E731, B023
        scores.append(F.col("ll")[x] + F.log(host) + F.log(of("suffix")) + F.log(of("declared")))
    out = out.withColumn("score", F.array(*scores)).withColumn("most", F.array_max("score")).withColumn("post_text", F.array_max("post"))
    names = F.array(*(F.lit(x) for x in langs))
    at = lambda c, m: F.element_at(names, F.array_position(c, m).cast("int"))
    return out.select(
        "page_id", at(F.col("score"), F.col("most")).alias("lang"), (1 / F.aggregate("score", F.lit(0.0), lambda a, b: a + F.exp(b - F.col("most")))).alias("probability"),
        at(F.col("post"), F.col("post_text")).alias("text_lang"), "declared", "host",
    )


def op7_language(spark, sf_dir: str) -> DataFrame:
    pages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    return identified(pages, docs)
