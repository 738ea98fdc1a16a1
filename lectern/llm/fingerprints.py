"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (text between line feeds) is hashed to a vector of lanes; a document's fingerprint is the sum of its
paragraphs' vectors modulo 2**16 (2**32 for the lanes of the second part). So the order of paragraphs doesn't matter, and inserting or deleting one is
an addition or subtraction (``add``, ``remove``), without the rest of the text.

A vector has two parts. The first ``EQUAL`` lanes are uniform bits of the whole paragraph (SHAKE128): they decide
equality. The last ``LIKE`` lanes are the paragraph's signed word-triple counts (each triple adds or takes one in one
lane): these sums of 32 bits don't wrap below 2**31 triples, so the distance of two fingerprints estimates how many
triples two texts don't share.

Edge cases: null and empty texts are one empty paragraph; rows with equal ids are ordered by text, then arbitrarily;
a null id comes first; with one row, the next document is the row itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.storage import framed
from lectern.llm.words import Grams, utf8, words

EQUAL, LIKE, TRIPLE = 128, 256, 3
LANES = EQUAL + LIKE
#: Characters of texts fingerprinted together.
_TOGETHER = 1 << 19


def _likeness_lanes(paragraphs: list[str], owner: np.ndarray, n: int) -> np.ndarray:
    data, offs = utf8(pa.array(paragraphs, pa.large_string()))
    w = words(data, offs, "space", False)
    size = np.diff(w.first)
    runs = np.where(size > 0, np.maximum(size - TRIPLE + 1, 1), 0)
    total = int(runs.sum())
    at = np.arange(total) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(w.first[:-1], runs)
    h = Grams(w).at(at, np.repeat(np.minimum(size, TRIPLE), runs))
    cell = np.repeat(owner, runs) * LIKE + (h % np.uint64(LIKE)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    return np.bincount(cell, sign, n * LIKE).reshape(n, LIKE).astype(np.int64).astype(np.uint32)


def vectors(texts: list[str | None]) -> np.ndarray:
    """Fingerprints of some texts, a row of lanes each; of the first ``EQUAL`` lanes 16 bits are in use."""
    out = np.zeros((len(texts), LANES), np.uint32)
    paragraphs, owner = [], []
    for k, text in enumerate(texts):
        own = (text or "").split("\n")
        paragraphs += own
        owner += [k] * len(own)
        raw = b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(2 * EQUAL) for p in own)
        out[k, :EQUAL] = np.frombuffer(raw, "<u2").reshape(len(own), EQUAL).sum(0, dtype=np.uint16)
    out[:, EQUAL:] = _likeness_lanes(paragraphs, np.array(owner), len(texts))
    return out


def _reduced(v: np.ndarray) -> np.ndarray:
    v[:EQUAL] &= np.uint32(0xFFFF)
    return v


def add(fingerprint: np.ndarray, paragraphs: list[str]) -> np.ndarray:
    """The fingerprint with paragraphs inserted."""
    return _reduced(fingerprint + vectors(["\n".join(paragraphs)])[0]) if paragraphs else fingerprint.copy()


def remove(fingerprint: np.ndarray, paragraphs: list[str]) -> np.ndarray:
    """The fingerprint with paragraphs deleted."""
    return _reduced(fingerprint - vectors(["\n".join(paragraphs)])[0]) if paragraphs else fingerprint.copy()


def hexed(v: np.ndarray) -> str:
    return (v[:EQUAL].astype("<u2").tobytes() + v[EQUAL:].astype("<u4").tobytes()).hex()


def parsed(text: str) -> np.ndarray:
    raw = bytes.fromhex(text)
    return np.concatenate((np.frombuffer(raw[: 2 * EQUAL], "<u2"), np.frombuffer(raw[2 * EQUAL :], "<u4"))).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share (0 to 1) of word triples that two texts have in common, from their fingerprints, row by row."""
    x, y = (np.ascontiguousarray(v[:, EQUAL:]).view(np.int32).astype(np.float64) for v in (a, b))
    norm = (x * x).sum(1) + (y * y).sum(1)
    near = 1 - ((x - y) ** 2).sum(1) / np.maximum(norm, 1)
    near = np.where(norm > 0, np.clip(near, 0, 1), 0)
    return np.where((a == b).all(1), 1.0, near)


def next_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, next: each document with the following one's text in ascending order of ids, the last with the
    first's. Ranges of ids are ordered on their own; the first row of each range is also sent to the range before it,
    so no task holds more than a range."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = min(20_000, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = np.unique(np.array(base.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges), np.float64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.to_numpy(np.float64, na_value=0.0), "right")).astype(np.int32))

    placed = base.withColumn("part", place("doc_id"))
    heads = sorted(tuple(r) for r in base.select("doc_id").withColumn("part", place("doc_id")).groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63))))).collect())
    if not heads:
        return base.withColumn("next", F.col("text"))
    before = [(part, least, heads[k - 1][0]) for k, (part, least) in enumerate(heads)]
    heads_df = spark.createDataFrame(before, "part int, least long, before int")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    wrap = F.col("before") >= F.col("part")
    placed = placed.join(F.broadcast(heads_df), "part")
    placed = placed.select("doc_id", "text", F.explode(F.when(key == F.col("least"), F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("extra"))))).alias("p"), wrap.alias("wrap"))
    order = Window.partitionBy("p.part").orderBy(F.col("p.extra"), F.col("doc_id").asc_nulls_first(), "text")
    return placed.withColumn("next", F.lead("text").over(order)).filter("NOT p.extra").select("doc_id", "text", "next")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, follow = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < _TOGETHER):
                size += len(texts[j])
                j += 1
            own = texts[i:j]
            changed = [edited(t, f) for t, f in zip(own, follow[i:j], strict=True)]
            # the next text is mostly the next row's own
            after, place = [], []
            for k in range(i, j):
                if k + 1 < j and texts[k + 1] == follow[k]:
                    place.append(k + 1 - i)
                else:
                    place.append(len(own) + len(after))
                    after.append(follow[k])
            v = vectors(own + after)
            e = vectors(changed)
            a, n = v[: len(own)], v[np.array(place)]
            yield pa.record_batch(
                [ids.slice(i, j - i), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]), pa.array([hexed(x) for x in a]), pa.array([hexed(x) for x in e]), pa.array(likeness(a, e)), pa.array(likeness(a, n))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            i = j


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike the fingerprints are."""
    return next_documents(docs, id_col, text_col).mapInArrow(_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns) and its fingerprint in hexadecimal digits."""
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            yield pa.record_batch([row, pa.array([hexed(vectors([t])[0]) for t in row.field(text).to_pylist()], pa.string())], ["row", "fingerprint"])

    frame, schema = framed(docs, "fingerprint string")
    return frame.mapInArrow(run, schema)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
