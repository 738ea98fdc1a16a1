"""Quality classifier by positive-unlabelled learning.

Positives are documents trusted as good, the rest of the text is unlabelled: a mix of good and bad. The classifier is
linear in the standardised features and a fixed set of random tanh features of them, and minimises the non-negative
unbiased risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))  with squared loss. That risk
depends on the rows through their first and second moments alone, so it is taken over all unlabelled rows in one pass,
whatever their number, and minimised on the driver: by its closed form where the second term is not negative, else by
gradient steps that reverse the second term's gradient.

The class prior is estimated from positives and unlabelled rows: a classifier of one half of the positives against the
unlabelled rows ranks these and the other half, and of all thresholds that one is taken at which the share of unlabelled
rows above it over the share of positives above it is least, with a margin for small shares; that least ratio is the prior.

A logistic curve turns the output into a score. It too comes without negatives: the mean output of bad texts is what the
unlabelled mean leaves once the positives' part, by the prior, is taken off, and midway between the two means the score is
one half. Labels of bad texts are never read. Inputs are shares of bytes, words and lines of the text alone. Trusted
positives are a bounded sample (``labelled`` rows, in the order of a hash of the id); unlabelled rows are all those of the
training folds; every document is scored.

Edge cases: null and empty texts get the features of an empty text and so a score; a null id is not held out; rows
without a label, or with null labels, are unlabelled; repeated rows count as often as they occur, score alike, and
nothing but sums reaches the driver; without positives or without any row every score is 0.5; other columns travel in
``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import framed, scratch, written
from lectern.llm.sums import tree_sum
from lectern.llm.words import parts, words

#: Most rows sampled as trusted positives.
LABELLED = 20_000
#: Random features, the weight of the ridge (a constant, and a part for each weight a positive row), and bins of outputs
#: (between -SPAN and SPAN).
RANDOM, RIDGE, EACH, BINS, SPAN = 160, 1e-3, 0.5, 4096, 4.0

_BYTES = 96
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!\"#$%&()*+/:;<=>@[\\]^_`{|}~"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
N_FEATURES = _BYTES + 18


def _per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the most frequent one, of each text."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(h))))
    return np.bincount(doc[at], minlength=n).astype(float), most


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of numbers for each text, of no dependence on its length but through logarithms."""
    n, size = len(offs) - 1, np.maximum(np.diff(offs), 1).astype(float)
    doc = np.repeat(np.arange(n), np.diff(offs))
    group = np.where(data >= 128, 95, np.where(data < 32, 0, data - 32)).astype(np.int64)
    shares = np.sqrt(np.bincount(doc * _BYTES + group, minlength=n * _BYTES).reshape(n, _BYTES) / size[:, None])
    w = words(data, offs, "space", False)
    lower = words(data, offs, "space", True)
    count = np.maximum(np.diff(w.first), 1).astype(float)
    length = (w.end - w.start).astype(float)
    wide = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    symbols, uppers = wide(_SYMBOL[data]), wide(_UPPER[data])
    in_symbols, in_uppers = symbols[w.end] - symbols[w.start], uppers[w.end] - uppers[w.start]
    mean = _per(length, w.first) / count
    distinct, most = _distinct(lower.hash, lower.first)
    # lines are the words between line feeds
    breaks = np.flatnonzero(data == 10)
    text_of = np.searchsorted(offs, breaks, "right") - 1
    lines = np.bincount(text_of, minlength=n) + 1.0
    edges = np.unique(np.concatenate((offs, breaks + 1)))
    line = words(data, edges, "space", True)
    sums = np.zeros(len(line.hash) + 1, np.uint64)
    np.cumsum(line.hash, out=sums[1:])
    value = sums[line.first[1:]] - sums[line.first[:-1]]
    first = np.searchsorted(edges[:-1], offs)
    first[-1] = len(edges) - 1
    distinct_lines, _ = _distinct(value, first)
    n_lines = np.maximum(np.diff(first), 1).astype(float)
    pair = lower.hash[:-1] * np.uint64(3) + lower.hash[1:] if len(lower.hash) else lower.hash
    inner = np.ones(len(pair), bool)
    cut = lower.first[1:-1] - 1
    inner[cut[(cut >= 0) & (cut < len(pair))]] = False
    kept = np.concatenate(([0], np.cumsum(inner)))
    pair_first = kept[np.minimum(lower.first, len(pair))]
    distinct_pairs, most_pairs = _distinct(pair[inner], pair_first)
    n_pairs = np.maximum(np.diff(pair_first), 1).astype(float)
    more = [
        np.log1p(np.diff(offs)) / 10, np.log1p(np.diff(w.first)) / 10, mean / 10, np.sqrt(np.maximum(_per(length**2, w.first) / count - mean**2, 0)) / 10,
        distinct / count, most / count, distinct / count * np.log1p(count) / 10, np.log1p(lines) / 10, distinct_lines / n_lines, np.log1p(count / lines) / 10,
        _per(in_symbols > 0, w.first) / count, _per(in_symbols == length, w.first) / count, _per(in_uppers > 1, w.first) / count, _per(in_uppers == 1, w.first) / count, _per(length == 1, w.first) / count,
        distinct_pairs / n_pairs, most_pairs / n_pairs, (np.diff(w.first) == 0).astype(float),
    ]
    return np.column_stack((shares, *more)).astype(np.float32)


@dataclass
class Model:
    """Weights of the features and of random features of them, and the curve from the output to a score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def output(self, x: np.ndarray) -> np.ndarray:
        return expanded(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.output(x) + self.shift)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> np.ndarray:
    """A constant, the standardised features, and the random features of rows."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    turn, shift = rng.normal(0, (2 / d) ** 0.5, (d, RANDOM)), rng.normal(0, 0.5, RANDOM)
    x = np.clip((x.astype(np.float64) - mean) / scale, -8, 8)
    return np.concatenate((np.ones((len(x), 1)), x, np.tanh(x @ turn + shift)), axis=1)


@dataclass
class Moments:
    """Number, sum and sum of outer products of the expanded rows of one kind."""

    n: float
    first: np.ndarray
    second: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        return Moments(float(len(rows)), rows.sum(0), rows.T @ rows)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.first + other.first, self.second + other.second)

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        return self.first / max(self.n, 1), self.second / max(self.n, 1)


def _ridge(positive: Moments) -> np.ndarray:
    d = len(positive.first)
    return (RIDGE + EACH * d / max(positive.n, 1)) * np.eye(d)


def against(positive: Moments, unlabelled: Moments) -> np.ndarray:
    """Weights of least squares that tell positives from unlabelled rows."""
    (mp, cp), (mu, cu) = positive.means(), unlabelled.means()
    return np.linalg.solve(cp + cu + _ridge(positive), mp - mu)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from counts of both by bins of an output, lowest first."""
    p, u = positive[::-1].cumsum(), unlabelled[::-1].cumsum()
    some = p > 0
    over_p, over_u = p[some] / p[-1], u[some] / max(u[-1], 1)
    margin = sum((np.log(4 / confidence) / (2 * max(n, 1))) ** 0.5 for n in (p[-1], u[-1]))
    best = np.argmin((over_u + 1.01 * margin) / over_p)
    return float(np.clip(over_u[best] / over_p[best], 0.01, 0.99))


def risk(w: np.ndarray, prior: float, positive: Moments, unlabelled: Moments) -> tuple[float, float]:
    """The two terms of the risk: of positives, and of negatives (which may be below zero)."""
    (mp, cp), (mu, cu) = positive.means(), unlabelled.means()
    square = lambda c, m, sign: 1 + sign * 2 * w @ m + w @ c @ w
    return prior * square(cp, mp, -1), square(cu, mu, 1) - prior * square(cp, mp, 1)


def fit(positive: Moments, unlabelled: Moments, prior: float, steps: int = 500) -> np.ndarray:
    """Weights of least non-negative risk."""
    (mp, cp), (mu, cu) = positive.means(), unlabelled.means()
    eye = _ridge(positive)
    w = np.linalg.solve(cu + eye, 2 * prior * mp - mu)
    if risk(w, prior, positive, unlabelled)[1] >= 0:
        return w
    best, least = w, np.inf
    rate = 0.25 / np.linalg.eigvalsh(cu + cp + eye)[-1]
    for _ in range(steps):
        plus, minus = risk(w, prior, positive, unlabelled)
        if plus + max(0.0, minus) < least:
            best, least = w, plus + max(0.0, minus)
        down = 2 * (mu + cu @ w) - prior * 2 * (mp + cp @ w)
        w = w - rate * (prior * 2 * (cp @ w - mp) + down + 2 * eye @ w if minus >= 0 else -down)
    return best


def curve(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve from outputs given as counts by bins: one half midway between the mean of
    positives and that of negatives, which is what the unlabelled mean leaves once the positives' part is taken off."""
    at = (np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN
    good = (positive * at).sum() / max(positive.sum(), 1)
    bad = ((unlabelled * at).sum() / max(unlabelled.sum(), 1) - prior * good) / (1 - prior)
    half = max(good - bad, 0.2) / 2
    slope = 4 / half
    return float(slope), float(-slope * (good - half))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in parts(batch.column(0)):
            f = features(data, offs)
            yield pa.record_batch([pa.array([x.tobytes() for x in f], pa.binary()), batch.column(1).slice(i, j - i)], ["x", "label"])


#: Rows that a task handles at once.
ROWS = 2000


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all rows (features and labels) of vectors of a fixed size that ``add`` makes of some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                x = np.frombuffer(b"".join(batch.column(0).slice(k, ROWS).to_pylist()), np.float32).reshape(-1, N_FEATURES)
                own = add(x, batch.column(1).slice(k, ROWS).fill_null(-1).to_numpy(zero_copy_only=False))
                total = own.astype(np.float64) if total is None else np.add(total, own, out=total)
        return total

    return tree_sum(rows, size, run)


def _moments(total: np.ndarray, d: int) -> Moments:
    upper, second = np.triu_indices(d), np.zeros((d, d))
    second[upper] = total[1 + d :]
    return Moments(total[0], total[1 : 1 + d], second + np.triu(second, 1).T)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """Fit on at most ``labelled`` labels and on the texts of all rows outside the held-out fold, which is never read.
    The features are written once (460 bytes a row) and passed over four times; each pass sends sums of a fixed size."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL").filter(~held_out("id")).dropDuplicates(["id"])
    # trusted positives have label 1 or, the half that the prior is counted on, 2; other labels aren't looked at
    own = own.filter("label = 1").select("id", F.when(F.xxhash64("id", F.lit(1)) % 2 == 0, 2).otherwise(1).alias("label"))
    marks = [(r.id, r.label) for r in own.orderBy(F.xxhash64("id"), "id").limit(labelled).collect()]
    nothing = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(1 + N_FEATURES + RANDOM))
    if not marks:
        return nothing
    chosen = docs.sparkSession.createDataFrame(marks, "id long, label int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(~held_out("id"))
    texts = texts.join(F.broadcast(chosen), "id", "left").select("text", "label")
    with scratch():
        rows = written(texts.mapInArrow(_featured, "x binary, label int"), "features")
        sums = _summed(rows, 1 + 2 * N_FEATURES, lambda x, _: np.concatenate(([len(x)], x.sum(0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(0))))
        n, mean = sums[0], sums[1 : 1 + N_FEATURES] / max(sums[0], 1)
        scale = np.sqrt(np.maximum(sums[1 + N_FEATURES :] / max(n, 1) - mean**2, 0)) + 1e-3
        d = 1 + N_FEATURES + RANDOM
        upper = np.triu_indices(d)

        def moments(x, label):
            z = expanded(x, mean, scale)
            kinds = (Moments.of(z), Moments.of(z[label == 1]), Moments.of(z[label == 2]))
            return np.concatenate([np.concatenate(([m.n], m.first, m.second[upper])) for m in kinds])

        unlabelled, one, two = (_moments(m, d) for m in np.split(_summed(rows, 3 * (1 + d + len(upper[0])), moments), 3))
        positive = one + two
        if not positive.n:
            return nothing

        def counted(w):
            def add(x, label):
                place = np.clip((expanded(x, mean, scale) @ w + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(np.int64)
                return np.concatenate([np.bincount(place[kind], minlength=BINS) for kind in (label > -2, label == 1, label == 2)])

            return np.split(_summed(rows, 3 * BINS, add), 3)

        every, good, other = counted(against(one, unlabelled))
        prior = prior_of(other if other.sum() else good, every)
        w = fit(positive, unlabelled, prior)
        every, good, other = counted(w)
    return Model(mean, scale, w, *curve(good + other, every, prior), prior=prior)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of a document) and its score."""
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = batch.column(0), []
            for _, _, data, offs in parts(row.field(text)):
                out.append(model.score(features(data, offs)))
            yield pa.record_batch([row, pa.array(np.concatenate(out) if out else np.zeros(0))], ["row", "score"])

    frame, schema = framed(docs, "score double")
    return frame.mapInArrow(run, schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """A row a document: whether it is held out, its score and the label that the score speaks for. Null and empty texts
    are scored like any other."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    out = scored(docs.select("doc_id", "text"), model).select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
