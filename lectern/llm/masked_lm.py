"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Every token is predicted from the ``SIDE`` tokens before and after it: position-wise embeddings are summed, bent by
tanh, and a two-level softmax (class, then word in class) gives the token's probability. A document's score is the sum
of its tokens' conditional log-probabilities.

Vocabulary: word counts over all documents; the most frequent words have a token each, the others share ``REST``
tokens by hash. Such a word's probability is that of its shared token times its own share of the token's occurrences,
n(word) / n(token), from the counts of every word. These grow with the corpus, so they stay a table: the words of a
batch of documents meet their counts by ranges of hashes, and only sums by document come back. A range in which a word
occurs very often is dealt to several groups by batch, each of which gets the range's counts.

Training: in each round every partition starts from the common weights, passes over all its documents (one in ``SHARE``
of the positions, drawn by hash, others in each round, so that the rounds together train on every position once) with
Adagrad, and hands on its weights as one vector; the mean, weighted by positions, is taken by a tree of adders, so what
reaches the driver has a fixed size.

Edge cases: null and empty texts have no tokens and a score of 0 (mean null); texts shorter than a window see the
boundary token; repeated rows score alike; an empty table trains nothing; other columns travel in ``row``; a word
without a count (the counts being of other documents) counts as seen once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import framed, written
from lectern.llm.sums import tree_sum
from lectern.llm.words import Words, mix, parts, words

SIDE, WIDTH, CLASSES, EACH, REST, ROUNDS, SHARE, BATCH, RATE = 2, 24, 16, 32, 64, 2, 2, 2048, 0.15
SIZE = CLASSES * EACH
PLACES = [d for d in range(-SIDE, SIDE + 1) if d]
SHAPES = {"e": (len(PLACES), SIZE + 1, WIDTH), "b": (WIDTH,), "wc": (WIDTH, CLASSES), "bc": (CLASSES,), "ww": (CLASSES, WIDTH, EACH), "bw": (CLASSES, EACH)}
N_WEIGHTS = sum(int(np.prod(s)) for s in SHAPES.values())
#: Words gathered before their counts are sent on.
_GATHER = 1 << 21
#: Occurrences of rare words that meet their counts at once, about, and the least number of such ranges of hashes.
_RANGE, _RANGES = 1 << 22, 32
#: Occurrences that one group of a range has, about, at most.
_HELD = 1 << 23


@dataclass
class Net:
    """Weights in one vector, and the vocabulary's sorted hashes with their tokens."""

    flat: np.ndarray
    known: np.ndarray
    token: np.ndarray

    def parts(self) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            out[name] = self.flat[at : at + n].reshape(shape)
            at += n
        return out

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        rest = (mix(hashes) % np.uint64(REST)).astype(np.int64) + SIZE - REST
        if not len(self.known):
            return rest
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.token[at], rest)


def start(known: np.ndarray, token: np.ndarray, seed: int = 5) -> Net:
    rng = np.random.default_rng(seed)
    net = Net(np.zeros(N_WEIGHTS, np.float32), known, token)
    for name, w in net.parts().items():
        if name in ("e", "wc", "ww"):
            w[...] = rng.normal(0, 0.3 if name == "e" else WIDTH**-0.5, w.shape)
    return net


def contexts(token: np.ndarray, w: Words) -> np.ndarray:
    """Tokens around each token; SIZE stands for what is beyond the text."""
    doc, n = w.doc, len(token)
    out = np.full((len(PLACES), n), SIZE, np.int64)
    for k, d in enumerate(PLACES):
        at = np.arange(n) + d
        ok = (at >= 0) & (at < n)
        ok[ok] = doc[at[ok]] == doc[ok]
        out[k, ok] = token[at[ok]]
    return out


def _log_softmax(z: np.ndarray) -> np.ndarray:
    """Rows' log-probabilities. Outputs beyond 60 count as 60, so that nothing overflows; a product with ones sums rows
    faster than a reduction does."""
    z = np.clip(z, -60, 60)
    return z - np.log(np.exp(z) @ np.ones(z.shape[1], z.dtype))[:, None]


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of the columns."""
    return np.ones(len(x), x.dtype) @ x


def forward(p: dict[str, np.ndarray], context: np.ndarray, token: np.ndarray):
    """Log-probabilities of tokens given their contexts, and what the gradient needs."""
    h = p["b"] + p["e"][0][context[0]]
    for k in range(1, len(PLACES)):
        h += p["e"][k][context[k]]
    h = np.tanh(h)
    cls, word = token % CLASSES, token // CLASSES
    lc = _log_softmax(h @ p["wc"] + p["bc"])
    out = lc[np.arange(len(token)), cls]
    order = np.argsort(cls.astype(np.int16), kind="stable")  # by digits, which long whole numbers aren't
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    lw = np.empty((len(token), EACH), np.float32)
    for c in range(CLASSES):
        at = order[bounds[c] : bounds[c + 1]]
        if len(at):
            lw[at] = _log_softmax(h[at] @ p["ww"][c] + p["bw"][c])
    out = out + lw[np.arange(len(token)), word]
    return out, (h, lc, lw, cls, word, order, bounds)


def step(net: Net, grad2: np.ndarray, context: np.ndarray, token: np.ndarray) -> None:
    p, n = net.parts(), len(token)
    _, (h, lc, lw, cls, word, order, bounds) = forward(p, context, token)
    g = Net(np.zeros_like(net.flat), net.known, net.token)
    q = g.parts()
    dc = np.exp(lc)
    dc[np.arange(n), cls] -= 1
    dw = np.exp(lw)
    dw[np.arange(n), word] -= 1
    q["wc"][...], q["bc"][...] = h.T @ dc, _total(dc)
    dh = dc @ p["wc"].T
    for c in range(CLASSES):
        at = order[bounds[c] : bounds[c + 1]]
        if len(at):
            own = dw[at]
            q["ww"][c], q["bw"][c] = h[at].T @ own, _total(own)
            dh[at] += own @ p["ww"][c].T
    dh *= 1 - h * h
    q["b"][...] = _total(dh)
    for k in range(len(PLACES)):
        at = np.argsort(context[k].astype(np.int16), kind="stable")
        ids = context[k][at]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        q["e"][k][ids[first]] = np.add.reduceat(dh[at], first, axis=0)
    g.flat /= n
    grad2 += g.flat * g.flat
    net.flat -= RATE * g.flat / (np.sqrt(grad2) + 1e-6)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([h.view(np.int64), n], ["hash", "n"])

    for batch in batches:
        for _, _, data, offs in parts(batch.column(0)):
            held.append(words(data, offs, "space", True).hash)
            size += len(held[-1])
            if size >= _GATHER:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """hash and n of every word of all documents."""
    return written(docs.select(text_col).mapInArrow(_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent words, and their tokens (0 is the most frequent)."""
    top = np.array([r.hash for r in counts.orderBy(F.desc("n"), "hash").limit(SIZE - REST).collect()], np.int64).view(np.uint64)
    order = np.argsort(top)
    return top[order], order


def rest_counts(counts: DataFrame, net: Net) -> np.ndarray:
    """Occurrences of each shared token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE)
        for batch in batches:
            total += np.bincount(net.tokens(batch.column(0).to_numpy().view(np.uint64)), batch.column(1).to_numpy(), SIZE)
        yield pa.record_batch([np.arange(REST, dtype=np.int32), total[-REST:].astype(np.int64)], ["rest", "n"])

    out = np.zeros(REST, np.int64)
    for r in counts.select("hash", "n").mapInArrow(run, "rest int, n long").groupBy("rest").agg(F.sum("n").alias("n")).collect():
        out[r.rest] = r.n
    return out


def drawn(hashes: np.ndarray, place: np.ndarray, turn: int) -> np.ndarray:
    """Which tokens (by word and place in the text) a round trains on; each is in one of ``SHARE`` rounds."""
    return np.flatnonzero(mix(hashes + place.astype(np.uint64)) % np.uint64(SHARE) == np.uint64(turn % SHARE))


def _trained(net: Net, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        own, seen = Net(net.flat.copy(), net.known, net.token), 0
        grad2 = np.full(N_WEIGHTS, 1e-4, np.float32)
        wait: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for _, _, data, offs in parts(batch.column(0)):
                w = words(data, offs, "space", True)
                token = own.tokens(w.hash)
                context = contexts(token, w)
                place = np.arange(len(token)) - np.repeat(w.first[:-1], np.diff(w.first))
                pick = drawn(w.hash, place, turn)
                wait.append((context[:, pick], token[pick]))
                held += len(pick)
                if held >= BATCH:
                    c, t = (np.concatenate(x, axis=-1) for x in zip(*wait, strict=True))
                    order = np.random.default_rng(held).permutation(len(t))
                    c, t = c[:, order], t[order]
                    for k in range(0, len(t), BATCH):
                        step(own, grad2, c[:, k : k + BATCH], t[k : k + BATCH])
                    seen, wait, held = seen + len(t), [], 0
        if held:
            c, t = (np.concatenate(x, axis=-1) for x in zip(*wait, strict=True))
            step(own, grad2, c, t)
            seen += len(t)
        return np.append(own.flat.astype(np.float64) * seen, float(seen)) if seen else None

    return run


def train(docs: DataFrame, text_col: str = "text", counts: DataFrame | None = None) -> Net:
    net = start(*vocabulary(word_counts(docs, text_col) if counts is None else counts))
    for turn in range(ROUNDS):
        total = tree_sum(docs.select(text_col), N_WEIGHTS + 1, _trained(net, turn))
        if not total[-1]:
            break
        net.flat = (total[:-1] / total[-1]).astype(np.float32)
    return net


def _packed(hashes: np.ndarray, doc: np.ndarray, ranges: int, rows: int) -> pa.ListArray:
    """Rare words of a batch of documents by ranges of hashes, all in its first row: each word once, how often it
    occurs, and the numbers of the documents it occurs in."""
    order = np.argsort(hashes, kind="stable")
    own, first, times = np.unique(hashes[order], return_index=True, return_counts=True)
    doc, times, bounds = doc[order].astype(np.int32), times.astype(np.int32), np.append(first, len(order))
    place = (((own >> 32) + (1 << 31)) * ranges) >> 32
    found, begin = np.unique(place, return_index=True)
    ends = np.append(begin, len(own))
    cuts = list(zip(ends[:-1], ends[1:], strict=True))
    packs = pa.StructArray.from_arrays(
        [pa.array(found.astype(np.int32)), *(pa.array([x.tobytes() for x in each], pa.binary()) for each in ([own[a:b] for a, b in cuts], [times[a:b] for a, b in cuts], [doc[bounds[a] : bounds[b]] for a, b in cuts]))],
        ["place", "words", "times", "docs"],
    )
    return pa.ListArray.from_arrays(pa.array([0] + [len(found)] * rows, pa.int32()), packs)


def _shares(rest: np.ndarray):
    """Of the packed words of each batch, by document, the sum of log(n(word) / n(shared token))."""
    log_rest = np.log(np.maximum(rest, 1))

    def run(packs: pa.Table, counts: pa.Table) -> pa.Table:
        known, n = counts["hash"].to_numpy(), counts["n"].to_numpy()
        order = np.argsort(known)
        known, log_n = np.append(known[order], 0), np.append(np.log(n[order]), 0.0)
        docs, sums = [], []
        for words_, times, doc in zip(*(packs[c].to_pylist() for c in ("words", "times", "docs")), strict=True):
            own, doc = np.frombuffer(words_, np.int64), np.frombuffer(doc, np.int32)
            at = np.searchsorted(known[:-1], own)
            value = np.where(known[at] == own, log_n[at], 0.0) - log_rest[(mix(own.view(np.uint64)) % np.uint64(REST)).astype(np.int64)]
            some = np.flatnonzero(np.bincount(doc)).astype(np.int32)
            docs.append(some.tobytes())
            sums.append(np.bincount(doc, np.repeat(value, np.frombuffer(times, np.int32)))[some].tobytes())
        return pa.table([packs["batch"].combine_chunks(), pa.array(docs, pa.binary()), pa.array(sums, pa.binary())], ["batch", "docs", "sums"])

    return run


def _summed(packs: pa.Table) -> pa.Table:
    """The sums of a batch's documents over all ranges."""
    docs = [np.frombuffer(x, np.int32) for x in packs["docs"].to_pylist()]
    doc, value = np.concatenate(docs), np.concatenate([np.frombuffer(x, np.float64) for x in packs["sums"].to_pylist()])
    some = np.flatnonzero(np.bincount(doc))
    return pa.table([some + packs["batch"][0].as_py(), np.bincount(doc, value)[some]], ["id", "share"])


def scored(docs: DataFrame, net: Net, text_col: str = "text", counts: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or those to keep), n_tokens and log_likelihood, the sum of the tokens' conditional
    log-probabilities. ``counts`` (those of ``docs`` unless given) tell the shared tokens' words apart."""
    counts = word_counts(docs, text_col) if counts is None else counts
    rest = rest_counts(counts, net)
    ranges = max(_RANGES, int(rest.sum()) // _RANGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = net.parts(), TaskContext.get().partitionId() << 40
        for batch in batches:
            row = batch.column(0)
            n, total = np.zeros(len(row), np.int64), np.zeros(len(row))
            rare, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, data, offs in parts(batch.column(1)):
                w = words(data, offs, "space", True)
                token = net.tokens(w.hash)
                context, logs = contexts(token, w), np.zeros(len(token))
                for k in range(0, len(token), 8 * BATCH):
                    logs[k : k + 8 * BATCH] = forward(p, context[:, k : k + 8 * BATCH], token[k : k + 8 * BATCH])[0]
                n[i:j] = np.diff(w.first)
                total[i:j] = np.bincount(w.doc, logs, j - i)
                pick = token >= SIZE - REST
                rare.append(w.hash[pick].view(np.int64))
                of.append(w.doc[pick] + i)
            if len(row):
                packs = _packed(np.concatenate(rare), np.concatenate(of), ranges, len(row))
                yield pa.record_batch([row, pa.array(at + np.arange(len(row))), pa.array(np.full(len(row), at)), pa.array(n), pa.array(total), packs], ["row", "id", "batch", "n_tokens", "log_likelihood", "packs"])
            at += len(row)

    _, schema = framed(docs.select(*(keep or docs.columns)), "id long, batch long, n_tokens long, log_likelihood double, packs array<struct<place:int,words:binary,times:binary,docs:binary>>")
    frame = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), docs[text_col].alias("text"))
    rows = written(frame.mapInArrow(run, schema), "scored")
    place = F.shiftright((F.shiftright("hash", 32) + F.lit(1 << 31)) * F.lit(ranges).cast("long"), 32).cast("int")
    packs = rows.select("batch", F.explode("packs").alias("p")).select("batch", "p.*")
    # ranges with more occurrences than a group should hold; there are no more of them than all occurrences over that
    rare = counts.filter(~F.col("hash").isin(net.known.view(np.int64).tolist())) if len(net.known) else counts
    large = rare.groupBy(place.alias("place")).agg(F.ceil(F.sum("n") / _HELD).cast("int").alias("groups")).filter("groups > 1")
    large = F.broadcast(written(large, "large"))
    packs = packs.join(large, "place", "left").withColumn("group", F.coalesce(F.pmod(F.xxhash64("batch"), F.col("groups")).cast("int"), F.lit(0)))
    known = counts.select(place.alias("place"), "hash", "n").join(large, "place", "left")
    known = known.select("place", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)).alias("group"), "hash", "n")
    packs = packs.select("place", "group", "batch", "words", "times", "docs").groupBy("place", "group")
    met = packs.cogroup(known.groupBy("place", "group")).applyInArrow(_shares(rest), "batch long, docs binary, sums binary")
    shares = met.groupBy("batch").applyInArrow(_summed, "id long, share double")
    return rows.join(shares, "id", "left").select("row", "n_tokens", (F.col("log_likelihood") + F.coalesce("share", F.lit(0.0))).alias("log_likelihood"))


def op5_masked_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = word_counts(docs)
    out = scored(docs, train(docs, counts=counts), counts=counts, keep=["doc_id"])
    return out.select("row.doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token"))
