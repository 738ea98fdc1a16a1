"""Toxicity: a learnt lexicon, its misspellings, and the words around them.

1. Lexicon: over a bounded sample of labelled rows (``LABELLED``, in the order of a hash of the id) the texts of each label
   that have a word are counted, near copies once (texts with one least word hash count as one). A term's weight is the
   lower bound of the log odds ratio that the counts allow; words with a weight of ``LIGHTEST`` and more, the heaviest
   ``TERMS`` of them, are the lexicon.
2. Misspellings: the lexicon's trie is intersected with Levenshtein automata, of distance 1 for terms of five characters
   and more and 2 for terms of ten and more; a misspelling keeps the first character. The states of the product (sets of trie nodes with the least edits that lead
   there) are made when a word first needs them, so nearly all words end in the dead state after two or three
   characters. An edit halves a weight. A word that texts labelled clean have is no misspelling.
3. Context: in the window of ``WINDOW`` words on both sides of a hit, quotation marks around it and words of reporting
   before it speak for quotation, words of address and other hits for abuse. Their balance divides the hit's weight.
4. A logistic curve over a document's abuse as a whole and that of its worst window gives the score. It is fitted to
   rows whose features come from the lexicon and the clean words of the other half of the sample.

Inputs are texts alone. Words are runs without white space, without other characters than letters and digits at both
ends, lower-cased in A-Z.

Edge cases: null and empty texts have no hits and get the least score; a null id is not held out and not labelled; rows
with null labels are unlabelled; repeated rows score alike, and of rows that share an id one text is learnt from; without
labels of both kinds every score is 0; an empty table gives an empty result; other columns travel in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import framed, scratch, written
from lectern.llm.words import _hashes, parts, table, words

#: Most rows sampled as labelled, most terms of a lexicon, and the least weight of one.
LABELLED, TERMS, LIGHTEST = 20_000, 2000, 1.0
#: Words on each side of a hit, and bytes of text handled at once.
WINDOW, SLICE = 8, 1 << 20
#: What an edit leaves of a weight.
EDIT = 0.5

# Words of reporting and of address in English, French, German and Spanish.
REPORTING = frozenset(
    "said says say called calls quote quoted quotes word words term terms insult insults slur means meaning wrote writes dit disait appelé mot terme insulte sagte nannte wort begriff dijo llamó palabra término insulto".split()
)
ADDRESS = frozenset("you your you're youre u ur tu toi vous ton ta du dich dir dein deine ihr usted tú eres".split())
#: Marks that open and close a quotation.
QUOTES = {"“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}


def bound(term: str) -> int:
    """Edits that a misspelling of a term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """The lexicon's trie intersected with the Levenshtein automata of its terms, made state by state. State 0 is dead."""

    def __init__(self, lexicon: dict[str, float]):
        self.terms = sorted(lexicon)
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.limit = [0]
        for k, t in enumerate(self.terms):
            node, most = 0, bound(t)
            self.limit[0] = max(self.limit[0], most)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.limit.append(0)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], most)
            self.term[node] = k
        self.letters = {c for nodes in self.children for c in nodes}
        self.weight = [lexicon[t] for t in self.terms]
        self.ids: dict[tuple, int] = {(): 0}
        self.nodes: list[tuple] = [()]
        self.found: list[tuple[int, int] | None] = [None]
        self.moves: list[dict[str, int]] = [{}]
        # the first character of a word is one of a term's
        self.start = len(self.nodes) if self.terms else 0
        if self.terms:
            self.nodes.append(((0, 0),))
            self.moves.append({})
            self.found.append(None)
            self.moves[self.start].update((c, self._state({child: 0})) for c, child in self.children[0].items())

    def _state(self, reached: dict[int, int]) -> int:
        todo = list(reached.items())
        while todo:  # characters of a term that the word leaves out
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.limit[child] and reached.get(child, 99) > edits + 1:
                    reached[child] = edits + 1
                    todo.append((child, edits + 1))
        key = tuple(sorted((n, e) for n, e in reached.items() if e <= self.limit[n]))
        if key not in self.ids:
            self.ids[key] = len(self.nodes)
            self.nodes.append(key)
            self.moves.append({})
            ends = [(e, -self.weight[self.term[n]], self.term[n]) for n, e in key if self.term[n] >= 0 and e <= bound(self.terms[self.term[n]])]
            self.found.append((min(ends)[2], min(ends)[0]) if ends else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node, edits):
            if edits <= self.limit[node] and reached.get(node, 99) > edits:
                reached[node] = edits

        for node, edits in self.nodes[state]:
            reach(node, edits + 1)
            for own, child in self.children[node].items():
                reach(child, edits + (own != c))
        out = self.moves[state][c] = self._state(reached)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term (the heaviest of equally near ones) and its edits."""
        state, letters, moves = self.start, self.letters, self.moves
        for c in word:
            if not state:
                return None
            if c not in letters:
                c = ""
            to = moves[state].get(c)
            if to is None:
                to = 0 if state == self.start else self._move(state, c)
            state = to
        return self.found[state]


@dataclass
class Model:
    """Lexicon with weights, near words that are none, and the curve."""

    lexicon: dict[str, float] = field(default_factory=dict)
    clean: frozenset = frozenset()
    curve: tuple[float, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.curve:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -40, 40)))


_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Slice:
    """Words of some texts without what is no letter or digit at their ends: bounds, hashes, and the first of each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        w = words(data, offs, "space", True)
        at = np.arange(len(data))
        inner = _INNER[data]
        after = np.minimum.accumulate(np.where(inner, at, len(data))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(inner, at, -1))
        start, end = (after[w.start], before[w.end - 1] + 1) if len(w.start) else (w.start, w.end)
        some = start < end
        self.data, self.offs, self.start, self.end = data, offs, start[some], end[some]
        self.first = np.concatenate(([0], np.cumsum(some)))[w.first]
        self.hash = _hashes(data, self.start, self.end, table("space", True)[1], 0)

    def word(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().lower().decode()

    def text(self, i: int, j: int) -> str:
        """From the end of word i to the start of word j."""
        return self.data[self.end[i] : self.start[j]].tobytes().decode()


def quoted(before: str, after: str) -> bool:
    """Whether a quotation is open at the end of ``before`` and closed in ``after``."""
    if before.count('"') % 2 and '"' in after:
        return True
    return any(before.rfind(a) > before.rfind(b) and b in after for a, b in QUOTES.items())


def abuse(s: Slice, hits: np.ndarray, weights: np.ndarray, lo: int, hi: int) -> tuple[float, float]:
    """Of one text (words lo to hi) with hits at some words: its abuse as a whole, and that of its worst window."""
    own = np.zeros(len(hits))
    for n, k in enumerate(hits.tolist()):
        a, b = max(lo, k - WINDOW), min(hi, k + WINDOW + 1)
        near = {s.word(x) for x in range(a, b) if x != k}
        told = sum(s.word(x) in REPORTING for x in range(a, k))
        left = int(s.start[a]) if a > lo else int(s.offs[np.searchsorted(s.offs, s.start[k], "right") - 1])
        right = int(s.end[b - 1]) if b < hi else int(s.offs[np.searchsorted(s.offs, s.start[k], "right")])
        marks = quoted(s.data[left : s.start[k]].tobytes().decode(errors="ignore"), s.data[s.end[k] : right].tobytes().decode(errors="ignore"))
        others = int(np.searchsorted(hits, b) - np.searchsorted(hits, a)) - 1
        quotation, address = 2 * marks + told, len(near & ADDRESS) + others
        own[n] = weights[n] * (1 + address) / (1 + address + quotation)
    sums = np.concatenate(([0.0], np.cumsum(own)))
    worst = (sums[np.searchsorted(hits, hits + WINDOW, "right")] - sums[np.arange(len(hits))]).max()
    return float(sums[-1]), float(worst)


def measured(automaton: Automaton, clean: frozenset, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row for each text: 1, and the logarithms of its abuse and of that of its worst window."""
    out = np.zeros((len(offs) - 1, 3))
    out[:, 0] = 1
    s = Slice(data, offs)
    if not automaton.terms or not len(s.start):
        return out
    _, first, inverse = np.unique(s.hash, return_index=True, return_inverse=True)
    weight = np.zeros(len(first))
    raw = data.tobytes()
    match = automaton.match
    for n, (a, b) in enumerate(zip(s.start[first].tolist(), s.end[first].tolist(), strict=True)):
        word = raw[a:b].lower().decode()
        found = match(word)
        if found is not None and (not found[1] or word not in clean):
            weight[n] = automaton.weight[found[0]] * EDIT ** found[1]
    weights = weight[inverse]
    hits = np.flatnonzero(weights)
    text = np.searchsorted(s.first, hits, "right") - 1
    for i in np.unique(text).tolist():
        own = hits[text == i] if len(hits) < 1000 else hits[np.searchsorted(text, i) : np.searchsorted(text, i, "right")]
        out[i, 1:] = np.log1p(abuse(s, own, weights[own], int(s.first[i]), int(s.first[i + 1])))
    return out


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, half, copies (the least hash of the text's words) and label, one row for each different word of a text."""
    for batch in batches:
        label, half = batch.column(1), batch.column(2)
        for i, _, data, offs in parts(batch.column(0), SLICE):
            s = Slice(data, offs)
            if not len(s.start):
                continue
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(s.first))
            _, first, inverse = np.unique(s.hash, return_index=True, return_inverse=True)
            codes = np.unique(inverse * (len(offs) - 1) + doc)
            word, doc = codes // (len(offs) - 1), codes % (len(offs) - 1)
            least = np.full(len(offs) - 1, np.iinfo(np.int64).max)
            np.minimum.at(least, doc, s.hash[first][word].view(np.int64))
            raw = data.tobytes()
            names = pa.array([raw[a:b].lower().decode() for a, b in zip(s.start[first].tolist(), s.end[first].tolist(), strict=True)], pa.string())
            at = pa.array(i + doc)
            yield pa.record_batch([names.take(pa.array(word)), half.take(at), pa.array(least[doc]), label.take(at)], ["term", "half", "copies", "label"])


def _weight(toxic, clean, all_toxic, all_clean):
    """Lower bound (two standard errors) of the log odds ratio of texts with a word."""
    a, b, c, d = toxic + 0.5, all_toxic - toxic + 0.5, clean + 0.5, all_clean - clean + 0.5
    return F.log(a * d / (b * c)) - 2 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def _scaled(lexicon: dict[str, float], heaviest: float = 4.0) -> dict[str, float]:
    """Weights by the greatest one, so that lexicons of smaller samples compare."""
    most = max(lexicon.values(), default=1.0)
    return {t: w / most * heaviest for t, w in lexicon.items()}


def _near(lexicon: dict[str, float]):
    """Rows of terms that the automaton finds near a term but not equal to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon)
        for batch in batches:
            found = (automaton.match(t) for t in batch.column(0).to_pylist())
            yield batch.filter(pa.array([f is not None and f[1] > 0 for f in found], pa.bool_()))

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by damped Newton steps, with a ridge around what is thought beforehand; no feature's weight is
    below zero."""
    before, eye = np.array([-2.0, 1.0, 1.0]), np.diag([1e-4, 0.05, 0.05])
    w = before
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + eye
        step = np.linalg.solve(h, x.T @ (p - y) + eye @ (w - before))
        w = w - np.clip(step, -0.5, 0.5)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, terms: int = TERMS) -> Model:
    """A model from at most ``labelled`` labelled rows outside the held-out fold. The driver gets the lexicon (``terms`` at
    most), the sample's words near it, and three numbers a sampled row."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)").filter(~held_out("id")).dropDuplicates(["id"])
    own = own.withColumn("half", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)).cast("int")).orderBy(F.xxhash64("id"), "id").limit(labelled)
    with scratch():
        chosen = written(own, "sample")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
        # one text an id, so that the sample is no larger than its labels, however many rows share an id
        texts = texts.groupBy("id", "label", "half").agg(F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"))).alias("text"))
        texts = written(texts.select("text", "label", "half"), "texts")
        each = texts.mapInArrow(_terms, "term string, half int, copies long, label int").distinct()
        each = written(each, "words")
        toxic = lambda h: F.count_if((F.col("half") == h) & (F.col("label") == 1))
        clean = lambda h: F.count_if((F.col("half") == h) & (F.col("label") == 0))
        n = each.select("half", "copies", "label").distinct().agg(toxic(0).alias("t0"), toxic(1).alias("t1"), clean(0).alias("c0"), clean(1).alias("c1")).first()
        if not n.t0 + n.t1 or not n.c0 + n.c1:
            return Model()
        counts = each.groupBy("term").agg(toxic(0).alias("t0"), toxic(1).alias("t1"), clean(0).alias("c0"), clean(1).alias("c1"))
        t0, t1, c0, c1 = (F.col(c) for c in ("t0", "t1", "c0", "c1"))
        counts = counts.select(
            "term", "c0", "c1", "t0", "t1", _weight(t0, c0, n.t0, n.c0).alias("w0"), _weight(t1, c1, n.t1, n.c1).alias("w1"),
            _weight(t0 + t1, c0 + c1, n.t0 + n.t1, n.c0 + n.c1).alias("w"),
        )
        counts = written(counts, "counts")
        heavy = counts.filter(F.greatest("w0", "w1", "w") >= LIGHTEST).filter("t0 + t1 >= 2").orderBy(F.desc("w"), "term").limit(terms).collect()
        lexicon, *halves = (_scaled({r.term: r[w] for r in heavy if r[w] >= LIGHTEST}) for w in ("w", "w0", "w1"))
        every = {r.term: 1.0 for r in heavy}
        near = counts.filter("c0 + c1 > 0").select("term", "c0", "c1").mapInArrow(_near(every), "term string, c0 long, c1 long").collect()
        seen = [frozenset(r.term for r in near if r[c]) for c in ("c0", "c1")]

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = [Automaton(x) for x in halves]
            for batch in batches:
                half = batch.column(2).to_numpy()
                for i, j, data, offs in parts(batch.column(0), SLICE):
                    both = [measured(a, s, data, offs) for a, s in zip(automata, seen, strict=True)]
                    x = np.where((half[i:j] == 1)[:, None], both[0], both[1])
                    yield pa.record_batch([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column(1).slice(i, j - i)], ["total", "worst", "label"])

        rows = texts.mapInArrow(features, "total double, worst double, label int").toPandas()
    x = np.column_stack((np.ones(len(rows)), rows.total, rows.worst))
    return Model(lexicon, seen[0] | seen[1], _curve(x, rows.label.to_numpy(float)))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of a document) and its score."""
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.lexicon)
        for batch in batches:
            row, out = batch.column(0), []
            for _, _, data, offs in parts(row.field(text), SLICE):
                out.append(model.score(measured(automaton, model.clean, data, offs)))
            yield pa.record_batch([row, pa.array(np.concatenate(out) if out else np.zeros(0))], ["row", "score"])

    frame, schema = framed(docs, "score double")
    return frame.mapInArrow(run, schema)


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """A row a document: whether it is held out, its score and the label that the score speaks for (from 0.3 on)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels)
    out = scored(docs.select("doc_id", "text"), model).select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
