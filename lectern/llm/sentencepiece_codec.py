"""SentencePiece models on the tokenizers library.

The model file's protobuf is parsed here field by field; normaliser (white space rules and, where the model has one,
its compiled character map), metaspace marker, unigram scores or the merge order of a BPE model, byte fallback and
special pieces are rebuilt as a ``tokenizers.Tokenizer``, which encodes batches on ``threads`` threads. What it makes of
the units it meets is held against the sentencepiece library (``differing``), in every run; ``parity`` does so for texts.

A piece never has the marker inside unless it is a run of markers, so texts are cut before each run of markers: equal
words are encoded once by a worker, in batches of some hundred texts of many words. Models for which that doesn't hold are encoded uncut.

Edge cases: a null or empty text has no ids; a text of white space only may have none; what the normaliser changes
(the marker's own character, runs of spaces) is what a round trip may lose, and ``decode(encode(x))`` equals the
library's; special pieces' strings inside a text are ordinary text; very long texts are encoded whole.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import framed
from lectern.llm.words import slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True
    escape: bool = True
    treat_as_suffix: bool = False

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def _fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Number, wire type and value of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        elif kind == 2:
            n = varint()
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"unexpected wire type {kind}")
        yield key >> 3, kind, value


def parse_model(raw: bytes) -> Model:
    m = Model()
    for number, _, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, _, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 24:
                    m.treat_as_suffix = bool(v)
        elif number == 3:
            for n, _, v in _fields(value):
                if n == 2:
                    m.char_map = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.one_space = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if m.treat_as_suffix:
        raise ValueError("models with the marker as a suffix can't be rebuilt")
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Pairs whose joining gives a piece, in the order of the pieces' scores: the model joins the best piece first."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, i in ids.items():
        if m.pieces[i][2] != NORMAL:
            continue
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-m.pieces[i][1], i, ids[left], ids[right], left, right))
    return [(x[4], x[5]) for x in sorted(found)]


def rebuild(m: Model):
    """The model as a tokenizers.Tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unknown, byte_fallback=m.byte_fallback)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, _merges(m), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = []
    if m.char_map:
        steps.append(normalizers.Precompiled(m.char_map))
    if m.one_space:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


class Codec:
    """A rebuilt model with the ids of the units (a run of markers and what follows) that it has met, all in one array.
    Units are encoded apart, so each distinct one costs the library one call, however often it occurs. Of each it is
    known whether its ids decode to it (``lost``: not) and whether the sentencepiece library has the same (``differing``:
    not)."""

    #: Units remembered by a worker; beyond it, the memory starts anew.
    KEPT = 400_000
    #: Units joined in one text of a batch; the library's time for a text grows faster than its length.
    JOINED = 16

    def __init__(self, path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = rebuild(self.model)
        self.apart = self.whole.pre_tokenizer is not None
        if self.apart:
            self.units = Tokenizer(self.whole.model)
            self.units.pre_tokenizer = self.whole.pre_tokenizer
            self.cut = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
            # what a piece decodes to by itself; bytes and the unknown piece don't
            self.plain = [p if kind not in (BYTE, UNKNOWN) else "\0" for p, _, kind in self.model.pieces]
            self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
            self.lead = MARK + "a" if self.model.escape else " a"
            self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.n = np.zeros(1 << 16, np.int64), 0
        self.flat = np.zeros(1 << 18, np.int32)
        self.lost: set[str] = set()
        self.differing: set[str] = set()

    def ids_of(self, unit: str) -> list[int]:
        k = self.place[unit]
        return self.flat[self.first[k] : self.first[k + 1]].tolist()

    def _keep(self, units: list[str], ids: np.ndarray, begin: np.ndarray) -> None:
        """Remember units whose ids begin at ``begin`` in ``ids``."""
        used, more = int(self.first[self.n]), self.n + len(units) + 1
        while more > len(self.first):
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[used : used + len(ids)] = ids
        self.first[self.n : more] = used + np.append(begin, len(ids))
        self.place.update(zip(units, range(self.n, self.n + len(units)), strict=True))
        self.n += len(units)

    def _learn(self, units: set[str]) -> None:
        """Encode units not met before: many in one text, and many texts in one batch of the library."""
        if self.n > self.KEPT:
            self._forget()
        new = [u for u in units | {self.lead} if u not in self.place]
        # with one marker each, at its start, units can be told apart in the ids of a joined text
        alone = [u for u in new if not u.startswith(MARK) or u.startswith(MARK * 2) or u == MARK]
        joined = [u for u in new if u.startswith(MARK) and not u.startswith(MARK * 2) and u != MARK]
        groups = [joined[k : k + self.JOINED] for k in range(0, len(joined), self.JOINED)]
        texts = ["".join(g) for g in groups]
        made = [e.ids for e in self.units.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(made), np.int32)
        self._keep(joined, flat, np.flatnonzero(self.begins[flat]))
        own = [e.ids for e in self.units.encode_batch_fast(alone, add_special_tokens=False)]
        self._keep(alone, np.fromiter(chain.from_iterable(own), np.int32), np.cumsum([0, *map(len, own)])[:-1])
        get = self.plain.__getitem__
        every = zip([*groups, *([u] for u in alone)], [*texts, *alone], [*made, *own], strict=True)
        self._find_lost([u for group, text, ids in every if "".join(map(get, ids)) != text for u in group])
        self._compare(groups, texts, made)
        # a run of markers is one only after something else
        lead = self.ids_of(self.lead)
        first = [self.lead if u.startswith(MARK) else "" for u in alone]
        self._compare([[u] for u in alone], [x + u for x, u in zip(first, alone, strict=True)], [(lead if x else []) + i for x, i in zip(first, own, strict=True)])

    def _find_lost(self, units: list[str]) -> None:
        """Of some units those that their ids don't decode to, by the library where pieces don't decode alone."""
        ids = {u: self.ids_of(u) for u in units}
        odd = [u for u, own in ids.items() if "".join(map(self.plain.__getitem__, own)) != u]
        for u, back in zip(odd, self.decode([ids[u] for u in odd]), strict=True):
            if back != u.replace(MARK, " ").removeprefix(" "):
                self.lost.add(u)

    def _compare(self, groups: list[list[str]], texts: list[str], ids: list[list[int]]) -> None:
        """Hold the ids of new units against the sentencepiece library's, text by text, and where a text differs, unit by
        unit."""
        plain = lambda t: (t.removeprefix(MARK) if self.model.dummy_prefix else t).replace(MARK, " ")
        for group, own, theirs in zip(groups, ids, self.library.encode([plain(t) for t in texts], num_threads=1), strict=True):
            if own != theirs:
                self.differing.update(u for u in group if len(group) == 1 or self.library.encode(plain(u)) != self.ids_of(u))

    def _split(self, texts: list[str]) -> list[list[str]]:
        plain = self.whole.normalizer.normalize_str
        if not self.model.char_map and not self.model.one_space and self.model.dummy_prefix and self.model.escape:
            return [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        return [self.cut.findall(plain(t)) if t else [] for t in texts]

    def flat_ids(self, texts: list[str], check: bool = False):
        """All ids of some texts, and where each text's begin; with ``check`` also whether they decode to the text, as the
        model normalises it, and whether the sentencepiece library has the same ids."""
        if not self.apart:
            made = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            out = np.fromiter(chain.from_iterable(made), np.int32), np.cumsum([0, *map(len, made)])
            if not check:
                return out
            plain = self.whole.normalizer.normalize_str
            whole = [a == plain(t).replace(MARK, " ").removeprefix(" ") for a, t in zip(self.decode(made), texts, strict=True)]
            return *out, whole, [a == b for a, b in zip(made, self.library.encode(texts, num_threads=1), strict=True)]
        split = self._split(texts)
        self._learn(set().union(*split))
        unit = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64)
        begin, size = self.first[unit], self.first[unit + 1] - self.first[unit]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        first = ends[np.cumsum([0, *map(len, split)])]
        if not check:
            return ids, first
        free = lambda of: [of.isdisjoint(own) for own in split] if of else [True] * len(split)
        return ids, first, free(self.lost), free(self.differing)

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, first = self.flat_ids(texts)
        return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=4)
def loaded(path: str) -> Codec:
    return Codec(path)


def encode(texts: list[str], path: str) -> list[list[int]]:
    return loaded(path).encode(texts)


def decode(ids: list[list[int]], path: str) -> list[str]:
    return loaded(path).decode(ids)


def parity(texts: list[str], path: str = MODEL) -> list[str]:
    """Texts for which the rebuilt tokenizer and the sentencepiece library differ in ids or in what they decode to."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = encode(texts, path)
    theirs = sp.encode(texts, num_threads=1)
    return [t for t, a, b, x, y in zip(texts, own, theirs, decode(own, path), [sp.decode(i) for i in theirs], strict=True) if a != b or x != y]


def _given_back() -> Iterator:
    """Nothing; but once it is reached, a worker that is kept for other tasks gives free memory back, where it can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    yield from ()


def encoded(docs: DataFrame, text_col: str = "text", model: str = MODEL, threads: int | None = None, check: bool = False) -> DataFrame:
    """``row`` (all columns), ids array<int>, and, with ``check``, round_trip: whether the ids decode to the text as the
    model normalises it, and parity: whether the sentencepiece library has the same ids. ``threads``: of the library in
    each task, twice the cores of a task unless given, so that one batch is encoded while another is read."""
    spark, text = docs.sparkSession, docs.columns.index(text_col)
    spark.sparkContext.addFile(model)
    name = os.path.basename(model)
    threads = threads or 2 * int(spark.conf.get("spark.task.cpus", "1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        path = SparkFiles.get(name)
        for batch in chain(batches, _given_back()):
            row = batch.column(0)
            column = row.field(text)
            _, offs = utf8(column)
            for i, j in slices(offs):
                texts = [x or "" for x in column.slice(i, j - i).to_pylist()]
                flat, first, *checks = loaded(path).flat_ids(texts, check)
                cols = [row.slice(i, j - i), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))]
                names = ["row", "ids"]
                if check:
                    cols += [pa.array(x, pa.bool_()) for x in checks]
                    names += ["round_trip", "parity"]
                yield pa.record_batch(cols, names)

    frame, schema = framed(docs, "ids array<int>" + (", round_trip boolean, parity boolean" if check else ""))
    return frame.mapInArrow(run, schema)


def decoded(tokens: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``row`` (all columns) and ``text`` decoded from ids; null ids give an empty text."""
    spark, at = tokens.sparkSession, tokens.columns.index(ids_col)
    spark.sparkContext.addFile(model)
    name = os.path.basename(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            yield pa.record_batch([row, pa.array(decode([x or [] for x in row.field(at).to_pylist()], SparkFiles.get(name)), pa.string())], ["row", "text"])

    frame, schema = framed(tokens, "text string")
    return frame.mapInArrow(run, schema)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """A row a document: its token ids, their number, whether they decode to the text, and whether the sentencepiece
    library has the same ones. Null and empty texts have none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encoded(docs, check=True)
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "parity")
