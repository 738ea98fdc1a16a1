"""Substring dedup on a compacted de Bruijn graph of word k-mers.

Every run of ``k`` words is an edge between its first and its last k - 1 words.

1. Pieces. An edge is assigned to the least of its m-mers, which depends on its words alone; consecutive edges of a text
   with the same m-mer form a piece, and equal pieces of the whole corpus meet on the m-mer's hash (their anchor), so one
   row stands for about (k - m) / 2 edges. Anchors that occur once hold no repeated edge; a count with map-side combining
   finds the others. Equal pieces of one document are one row with their positions.
2. Pieces are counted by their content; one that occurs twice or more is repeated edge by edge. Where pieces of one
   anchor differ (a branch within it) one copy of each is cut into its edges, read again at its source coordinates, and
   the edges are counted.
3. Compaction. The end of a repeated piece doesn't branch if the same piece follows wherever it occurs, and that follows
   nothing else. Such neighbours are joined to paths by pointer doubling: each round joins a piece with what its pointer
   points to, so a path of n pieces takes log2(n) rounds.
4. Verification. A path's words are read at its source coordinates (the first piece's first occurrence), and every
   occurrence is removed only if its words have the same 128-bit BLAKE2b digest.

Documents are told apart by a hash of the text, so no table of all texts is written; equal texts have equal marks.

Edge cases: null and empty texts have no words; texts under ``k`` words lose none; equal rows count as occurrences of
each other; other columns travel in ``row``, so names can't clash; very long texts are handled alone, not cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.storage import dropped, perhaps_in, written
from lectern.llm.words import Grams, Words, parts, starts, words

K, M = 35, 10
_POS = np.uint64((1 << 24) - 1)


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the first least of hashes[i:i+width], by the upper 40 bits."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(hashes) <= int(_POS):
        key = (hashes & ~_POS) | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < width:
            key = np.minimum(key[:n], key[width - size : width - size + n])
        return (key[:n] & _POS).astype(np.int64)
    top, best = hashes >> np.uint64(24), np.arange(n)
    for d in range(1, width):
        other = np.arange(n) + d
        best = np.where(top[other] < top[best], other, best)
    return best


def _paths(w: Words, k: int, m: int):
    """Anchors' hashes, first words (in all words) and numbers of edges of the paths of some texts."""
    at, _ = starts(w.first, k)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    every = np.arange(len(w.hash) - m + 1)
    mers = Grams(w).at(every, m)
    anchor = _least(mers, k - m + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return mers[anchor[begin]], at[begin], np.diff(np.append(begin, len(at)))


def _emit(k: int, m: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for i, _, data, offs in parts(batch.column(1)):
                w = words(data, offs, "space", False, full)
                anchor, at, edges = _paths(w, k, m)
                if not full:
                    kinds, n = np.unique(anchor, return_counts=True)
                    yield pa.record_batch([kinds.view(np.int64), n], ["anchor", "n"])
                    continue
                doc = np.searchsorted(w.first, at, "right") - 1
                one, two = Grams(w).at(at, edges + k - 1), Grams(w, 1).at(at, edges + k - 1)
                # what follows each piece without a gap; a text's last piece has no follower
                after, follows = np.zeros(len(at), np.uint64), np.zeros(len(at), bool)
                after[:-1], follows[:-1] = one[1:], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + edges[:-1])
                order = np.lexsort((at, two, one, doc))
                one, two, doc, at, anchor, edges, after, follows = (x[order] for x in (one, two, doc, at, anchor, edges, after, follows))
                new = np.ones(len(at), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                # known only where it is the same at all of the row's positions
                sure = np.ones(len(at), bool)
                sure[1:] = new[1:] | (after[1:] == after[:-1])
                sure = np.minimum.reduceat(follows & sure, begin) if len(begin) else sure
                pos = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), pa.array((at - w.first[doc]).astype(np.int32)))
                cols = [anchor[begin].view(np.int64), one[begin].view(np.int64), two[begin].view(np.int64), rid[i + doc[begin]], pos, edges[begin].astype(np.int32), pa.array(after[begin].view(np.int64), mask=~sure)]
                yield pa.record_batch(cols, ["anchor", "one", "two", "rid", "pos", "edges", "after"])

    return run


def _listed(batch: pa.RecordBatch, k: int, both: bool):
    """For the slices of texts with pieces listed for them: words, rids, and of each piece that is at its place its text,
    first word, edges, and the place in the list."""
    rid, listed = batch.column(0).to_numpy(), batch.column(2)
    for i, j, data, offs in parts(batch.column(1)):
        w = words(data, offs, "space", False, both)
        own = listed.slice(i, j - i)
        flat = own.flatten()
        doc = np.repeat(np.arange(j - i), own.value_lengths().to_numpy())
        pos, size, one, two = (flat.field(x).to_numpy() for x in range(4))
        fits = pos + size + k - 1 <= np.diff(w.first)[doc]
        at = np.where(fits, w.first[doc] + pos, 0)
        length = np.where(fits, size + k - 1, 0)
        # another text may have the same rid: its words are others
        fits &= (Grams(w).at(at, length).view(np.int64) == one) & (Grams(w, 1).at(at, length).view(np.int64) == two)
        some = np.flatnonzero(fits)
        yield data, w, rid[i:j], doc[some], at[some], size[some], flat, some


def _edges(k: int):
    """Edges of the pieces listed for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w, rid, doc, at, size, flat, some in _listed(batch, k, True):
                n = flat.field(4).to_numpy()[some]
                each = np.repeat(np.arange(len(at)), size)
                off = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                cols = [Grams(w).at(at[each] + off, k).view(np.int64), Grams(w, 1).at(at[each] + off, k).view(np.int64), n[each], rid[doc[each]], (at - w.first[doc])[each].astype(np.int32), off.astype(np.int32)]
                yield pa.record_batch(cols, ["one", "two", "n", "rid", "pos", "off"])

    return run


def _sources(k: int):
    """Digests of the paths listed for each document by their first piece: its hashes and the path's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, w, _, doc, at, _, flat, some in _listed(batch, k, True):
                whole = flat.field(4).to_numpy()[some]
                ok = at + whole + k - 1 <= w.first[doc + 1]
                some, at, whole = some[ok], at[ok], whole[ok]
                one, two = (flat.field(c).to_numpy()[some] for c in (2, 3))
                yield pa.record_batch([one, two, pa.array(digests(data, w, at, whole + k - 1), pa.binary())], ["one", "two", "digest"])

    return run


def digests(data: np.ndarray, w: Words, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    """BLAKE2b digests of runs of words, joined by one space each."""
    size = w.end - w.start
    ends = np.cumsum(size + 1)
    begin = ends - size - 1
    joined = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inside = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    joined[begin[inside] + nth] = data[w.start[inside] + nth]
    raw = memoryview(joined.tobytes())
    return [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin[start].tolist(), (ends[start + length - 1] - 1).tolist(), strict=True)]


def _cut(text: int, k: int, layout: bool):
    """Remove the words covered by marked edges. layout: leave the white space around kept words as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, marks = batch.column(0), batch.column(1)
            n_words, kept, out_from, out_to = [], [], [], []
            for i, j, data, offs in parts(row.field(text)):
                w = words(data, offs, "space", False)
                own = marks.slice(i, j - i)
                flat = own.flatten()
                doc = np.repeat(np.arange(j - i), own.value_lengths().fill_null(0).to_numpy())
                delta = np.zeros(len(w.hash) + 1, np.int64)
                if len(doc):
                    each = flat.field(0).value_lengths().to_numpy()
                    nth = np.repeat(np.arange(len(doc)), each)
                    doc, pos = doc[nth], flat.field(0).flatten().to_numpy()
                    edges, mask = (flat.field(c).to_numpy()[nth] for c in (1, 2))
                    fits = pos + edges + k - 1 <= np.diff(w.first)[doc]
                    whole = np.flatnonzero(fits & (mask == 0))
                    at = w.first[doc[whole]] + pos[whole]
                    # the words here are those at the path's source
                    wanted = flat.field(3).take(pa.array(nth[whole])).to_pylist()
                    same = np.array([x == y for x, y in zip(digests(data, w, at, edges[whole] + k - 1), wanted, strict=True)], bool)
                    np.add.at(delta, at[same], 1)
                    np.add.at(delta, at[same] + edges[whole][same] + k - 1, -1)
                    for off in range(int(mask.max()).bit_length()):
                        some = np.flatnonzero(fits & ((mask >> off) & 1 == 1))
                        at = w.first[doc[some]] + pos[some] + off
                        np.add.at(delta, at, 1)
                        np.add.at(delta, at + k, -1)
                gone = np.cumsum(delta)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                lo, hi = edge[::2], edge[1::2]
                # a removed run is cut where a text ends
                inner = np.searchsorted(w.first, lo, "right")
                if len(lo) and (w.first[inner] < hi).any():
                    cuts = w.first[1:-1]
                    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(gone))])
                    cuts = cuts[gone[cuts - 1] & gone[cuts]]
                    lo, hi = np.sort(np.append(lo, cuts)), np.sort(np.append(hi, cuts))
                doc = np.searchsorted(w.first, lo, "right") - 1
                begin = np.searchsorted(doc, np.arange(j - i + 1))
                n_words.extend(np.diff(w.first).tolist())
                for x in range(j - i):
                    base = w.first[x]
                    out_from.append((lo[begin[x] : begin[x + 1]] - base).astype(np.int32))
                    out_to.append((hi[begin[x] : begin[x + 1]] - base).astype(np.int32))
                kept.extend(_kept(data, offs, w, gone, layout))
            yield pa.record_batch([row, pa.array(n_words, pa.int64()), pa.array(kept, pa.string()), pa.array(out_from, pa.list_(pa.int32())), pa.array(out_to, pa.list_(pa.int32()))], ["row", "n_words", "kept", "removed_from", "removed_to"])

    return run


def _kept(data: np.ndarray, offs: np.ndarray, w: Words, gone: np.ndarray, layout: bool) -> list[str]:
    stay = np.flatnonzero(~gone)
    doc = np.searchsorted(w.first, stay, "right") - 1
    delta = np.zeros(len(data) + 2, np.int32)
    if layout:  # a removed word goes with the white space after it
        delta[0] = 1
        lost = np.flatnonzero(gone)
        owner = np.searchsorted(w.first, lost, "right") - 1
        after = np.append(w.start, len(data))[lost + 1]
        np.add.at(delta, w.start[lost], -1)
        np.add.at(delta, np.minimum(after, offs[owner + 1]), 1)
    else:
        data = data.copy()
        more = np.zeros(len(stay), np.int64)
        more[:-1] = doc[1:] == doc[:-1]
        data[w.end[stay][more == 1]] = 32
        np.add.at(delta, w.start[stay], 1)
        np.add.at(delta, w.end[stay] + more, -1)
    keep = np.cumsum(delta)[: len(data)] > 0
    out = data[keep].tobytes()
    ends = np.concatenate(([0], np.cumsum(keep)))[offs]
    return [out[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _compacted(pieces: DataFrame) -> DataFrame:
    """Paths of repeated pieces (one, two, edges, n, source, and ``after``: what follows, if that is the same wherever the
    piece occurs): the first piece's hashes, edges and source, and ``whole``, the path's edges."""
    links = pieces.filter("after IS NOT NULL").select(F.struct("one", "two").alias("p"), F.col("edges").alias("off"), F.col("after").alias("one"), F.col("n").alias("m"))
    # and a follower that occurs as often follows nothing else
    links = links.join(pieces.select("one", "two", "n"), "one").filter("m = n").select("one", "two", "p", "off")
    # each piece points to one before it, ever further: to the first of its path at last
    now, more = written(links, "pointers"), True
    while more:
        own = now.select(F.struct("one", "two").alias("p"), F.col("p").alias("pp"), F.col("off").alias("more"))
        then = written(now.join(own, "p", "left").select("one", "two", F.coalesce("pp", "p").alias("p"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.col("pp").isNotNull().alias("moved")), "pointers")
        more = bool(then.filter("moved").limit(1).count())
        dropped(now)
        now = then.select("one", "two", "p", "off")
        now._lectern_path = then._lectern_path
    ends = now.join(pieces.select("one", "two", "edges"), ["one", "two"]).groupBy("p").agg(F.max(F.col("off") + F.col("edges")).alias("whole"))
    heads = pieces.join(now.select("one", "two"), ["one", "two"], "left_anti")
    return heads.join(ends.select("p.one", "p.two", "whole"), ["one", "two"], "left").select("one", "two", "edges", "source", F.coalesce("whole", "edges").alias("whole"))


def remove_repeats(docs: DataFrame, text_col: str = "text", k: int = K, layout: bool = False) -> DataFrame:
    """``row`` (all columns of a document), n_words, kept (its remaining words, joined by one space or as laid out),
    removed_from/removed_to (runs of removed words)."""
    text = docs.columns.index(text_col)
    m = min(M, k)
    if k - m + 1 > 31:
        m = k - 30  # a piece has at most k - m + 1 edges, the bits of a mask
    rid = F.xxhash64(docs[text_col])
    base = docs.select(rid.alias("rid"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    texts = docs.select(rid.alias("rid"), docs[text_col].alias("text"))

    def at_sources(lists: DataFrame, read, schema: str) -> DataFrame:
        """Texts read again where pieces (struct source) are listed; other texts don't move."""
        lists = written(lists, "listed")
        return perhaps_in(texts, lists, "rid").filter("met").join(lists, "rid").select("rid", "text", "pieces").mapInArrow(read, schema)

    anchors = texts.mapInArrow(_emit(k, m, False), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    anchors = written(anchors, "anchors")  # so that a hot anchor's rows can be split in the join
    pieces = texts.mapInArrow(_emit(k, m, True), "anchor long, one long, two long, rid long, pos array<int>, edges int, after long")
    pieces = written(pieces.join(anchors, "anchor", "left_semi"), "pieces")
    content = ["anchor", "one", "two"]
    after = F.when((F.count("*") == F.count("after")) & (F.min("after") == F.max("after")), F.min("after"))
    kinds = written(pieces.groupBy(*content).agg(F.sum(F.size("pos")).alias("n"), F.min(F.struct("rid", F.element_at("pos", 1).alias("pos"))).alias("source"), F.min("edges").alias("edges"), after.alias("after")), "kinds")

    branching = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("anchor")
    listed = kinds.join(written(branching, "branching"), "anchor", "left_semi").groupBy(F.col("source.rid").alias("rid")).agg(F.collect_list(F.struct("source.pos", "edges", "one", "two", "n")).alias("pieces"))
    edges = written(at_sources(listed, _edges(k), "one long, two long, n long, rid long, pos int, off int"), "edges")
    again = edges.groupBy("one", "two").agg(F.sum("n").alias("n")).filter("n > 1").select("one", "two")
    single = edges.filter("n = 1").join(again, ["one", "two"], "left_semi").groupBy("rid", "pos").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"))
    single = single.select("rid", F.array("pos").alias("pos"), F.lit(0).alias("edges"), "mask", F.lit(None).cast("binary").alias("digest"))

    repeated = written(kinds.filter("n > 1"), "repeated")
    dropped(anchors, kinds)
    paths = written(_compacted(repeated), "paths")
    lists = paths.groupBy(F.col("source.rid").alias("rid")).agg(F.collect_list(F.struct("source.pos", "edges", "one", "two", "whole")).alias("pieces"))
    read = at_sources(lists, _sources(k), "one long, two long, digest binary").groupBy("one", "two").agg(F.min("digest").alias("digest"))
    paths = written(paths.join(read, ["one", "two"]).select("one", "two", "whole", "digest"), "digests")
    whole = pieces.select("rid", "pos", "one", "two").join(paths, ["one", "two"]).select("rid", "pos", F.col("whole").alias("edges"), F.lit(0).cast("long").alias("mask"), "digest")
    # equal texts have equal marks, and a task sends each once
    marks = written(whole.unionByName(single).groupBy("rid").agg(F.collect_set(F.struct("pos", "edges", "mask", "digest")).alias("marks")), "marks")
    dropped(edges, pieces, repeated, paths)

    schema = T.StructType([base.schema["row"], *T._parse_datatype_string("n_words long, kept string, removed_from array<int>, removed_to array<int>").fields])
    flagged = perhaps_in(base, marks, "rid")
    untouched = flagged.filter("NOT met").select("row", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"))
    every = flagged.filter("met").join(marks, "rid", "left").select("row", "marks").unionByName(untouched)
    return every.mapInArrow(_cut(text, k, layout), schema)


def n_removed():
    return F.aggregate(F.zip_with("removed_from", "removed_to", lambda a, b: b - a), F.lit(0), lambda x, y: x + y).cast("long")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """A row a document: its words, how many go, and a digest of the rest. Null texts have no words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(F.col("row.doc_id").alias("doc_id"), "n_words", n_removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 34], ' ')) AS run FROM d, unnest(generate_series(1, len(w) - 34)) AS t(p)),
again AS (SELECT run FROM runs GROUP BY run HAVING count(*) > 1),
marked AS (SELECT DISTINCT doc_id, p + k AS p FROM runs JOIN again USING (run), unnest(generate_series(0, 34)) AS t(k)),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM marked GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS text
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) AS t JOIN d USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.doc_id = t.doc_id AND m.p = t.p)
  GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
