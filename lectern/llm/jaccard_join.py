"""N-gram Jaccard join: exact links between texts whose shingle sets are alike, and their components.

Texts with equal shingle sets form a class first (128-bit set digests); everything below runs on classes.

Candidates come from prefixes. The fixed order of tokens puts rare ones first (by hash), frequent ones last.

* A token is *rare* if at most ``RARE`` texts hold it in their prefix zone, the hashes under a bound that falls with
  the text's size so that a zone nearly always holds the 1 + n - ceil(threshold * n) rare tokens a prefix needs. For a
  text whose zone does, every partner shares one of them: single tokens are indexed.
* Other texts (mostly made of frequent tokens) are indexed by combinations of ``EACH`` tokens. Their tokens are dealt
  by hash into subclasses whose number follows a class of sizes (powers of two; a text near the upper bound is indexed
  in the next class too). The prefix, in the order of hashes, is extended until its subclasses hold
  missing + ``spare`` tokens beyond the first EACH - 1 of each, where missing is how many tokens of the text a linked
  one can lack: whatever those are, at least ``spare`` combinations within a subclass are shared.

Links are verified on whole sets. A posting list is never expanded into all its pairs at first: each member is
compared with one hub, the links found are contracted to components, and only members of different components that
still meet in a list are compared, for long lists in blocks of a bounded number of tokens. So copies cost a link each,
and no link between components is lost. Sets move only for texts that a pair needs (``perhaps_in``).

Edge cases: null texts and texts without words have an empty set and link with nothing; a text shorter than a shingle
is one shingle; repeated rows and equal ids are kept, and have one set together; ids may be null (texts of such rows are
told apart by ``text_key``, and sort last); other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.storage import dropped, perhaps_in, scratch, written
from lectern.llm.words import Grams, mix, parts, slices, starts, words

SHINGLE, PERCENT, RARE, EACH = 4, 85, 16, 3
#: Tokens of the outside members, and of all members, of a long posting list that one task compares at once.
OUTSIDE, EVERY = 1 << 15, 1 << 17
_S1, _S2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _zone(n, percent: int):
    """Share of the hash range that is the prefix zone of a text with n shingles; falls as n grows."""
    return np.minimum(1.0, (100 - percent) / 100 * 1.1 + 0.9 / np.sqrt(np.maximum(n, 1)))


def sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts, sorted within each text, and where each text's begin."""
    w = words(data, offs, "space", True)
    grams = Grams(w)
    at, counts = starts(w.first, n)
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < n))
    h = np.concatenate((grams.at(at, n), grams.at(w.first[short], size[short])))
    doc = np.concatenate((np.repeat(np.arange(len(size)), counts), short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(size) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _digest(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mix(_sums(mix(h + _S1), first) + np.diff(first).astype(np.uint64)).view(np.int64)


_SCAN = ["doc_id", "key", "n", "n_low", "cls", "two", "token", "low"]


def _scan(shingle: int, percent: int):
    """A row a text (id, key, text; n not null) and a row for each token in its prefix zone (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for i, j, data, offs in parts(batch.column(2)):
                h, first = sets(data, offs, shingle)
                n = np.diff(first)
                one, two = _digest(h, first), mix(_sums(mix(h + _S2), first)).view(np.int64)
                doc = np.repeat(np.arange(j - i), n)
                at = h.astype(np.float64) / 2.0**64
                inside = at < _zone(n, percent)[doc]
                low = at < _zone(n * 100 / percent, percent)[doc]
                n_low = np.bincount(doc[low], minlength=j - i)
                yield pa.record_batch([ids.slice(i, j - i), keys.slice(i, j - i), pa.array(n), pa.array(n_low), pa.array(one), pa.array(two), pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.bool_())], _SCAN)
                token, k = h[inside].view(np.int64), int(inside.sum())
                none = pa.nulls(k, pa.int64())
                yield pa.record_batch([pa.nulls(k, ids.type), none, none, none, pa.array(one[doc[inside]]), none, pa.array(token), pa.array(low[inside])], _SCAN)

    return run


def _sets(shingle: int):
    """Sets of texts that the join on their ids brought; equal rows meet in one task, which gives their set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            rest = [batch.column(c) for c in range(1, batch.num_columns)]
            for i, j, data, offs in parts(batch.column(0)):
                h, first = sets(data, offs, shingle)
                own = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))
                cls = rest[0].slice(i, j - i).to_numpy()
                same = _digest(h, first) == cls  # another row may have the same id
                for k in np.flatnonzero(same).tolist():
                    same[k] = int(cls[k]) not in given
                    given.add(int(cls[k]))
                same = pa.array(same)
                yield pa.record_batch([x.filter(same) for x in (*(c.slice(i, j - i) for c in rest), own)], ["cls", "n", "typical", "combine", "tokens"])

    return run


@lru_cache(maxsize=256)
def size_class(a: int, percent: int) -> tuple[int, int, int]:
    """Of the sizes from 2**a up to 2**(a + 1): subclasses, tokens in a combination, and spare combinations. A text as
    small as the smallest that is linked to one in the class still has prefix enough."""
    least = (percent * 2**a + 99) // 100
    for each in range(EACH, 0, -1):
        subclasses = max(1, int((100 - percent) / 100 * 2**0.5 * 2**a / 1.25)) if each > 1 else 1
        spare = 1 + int((100 - percent) / 100 * 2**a / 4)
        for extra in (spare, 1):
            if (percent * least + 99) // 100 >= (each - 1) * subclasses + extra:
                return subclasses, each, extra
    raise ValueError(f"no combinations for {percent} %")


@lru_cache(maxsize=256)
def _choices(n: int, each: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), each)), np.int64).reshape(-1, each)


def combinations(tokens: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of some texts (sorted tokens, text after text), the texts they are of, and for each the number of
    equal signatures that two linked texts have at least."""
    size = np.diff(first)
    own = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    sigs, docs, needs = [], [], []
    for a in range(int(own.max(initial=0)) + 2):
        m, each, spare = size_class(a, percent)
        pick = np.flatnonzero((size > 0) & ((own == a) | ((own == a - 1) & (100 * size >= percent * 2**a))))
        if not len(pick):
            continue
        n = size[pick]
        entry = np.repeat(np.arange(len(pick)), n)
        begin = np.cumsum(n) - n
        token = tokens[np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(first[pick], n)]
        salt = np.uint64((a + 1) * int(_S1) % (1 << 64))
        group = entry * m + (mix(token + salt) % np.uint64(m)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        starts_ = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1])))
        nth = np.empty(len(token), np.int64)
        nth[order] = np.arange(len(token)) - np.repeat(starts_, np.diff(np.append(starts_, len(token))))
        counts = (nth >= each - 1).astype(np.int64)
        before = np.cumsum(counts) - counts
        before -= np.repeat(before[begin], n)
        prefix = before < np.repeat(n - (percent * n + 99) // 100 + spare, n)
        order = order[prefix[order]]
        value, group = mix(token[order] + _S2), group[order]
        starts_ = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        held = np.diff(np.append(starts_, len(group)))
        for k in np.unique(held[held >= each]).tolist():
            at = starts_[held == k]
            sum_ = value[at[:, None, None] + _choices(k, each)].sum(2, dtype=np.uint64)
            sigs.append(mix(sum_ + salt).ravel())
            docs.append(np.repeat(pick[group[at] // m], sum_.shape[1]))
            needs.append(np.full(sum_.size, spare, np.int64))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(docs), np.concatenate(needs)


def _signatures(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, typical, tokens = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            flat, first = tokens.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(tokens.value_lengths().to_numpy())))
            for i, j in slices(first, 1 << 16):
                sig, doc, need = combinations(flat[first[i] : first[j]], first[i : j + 1] - first[i], percent)
                yield pa.record_batch([sig.view(np.int64), cls[i:j][doc], typical[i:j][doc], np.diff(first)[i:j][doc], need], ["sig", "cls", "typical", "n", "need"])

    return run


def _linked(percent: int):
    """Of pairs with both sets, those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            fa, fb = (x.flatten().to_numpy() for x in (a, b))
            pa_, pb = (np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy()))) for x in (a, b))
            ok = np.zeros(len(a), bool)
            for k in range(len(a)):
                x, y = fa[pa_[k] : pa_[k + 1]].view(np.uint64), fb[pb[k] : pb[k + 1]].view(np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[at] == x).sum())
                ok[k] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.record_batch([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["u", "v"])

    return run


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (u, v). Sizes are compared before any set moves."""
    sizes = full.select("cls", "n").distinct()
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    for c in ("u", "v"):
        pairs = pairs.join(sizes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}")), c)
    pairs = written(pairs.filter(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)").select("u", "v"), "candidates")
    own = full.select("cls", "tokens")
    for c in ("u", "v"):
        needed = perhaps_in(own, pairs.select(F.col(c).alias("cls")), "cls").filter("met")
        pairs = pairs.join(needed.select(F.col("cls").alias(c), F.col("tokens").alias(f"t_{c}")), c)
    return pairs.select("u", "v", "t_u", "t_v").mapInArrow(_linked(percent), "u long, v long")


def _blocks(percent: int):
    """One block of members outside the largest component against one block of all members: links between components, a
    forest of them, so no more than the block has members. Further links of a block join what its forest joins."""

    def run(table: pa.Table) -> pa.Table:
        cls, comp, rest = (table.column(c).to_numpy() for c in ("cls", "comp", "rest"))
        tokens = table.column("tokens").combine_chunks()
        flat, first = tokens.flatten().to_numpy(), np.concatenate(([0], np.cumsum(tokens.value_lengths().to_numpy())))
        mine = np.flatnonzero(rest)
        size = np.diff(first)
        every = np.concatenate([flat[first[k] : first[k + 1]] for k in mine]) if len(mine) else flat[:0]
        owner = np.repeat(np.arange(len(mine)), size[mine])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        u, v, up = [], [], {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for k in np.flatnonzero(~rest).tolist():
            x = flat[first[k] : first[k + 1]]
            lo, hi = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            same = np.bincount(owner[at], minlength=len(mine))
            for z in np.flatnonzero((100 * same >= percent * (size[mine] + size[k] - same)) & (comp[mine] != comp[k])).tolist():
                a, b = top(int(comp[mine[z]])), top(int(comp[k]))
                if a != b:
                    up[a] = b
                    u.append(int(cls[mine[z]]))
                    v.append(int(cls[k]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs between different components."""
    for c in ("u", "v"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")), c, "left")
    return pairs.filter("coalesce(c_u, u) <> coalesce(c_v, v)").select("u", "v")


def _short_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of members in different components that share as many combinations as linked texts must, for lists (arrays
    ``members`` of cls and need) of bounded length. All that a pair shares is counted here, or it also meets in a long
    list and is compared there."""
    lists = lists.groupBy("members").agg(F.count("*").alias("m")).withColumn("list", F.xxhash64("members"))
    held = lists.select("list", "m", F.explode("members").alias("x")).select("list", "m", F.col("x.cls").alias("node"), "x.need").join(labels, "node", "left")
    held = held.select("list", "m", F.struct(F.coalesce("component", "node").alias("c"), "node", "need").alias("x"))
    held = held.groupBy("list", "m").agg(F.collect_set("x").alias("xs"), F.min("x.c").alias("lo"), F.max("x.c").alias("hi")).filter("lo < hi")
    met = held.select(F.explode("xs").alias("a"), "xs", "m").select("a", F.explode("xs").alias("b"), "m").filter("a.node < b.node AND a.c <> b.c")
    met = met.groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.need").alias("need")).agg(F.sum("m").alias("m"))
    return met.filter("m >= need").select("u", "v")


def _long_lists(sig: DataFrame, labels: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in long lists. The members outside a list's largest component are gathered
    by that component, over all lists (near copies meet in many), and compared with all that meet it, block by block."""
    held = sig.select("sig", F.col("cls").alias("node"), "n").join(labels, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("comp"))
    by = held.groupBy("sig", "comp").agg(F.count("*").alias("k")).groupBy("sig").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    held = written(held.join(by.select("sig", "main"), "sig").select("main", "node", "n", "comp").distinct(), "held")
    parts_ = lambda of, most: F.greatest(F.lit(1), F.ceil(of / F.lit(most))).cast("int")
    outside = F.sum(F.when(F.col("comp") != F.col("main"), F.col("n")))
    blocks = held.groupBy("main").agg(parts_(outside, OUTSIDE).alias("zs"), parts_(F.sum("n"), EVERY).alias("ms")).filter("zs IS NOT NULL")
    held = held.join(written(blocks, "blocks"), "main")  # written, so that the join's hot keys can be split
    own, every = (lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    rest = held.filter("comp <> main").select("main", own("zs").alias("z"), every("ms").alias("m"), "node", "comp", F.lit(True).alias("rest"))
    met = held.select("main", every("zs").alias("z"), own("ms").alias("m"), "node", "comp", F.lit(False).alias("rest"))
    needed = perhaps_in(full.select("cls", "tokens"), held.select(F.col("node").alias("cls")), "cls").filter("met").select("cls", "tokens")
    rows = rest.unionByName(met).withColumnRenamed("node", "cls").join(needed, "cls")
    return rows.groupBy("main", "z", "m").applyInArrow(_blocks(percent), "u long, v long")


def text_key(text: str = "text"):
    """What tells texts of one id apart."""
    return F.xxhash64(text)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable through links) for every row; key (``text_key``), and
    component_key, the key of the component's first text: least by id (nulls last) and key."""
    with scratch() as keep:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return keep(written(_components_of(base, shingle, percent, rare), "components"))


def _components_of(base: DataFrame, shingle: int, percent: int, rare: int) -> DataFrame:
    scan = written(base.select("doc_id", text_key().alias("key"), "text").mapInArrow(_scan(shingle, percent), "doc_id long, key long, n long, n_low long, cls long, two long, token long, low boolean"), "scan")
    members = written(scan.filter("n IS NOT NULL").select("doc_id", "key", "n", "n_low", "cls", "two"), "members")
    tokens = scan.filter("n IS NULL").select("token", "cls", "low")

    # a token of one class is no candidate; of two, both are known from the count; the others' rows are read again
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("cls").alias("u"), F.max("cls").alias("v")).filter("u < v"), "shared")
    several = tokens.join(shared.filter("n > 2").select("token", (F.col("n") > rare).alias("frequent")), "token")
    several = written(several.distinct(), "several")
    dropped(scan)
    frequent = several.filter("frequent AND low").groupBy("cls").agg(F.count("*").alias("n_frequent"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = members.filter("n > 0").groupBy("cls", "two", "n").agg(F.min(place).alias("at"), F.max("n_low").alias("n_low"))
    # of a text's rare tokens in its zone, a partner lacks ``missing`` at most
    rare_ones, missing = F.col("n_low") - F.coalesce("n_frequent", F.lit(0)), F.expr(f"n - (({percent} * n + 99) div 100)")
    typical = F.coalesce("n_frequent", F.lit(0)) / F.greatest("n_low", F.lit(1))
    classes = written(classes.join(frequent, "cls", "left").select("cls", "n", "at.doc_id", "at.key", typical.alias("typical"), (rare_ones - missing).alias("least")), "classes")

    lists = several.filter("NOT frequent").groupBy("token").agg(F.array_sort(F.collect_set("cls")).alias("members")).groupBy("members").agg(F.count("*").alias("m"))
    pairs = lists.select(F.explode("members").alias("u"), "members", "m").select("u", F.explode("members").alias("v"), "m").filter("u < v")
    pairs = pairs.unionByName(shared.filter("n = 2").select("u", "v", F.lit(1).cast("long").alias("m"))).groupBy("u", "v").agg(F.sum("m").alias("m"))
    for c in ("u", "v"):
        pairs = pairs.join(classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("least").alias(f"least_{c}")), c)
    pairs = written(pairs.filter(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v) AND m >= greatest(least_u, least_v)").select("u", "v"), "pairs")
    dropped(shared, several)
    used = pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct().withColumn("used", F.lit(True))
    wanted = classes.join(used, "cls", "left").filter("used OR least < 1").select("doc_id", "key", F.xxhash64("doc_id", "key").alias("row"), "cls", "n", "typical", (F.col("least") < 1).alias("combine"))
    wanted = written(wanted, "wanted")
    texts = base.withColumn("own", text_key()).withColumn("row", F.xxhash64("doc_id", "own"))
    texts = perhaps_in(texts, wanted, "row").filter("met").select(F.col("doc_id").alias("id"), "own", "text")
    full = texts.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("key"))).select("text", "cls", "n", "typical", "combine").mapInArrow(_sets(shingle), "cls long, n long, typical double, combine boolean, tokens array<long>")
    full = written(full, "sets")

    sig = written(full.filter("combine").select("cls", "typical", "tokens").mapInArrow(_signatures(percent), "sig long, cls long, typical double, n long, need long"), "signatures")
    hubs = sig.groupBy("sig").agg(F.count("*").alias("k"), F.max_by("cls", F.struct("typical", "cls")).alias("hub")).filter("k > 1")
    # with the length and the hub of their list, signatures needn't meet the lists again
    met = sig.select("sig", "cls", "n", "need").join(hubs, "sig")
    met = written(met.select("sig", "cls", "n", "need", "hub", (F.col("k") > rare).alias("long")), "met")
    dropped(sig)
    stars = met.select(F.col("hub").alias("u"), F.col("cls").alias("v")).filter("u <> v")
    # a text meets several hubs; the one with which it shares most is enough at first
    stars = stars.groupBy("u", "v").agg(F.count("*").alias("n")).groupBy("v").agg(F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v")
    # one candidate a text is enough to contract most groups; the rest is compared only across components
    first = pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    links = written(_verified(first.unionByName(stars), full, percent), "links")
    labels = written(components(links), "labels")

    short = met.filter("NOT long").groupBy("sig").agg(F.array_sort(F.collect_set(F.struct("cls", "need"))).alias("members"))
    rest = _across(pairs, labels).unionByName(_short_lists(short, labels))
    more = written(_verified(rest, full, percent), "links")
    more_long = written(_long_lists(met.filter("long").select("sig", "cls", "n"), labels, full, percent).distinct(), "links")
    labels = written(components(links.unionByName(more).unionByName(more_long)), "labels")

    # classes to documents: a component's id is its least document
    named = members.groupBy("cls", "two", "n").agg(F.min(place).alias("least")).join(labels, F.col("cls") == F.col("node"), "left").select("cls", "two", "n", F.coalesce("component", "cls").alias("component"), F.col("component").isNotNull().alias("linked"), "least")
    least = named.filter("linked").groupBy("component").agg(F.min("least").alias("least_of_all"))
    named = named.join(least, "component", "left").select("cls", "two", "n", F.when(F.col("linked"), F.col("least_of_all")).otherwise(F.col("least")).alias("top"))
    out = members.join(named, ["cls", "two", "n"], "left").withColumn("top", F.when(F.col("n") > 0, F.col("top")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top.doc_id", "doc_id").alias("component_id"), "key", F.coalesce("top.key", "key").alias("component_key"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """A row a document: size of its set of four-word shingles and the least id reachable by links of 85 % and more.
    A null or empty text has an empty set and is a component of its own."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p : p + 3], ' ')) AS t FROM w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS g(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT node, v FROM reach JOIN links ON seen = u)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(seen) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON node = w.doc_id GROUP BY w.doc_id, n
"""
