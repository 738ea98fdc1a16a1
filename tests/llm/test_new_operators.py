"""Source divergence, toxicity and conversation repair on small rows against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import conversation_repair as R
from lectern.llm import divergence as D
from lectern.llm import toxicity as X
from test_operators import TEXTS, frame, prose

# Source divergence


def plain_divergence(rows, least, ranks):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))) for t, x, s in rows]
    in_docs, counts = collections.Counter(), collections.Counter()
    for lang, source, w in docs:
        in_docs.update((lang, t) for t in set(w))
        counts.update((lang, source, t) for t in w)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least)
        sources = sorted({d[1] for d in docs if d[0] == lang})

        def shares(n):
            return {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        own = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        p, q = {s: shares(own[s]) for s in sources}, shares({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def test_divergence(spark):
    r = random.Random(5)
    rows = [(prose(k, r.randrange(60), 40) + " Été 3x", r.choice(["en", "de", None]), r.choice(["a", "b", "ü", None, ""])) for k in range(120)]
    rows += [(t, "fr", "only") for t in TEXTS] + [(None, "xx", "p"), ("", "xx", "q"), ("one two", "xx", "p")] + [("same words here", "en", "a")] * 30
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "text string, lang string, source string, term string, n int")
    got = D.divergence(docs, least=4, ranks=3)
    assert {tuple(x) for x in got.select("lang", "source", "part", "item", "value", "rank").collect()} == plain_divergence(rows, 4, 3)
    assert D.divergence(docs.limit(0)).count() == 0


def test_sketch_never_underestimates(spark):
    rows = [(prose(k, 30, 500), "en", "a") for k in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    want = {tuple(x) for x in D.term_counts(docs, least=5, width=1 << 16).select("term", "n").collect()}
    # a sketch that is full lets everything pass, and the exact count decides
    assert {tuple(x) for x in D.term_counts(docs, least=5, width=1 << 15).select("term", "n").collect()} == want
    plain = collections.Counter(w for t, _, _ in rows for w in set(re.findall(r"[a-z]+", t)))
    assert {t for t, _ in want} == {t for t, n in plain.items() if n >= 5}
    with pytest.raises(ValueError):
        D.term_counts(docs, least=300)


def test_shares_of_large_counts(spark):
    row = spark.createDataFrame([(10**15, 7 * 10**16, 10**7)], "n long, total long, v long").select(D.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 5) // (7 * 10**16 + 5 * 10**7)


# Toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_finds_what_a_plain_distance_finds():
    terms = {"abcde": 2.0, "abcdx": 3.0, "bcd": 1.0, "abcdefghijkl": 1.5, "éàüöß": 1.0}
    automaton, r = X.Automaton(terms), random.Random(1)
    words = {"", "a", *terms}
    for t in terms:
        for _ in range(400):
            w = list(t)
            for _ in range(r.randrange(4)):
                k, kind = r.randrange(len(w) + 1), r.randrange(3)
                w[k : k + (kind > 0)] = [r.choice("abcdexéü!")] if kind < 2 else []
            words.add("".join(w))
    for w in words:
        near = [(edits(w, t), -x, t) for t, x in terms.items() if w[:1] == t[:1] and edits(w, t) <= X.bound(t)]
        found = automaton.match(w)
        assert (found and (automaton.terms[found[0]], found[1])) == (min(near) and (min(near)[2], min(near)[0]) if near else None), w
    assert X.Automaton({}).match("abc") is None


def test_toxicity(spark, tmp_path):
    r, bad = random.Random(3), ["zorgling", "plonker", "muppethead"]
    texts = [prose(k, 40, 3000) for k in range(400)]
    for k in range(0, 400, 5):
        w = texts[k].split()
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(bad))
        texts[k] = " ".join(w)
    more = [
        None, "", "  \n", "you plonker, you zorgling", "YOU ZORGLING! You (plonker)...", "you zorg1ing and plomker", 'he said the word "plonker" is an insult', prose(999, 5000, 3000), "x" * 70 + " --- ###",
    ]
    rows = [(k, t, "score", 1) for k, t in enumerate([*texts, *more])] + [(None, "nobody", "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, label string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(k % 5 == 0)) for k in range(400)] + [(None, 1, 1), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in X.op12_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[None].held_out is False
    assert all(x.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for k, x in got.items() if k is not None)
    assert all(got[k].predicted == int(k % 5 == 0) for k in range(400))
    assert [got[400 + k].predicted for k in range(9)] == [0, 0, 0, 1, 1, 1, 0, 0, 0] and got[400].score == got[401].score
    docs = frame(spark, ["idiot", None])
    assert X.learn(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).curve == ()
    assert {x.score for x in X.scored(docs, X.Model()).collect()} == {0.0} and X.scored(docs.limit(0), X.Model()).count() == 0


# Conversation repair


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation after damage, in order."""
    seen, items = set(), []
    numbers = collections.Counter()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        numbers[fault] += 1
        items.append((role, text, fault))
    numbers["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(items))
    # least (cost, labels) by trying all edits with at most two Inserts at a place
    best = {("", 0): (0, "", [])}  # grammar state by last letter and number of turns
    fits = lambda last, x: x == "u" if last in ("", "s", "a") else x == "a"

    def inserts(now):
        for _ in range(2):
            for (last, n), (cost, labels, out) in list(now.items()):
                x, role = ("a", "assistant") if last == "u" else ("u", "user")
                key, new = (x, n + 1), (cost + 3, labels + "I", [*out, (role, "")])
                if key not in now or new[:2] < now[key][:2]:
                    now[key] = new
        return now

    for role, text, fault in items:
        after = {}

        def put(key, new, after=after):
            if key not in after or new[:2] < after[key][:2]:
                after[key] = new

        gone = fault in ("blank", "duplicate")
        for (last, n), (cost, labels, out) in inserts(dict(best)).items():
            put((last, n), (cost + 4, labels + "D", out))
            more = 3 * (fault == "truncated")
            if not gone and (fits(last, role[:1]) or last == "" and role[:1] == "s"):
                put((role[:1], n + 1), (cost + more, labels + "K", [*out, (role, text)]))
            if not gone:
                x, new = ("a", "assistant") if last == "u" else ("u", "user")
                put((x, n + 1), (cost + more + 3, labels + "R", [*out, (new, text)]))
        best = after
    ends = [v for (last, _), v in inserts(dict(best)).items() if last in ("", "a")]
    cost, labels, out = min(ends, key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    return gaps, numbers["blank"], numbers["duplicate"], numbers["truncated"], numbers["illegal"], cost, labels, digest


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


@pytest.mark.parametrize("part", [R.PART, 2])
def test_repairs(spark, monkeypatch, part):
    r, turns = random.Random(7), {}
    for conv in [None, *range(60)]:
        n = r.randrange(1, 9) if conv != 5 else 45
        role = lambda: r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""])
        text = lambda: r.choice(["", " \n", "Hello.", "What?", "no end", "same.", "same.", f"t{r.randrange(99)}!  "])
        turns[conv] = [(r.choice([None, *range(20)]) if conv % 3 == 0 else k, role(), text()) for k in range(n)] if conv is not None else [(1, "user", "a"), (1, "user", "a"), (None, "assistant", "b.")]
    rows = [(c, *x, "clash", 1) for c, xs in turns.items() for x in xs]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, n int").repartition(7)
    if part == 2:  # every part has a matrix from all four states
        folded = R._folded
        monkeypatch.setattr(R, "_folded", lambda schema: _with_part(folded(schema), part))
    found = R.repairs(df).persist()
    got = {x.conv: tuple(x[c] for c in COLUMNS) for x in found.collect()}
    digests = {x.conv: x.repaired_sha256 for x in R.repaired_digests(found, df).collect()}
    want = {c: plain_repair(in_order(xs)) for c, xs in turns.items()}
    assert {c: (*got[c], digests[c]) for c in got} == want
    lines = {}
    for x in R.repaired_turns(found, df).orderBy("conv", "place").collect():
        lines.setdefault(x.conv, []).append(f"{x.role}:{x.text}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == digests[c] for c in turns)
    empty = R.repairs(df.limit(0))
    assert empty.count() == 0 and R.repaired_digests(empty, df.limit(0)).count() == 0


def _with_part(run, size):
    def limited(batches):
        from lectern.llm import conversation_repair

        conversation_repair.PART = size
        return run(batches)

    return limited


def test_parts_multiply_like_one(monkeypatch):
    r = random.Random(9)
    for _ in range(200):
        items = [(r.choice(["s", "u", "a", "t"]), r.random() < 0.3) for _ in range(r.randrange(1, 9))]
        cut = r.randrange(len(items) + 1)
        whole = {R.START: (0, "")}
        for x in items:
            whole = R.step(whole, *x)
        first, second = {R.START: (0, "")}, {s: {s: (0, "")} for s in range(4)}
        for x in items[:cut]:
            first = R.step(first, *x)
        for x in items[cut:]:
            second = {s: R.step(row, *x) for s, row in second.items()}
        assert R.ended(R.product(first, second)) == R.ended(whole)


def test_damage(spark, tmp_path):
    rows = [(c, t, role, text) for c in range(40) for t, (role, text) in enumerate([("system", "Be brief."), ("user", "Hi there!"), ("assistant", "Yes?"), (None, None)])] + [(None, None, "user", "x."), (99, None, "user", "y.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want, word = {}, lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        kind, role, text = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20, word(role), word(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    got = {x.conv_id: tuple(x[k] for k in [*COLUMNS, "repaired_sha256"]) for x in R.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: plain_repair(in_order(xs)) for c, xs in want.items()}
