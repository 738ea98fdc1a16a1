"""Empty tables, clashing columns, null keys, damaged records; language fusion and the network's gradient by brute force."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints, html_text, language, masked_lm, quality, sentencepiece_codec, substrings, warc
from lectern.llm import queries as corpus
from test_operators import TEXTS, frame

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(corpus.QUERIES))
def test_queries_of_empty_tables(spark, empty, name):
    out = corpus.QUERIES[name](spark, empty)
    assert out.columns and out.count() == 0


def test_columns_that_clash(spark):
    names = "text string, lang string, post array<int>, ll string, host string, score int, record string, digest string, sha1 string, payload string, row int"
    extra = ["t", "en", [1], "x", "h", 1, "r", "d", "s", "p", 1]
    pages = spark.createDataFrame([(k, u, h, *extra) for k, u, h in [(1, "http://a.de/", "<html lang=de><article><p>der hund</p></article>"), (None, None, None), (3, "::", "")]], "page_id long, url string, html string, " + names)
    docs = spark.createDataFrame([("der hund und das haus", "de"), ("the dog and the house", "en"), ("no language", None)], "text string, lang string")
    got = html_text.extracted(pages).select("row.page_id", "text").collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, "der hund"), (3, "")]
    got = {r.page_id: r for r in language.identified(pages, docs).collect()}
    assert len(got) == 3 and got[1].lang == "de" and got[None].host == got[3].host == "" and all(0 < r.probability <= 1 for r in got.values())


def test_damaged_payloads_are_found(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame([(1, "u", "x" * 2000, "clash"), (2, "v", "y" * 10, "clash")], "page_id long, url string, html string, digest string")
    warc.archive(pages, path)
    assert len(warc.records_of(spark, path).collect()) == 2
    rows = spark.read.parquet(f"{path}/payloads")
    spoilt = rows.withColumn("payload", F.when(F.octet_length("payload") > 100, F.encode(F.lit("z" * 2000), "UTF-8")).otherwise(F.col("payload")))
    whole = spoilt.toPandas()
    spark.createDataFrame(whole, rows.schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="(?i)digest|payload"):
        warc.records_of(spark, path).collect()


def test_repeated_rows_score_alike(spark):
    rows = frame(spark, [*TEXTS, *TEXTS], [k % len(TEXTS) for k in range(2 * len(TEXTS))])
    assert substrings.remove_repeats(rows).count() == 2 * len(TEXTS)
    assert fingerprints.fingerprint_edits(rows).count() == 2 * len(TEXTS)
    got = collections.defaultdict(set)
    for r in sentencepiece_codec.encoded(rows).collect():
        got[r.row.doc_id].add(tuple(r.ids))
    assert all(len(v) == 1 for v in got.values()) and len(got) == len(TEXTS)
    scores = collections.defaultdict(set)
    for r in masked_lm.scored(rows, masked_lm.train(rows)).collect():
        scores[r.row.doc_id].add(round(r.log_likelihood, 3))
    assert all(len(v) == 1 for v in scores.values())
    assert quality.scored(rows.limit(0), quality.train(rows.limit(0), spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


# Language


def plain_mix(z):
    whole = (1 << 64) - 1
    z ^= z >> 30
    z = z * 0xBF58476D1CE4E5B9 & whole
    z ^= z >> 27
    z = z * 0x94D049BB133111EB & whole
    return z ^ z >> 31


def plain_trigrams(text):
    low = [b + 32 if 65 <= b <= 90 else 32 if b < 65 else b for b in (text or "").encode()]
    return [plain_mix(a | b << 8 | c << 16) % language.BUCKETS for a, b, c in zip(low, low[1:], low[2:], strict=False)]


def plain_language(pages, docs, strength=language.STRENGTH):
    langs = sorted({x for _, x in docs if x is not None})
    models = {}
    for x in langs:
        n = collections.Counter(b for t, y in docs if y == x for b in plain_trigrams(t))
        total = sum(n.values()) + 0.5 * language.BUCKETS
        models[x] = lambda b, n=n, total=total: math.log((n[b] + 0.5) / total)
    rows = []
    for i, url, page in pages:
        text, declared = language.seen(page)
        grams = plain_trigrams(text)
        ll = {x: language.TEMPER * sum(models[x](b) for b in grams) for x in langs}
        top = max(ll.values())
        post = {x: math.exp(ll[x] - top) for x in langs}
        post = {x: v / sum(post.values()) for x, v in post.items()}
        host, domain, suffix = language.address(url)
        rows.append({"id": i, "ll": ll, "post": post, "host": host, "domain": domain, "suffix": suffix, "declared": declared})
    out = {}
    for r in rows:
        others = [o for o in rows if o is not r]

        def count(x, key=None, others=others, r=r):
            return sum(o["post"][x] for o in others if key is None or o[key] == r[key])

        def size(key=None, others=others, r=r):
            return sum(key is None or o[key] == r[key] for o in others)

        score = {}
        for x in langs:
            overall = (count(x) + 1) / (size() + len(langs))
            domain = (count(x, "domain") + strength * overall) / (size("domain") + strength)
            host = (count(x, "host") + strength * domain) / (size("host") + strength)
            score[x] = r["ll"][x] + math.log(host)
            for key in ("suffix", "declared"):
                score[x] += math.log((count(x, key) + 1) / (count(x) + len({o[key] for o in rows}) + 1))
        best = max(langs, key=lambda x: (score[x], [-ord(c) for c in x]))
        out[r["id"]] = (best, 1 / sum(math.exp(v - score[best]) for v in score.values()), max(langs, key=lambda x: r["post"][x]), r["declared"], r["host"])
    return out


def test_language_fusion(spark):
    texts = {"de": "der hund und die katze sind im haus und nicht im garten", "en": "the dog and the cat are in the house and not in the garden", "fr": "le chien et le chat sont dans la maison et pas dans le jardin"}
    docs = [(t, x) for x, t in texts.items() for _ in range(3)] + [("ohne sprache", None), (None, "en")]
    pages, r = [], np.random.default_rng(3)
    for k in range(40):
        lang = ["de", "en", "fr"][k % 3]
        words = texts[lang].split()
        text = " ".join(r.choice(words, 2 + k % 7)) if k % 5 else ""
        declared = lang if k % 4 else "en" if k % 8 else ""
        host = ["www.a.de", "b.a.de", "c.co.fr", "d.org", ""][k % 5]
        pages.append((k, f"http://{host}/{k}" if host else None, f"<html lang='{declared}'><body><p>{text}</p></body>"))
    pages += [(100, None, None), (101, "http://[broken", ""), (102, "http://www.a.de/", "")]
    got = {x.page_id: (x.lang, x.probability, x.text_lang, x.declared, x.host) for x in language.identified(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), spark.createDataFrame(docs, "text string, lang string")).collect()}
    want = plain_language(pages, docs)
    assert set(got) == set(want)
    for i, x in want.items():
        assert (got[i][0], *got[i][3:]) == (x[0], *x[3:]), i
        assert got[i][1] == pytest.approx(x[1], rel=1e-6), i


# Masked language model


def test_gradient_of_the_network():
    r = np.random.default_rng(4)
    net = masked_lm.start(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    net.flat = net.flat.astype(np.float64)
    token, context = r.integers(0, masked_lm.SIZE, 60), r.integers(0, masked_lm.SIZE + 1, (len(masked_lm.PLACES), 60))

    def loss(flat):
        own = masked_lm.Net(flat, net.known, net.token)
        return -masked_lm.forward(own.parts(), context, token)[0].mean()

    # the first step of Adagrad from large sums of squares is the gradient, scaled
    before, grad2 = net.flat.copy(), np.full(len(net.flat), 1e12)
    masked_lm.step(net, grad2, context, token)
    gradient = (before - net.flat) / masked_lm.RATE * 1e6
    places = np.concatenate((r.choice(np.flatnonzero(np.abs(gradient) > 1e-3), 60, replace=False), r.integers(0, len(before), 20)))
    for k in places.tolist():
        up, down = before.copy(), before.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(gradient[k], rel=0.02, abs=2e-5)


def test_masked_lm_learns(spark):
    docs = frame(spark, [" ".join(["red", "blue", "green"][(k + s) % 3] for k in range(300)) for s in range(30)])
    net = masked_lm.train(docs)
    ordered = frame(spark, [" ".join(["red", "blue", "green"] * 20), " ".join(["red", "red", "green", "blue", "blue", "green"] * 10)])
    got = {r.row.doc_id: r.log_likelihood / r.n_tokens for r in masked_lm.scored(ordered, net, counts=masked_lm.word_counts(docs)).collect()}
    assert got[0] > got[1] + 0.5 and got[0] > math.log(1 / 3) + 0.5
