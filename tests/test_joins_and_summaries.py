"""As-of and fuzzy joins, summaries, dealt tables, functions on tables and pages against brute force; their plans."""

import collections
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import queries as Q
from lectern import queries_tables as QT
from lectern.functions import aggregates as A
from lectern.functions import segments as S
from lectern.operators import corpus as K
from lectern.operators import correction as X
from lectern.operators import library as L
from lectern.operators import neighbourhood as N
from lectern.operators import summaries as SM
from lectern.operators.asof import asof_join
from lectern.sources import pages as P
from lectern.streaming import metrics as ME

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# As-of join


def plain_asof(left, right, within, equal):
    out = []
    for key, t, name in left:
        met = [r for r in right if key is not None and t is not None and r[0] == key and r[1] is not None and (r[1] <= t if equal else r[1] < t)]
        best = max(met, key=lambda r: (r[1], r[2]), default=None)
        out.append((name, best[2] if best and (within is None or t - best[1] <= within) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("within,equal,span", [(None, True, 7.0), (None, False, 100.0), (5.0, True, 3.0), (0.5, False, 1.0)])
def test_asof(spark, within, equal, span):
    r = random.Random(4)
    left = [(r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *(k / 2 for k in range(-40, 120))]), k) for k in range(300)]
    right = [(r.choice(["hot", "hot", "a", "c", None]), r.choice([None, *(k / 2 for k in range(-40, 120))]), k) for k in range(150)]
    a = spark.createDataFrame(left, "key string, t double, name int").repartition(5)
    b = spark.createDataFrame(right, "key string, at double, other int").repartition(3)
    got = asof_join(a, b, ["key"], "t", "at", span, within, equal)
    assert sorted(((x.name, x.other) for x in got.collect()), key=str) == plain_asof(left, right, within, equal)
    assert asof_join(a.limit(0), b, ["key"], "t", "at", span).count() == 0
    assert asof_join(a, b.limit(0), ["key"], "t", "at", span).filter("other IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        asof_join(a, a.withColumnRenamed("t", "at"), ["key"], "t", "at", span)


def test_asof_splits_a_hot_key_and_moves_rows_once(spark):
    rows = spark.range(20000).select(F.lit("hot").alias("key"), F.col("id").cast("double").alias("t"))
    right = spark.range(0, 20000, 7).select(F.lit("hot").alias("key"), F.col("id").cast("double").alias("at"), "id")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = asof_join(rows, right, ["key"], "t", "at", 500.0)
        shown = plan(out)
        # rows and what earlier spans hand on meet on (key, span): the rows' exchange is the window's
        big = [x for x in shown.split("\n") if "Exchange hashpartitioning(key" in x and "_span" in x]
        assert out.filter("id <> t - t % 7").count() == 0 and out.filter("id IS NULL").count() == 0
        window = shown[: shown.index("SortMergeJoin")].count("Exchange")
        assert window == 0 and len(big) >= 2
        parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own[0])
        spark.conf.set("spark.sql.adaptive.enabled", own[1])


# Likeness


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def some_words(seed, n):
    r = random.Random(seed)
    base = ["krishna", "arjuna", "dharma", "yoga", "été", "abc", "ab", "a", "übermensch", "sanskrit"]
    out = set(base)
    while len(out) < n:
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            k, kind = r.randrange(len(w) + 1), r.randrange(3)
            w[k : k + (kind > 0)] = [r.choice("abnüy")] if kind < 2 else []
        out.add("".join(w))
    return sorted(out)


def test_fuzzy_join(spark):
    left, right = some_words(1, 150), some_words(2, 90)
    most = lambda n: 0 if n < 3 else 1 if n < 6 else 2
    want = {(a, b, distance(a, b)) for a in left for b in right if distance(a, b) <= most(min(len(a), len(b)))}
    a, b = (spark.createDataFrame([(w,) for w in [*ws, None, ws[0]]], f"{c} string") for ws, c in ((left, "word"), (right, "term")))
    assert sorted(map(tuple, N.fuzzy_join(a, b, "word", "term").collect())) == sorted(want)
    assert N.fuzzy_join(a.limit(0), b, "word", "term").count() == 0


@pytest.mark.parametrize("least", [80.0, 60.0])
def test_corrections_by_neighbourhoods(spark, least):
    words, terms = some_words(3, 200), some_words(4, 40)
    entries = [(t, t.title(), k) for k, t in enumerate(terms)]
    want = {}
    for w in words:
        near = [(-S.indel_ratio(w, t), k, t, c, distance(w, t)) for t, c, k in entries if len(w) >= 3 and distance(w, t) <= 2 and S.indel_ratio(w, t) >= least]
        if near:
            ratio, k, t, c, d = min(near)
            want[w] = (t, c, k, d, pytest.approx(-ratio))
    df = spark.createDataFrame([(w,) for w in words * 2], "word string")
    got = {r.word: tuple(r)[1:] for r in N.corrections(df, spark.createDataFrame(entries, "wrong string, canonical string, entry int"), least=least).collect()}
    assert got == want


def test_indel_ratios_at_once():
    words = [*some_words(5, 60), "", "x" * 80, "日本語🙂"]
    for term in ["krishna", "a", "été🙂", "", "y" * 70, "ab" * 31]:
        assert S.indel_ratios(words, term) == pytest.approx([S.indel_ratio(w, term) for w in words])
    assert S.indel_ratios(["a\0b"], "ab") == pytest.approx([S.indel_ratio("a\0b", "ab")])


def test_suggestions(spark):
    words, terms = some_words(6, 40), some_words(7, 15)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = collections.defaultdict(list)
    for r in X.suggestions(df, spark.createDataFrame([(t, t, k) for k, t in enumerate(terms)], "wrong string, canonical string, entry int")).orderBy("word", "rank").collect():
        got[r.word].append((r.canonical, round(r.score, 6)))
    for w in words:
        want = sorted(((-S.indel_ratio(w, t), k, t) for k, t in enumerate(terms) if w and S.indel_ratio(w, t) >= 50))[:5]
        assert got[w] == [(t, round(-s, 6)) for s, _, t in want]


# Summaries


def test_percentiles(spark):
    r = random.Random(8)
    groups = {"same": [3.0] * 50, "one": [7.5], "wide": [r.lognormvariate(0, 8) * r.choice([-1, 1]) for _ in range(700)], "near": [1.0 + k * 2.0**-52 for k in range(64)], None: [float("-inf"), 0.0, float("inf"), float("nan")] * 3}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("same", None), ("only null", None)]
    shares = [0.0, 0.01, 0.5, 0.75, 1.0]
    got = {(x.g, x.share): x.value for x in SM.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(6), "v", ["g"], shares, buckets=8).collect()}
    want = {}
    for g, vs in groups.items():
        ordered = sorted(float("inf") if v != v else v for v in vs)
        want |= {(g, p): ordered[max(1, int(np.ceil(p * len(vs)))) - 1] for p in shares}
    assert got == want
    assert SM.percentiles(spark.createDataFrame(rows, "g string, v double").limit(0), "v", ["g"], shares).count() == 0


def test_sketches_merge_like_one(spark):
    df = spark.range(30000).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 9973).alias("x"), F.rand(1).alias("y"))
    stored = SM.sketches(df, ["a", "b"], "x", "y").persist()
    up = SM.rolled_up(stored, ["a", "b"]).select("a", "b", "level", "n", F.hll_sketch_estimate("seen").alias("seen"), F.kll_sketch_get_quantile_double("spread", F.lit(0.5)).alias("median")).collect()
    assert len(up) == 15 + 3 + 1 and sum(r.n for r in up if r.level == 2) == 30000
    top = next(r for r in up if r.level == 0)
    assert top.n == 30000 and abs(top.seen - 9973) < 0.03 * 9973 and abs(top.median - 0.5) < 0.02
    direct = df.agg(F.hll_sketch_estimate(F.hll_sketch_agg("x", SM.REGISTERS)).alias("n")).first().n
    assert abs(top.seen - direct) <= 1


def test_skewness_states_merge(spark):
    r = np.random.default_rng(2)
    values = {"a": r.exponential(2, 500), "b": r.normal(1e6, 1, 300), None: np.array([1.0, 2.0, 9.0]), "flat": np.full(4, 2.0), "one": np.array([5.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("null", None)]
    got = {x.k: (x.n, x.skewness) for x in A.skewness(spark.createDataFrame(rows, "k string, v double").repartition(7), "v", "k").collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        spread = ((vs - vs.mean()) ** 2).mean()
        assert got[k] == (len(vs), pytest.approx(((vs - vs.mean()) ** 3).mean() / spread**1.5, abs=1e-6) if spread else None)
    a, b = values["a"][:123], values["a"][123:]
    assert A.merge(A._state(a), A._state(b)) == pytest.approx(A._state(values["a"]))


def test_stratified_draws_the_same_rows_again(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("s"))
    one, two = (SM.stratified(df.repartition(n), "s", "id", {"x": 0.25, "z": 1.0}).select("id").collect() for n in (2, 9))
    assert sorted(one) == sorted(two) and 400 < len(one) < 600 and all(r.id % 2 == 0 for r in one)


# Plans


def test_tables_dealt_by_a_key_join_without_an_exchange(spark):
    orders, lines = QT.co_partitioned(spark, SF)
    shown = plan(orders.hint("merge").join(lines, orders.o_orderkey == lines.l_orderkey))
    assert "SortMergeJoin" in shown and "Exchange" not in shown


def test_buckets_grow_with_the_tables(spark, tmp_path, monkeypatch):
    small, large = (Q.table(spark, sf, "lineitem") for sf in (SF, "/root/testdata/sf0.01"))
    assert QT.buckets_for(small) == 8 == QT.buckets_for(small, spark.range(1))
    monkeypatch.setattr("lectern.sinks.bucketed.BUCKET", 50_000)
    assert QT.buckets_for(small, large) == QT.buckets_for(large, small) > 2 * 8
    orders, lines = QT.co_partitioned(spark, "/root/testdata/sf0.01")
    shown = plan(orders.hint("merge").join(lines, orders.o_orderkey == lines.l_orderkey))
    assert "SortMergeJoin" in shown and "Exchange" not in shown


def test_equal_texts_are_cut_down_before_they_move(spark):
    docs = Q.table(spark, SF, "documents")
    shown = plan(L.first_of_equal(docs, "text", "doc_id"))
    assert "WindowGroupLimit" in shown and shown.rindex("WindowGroupLimit") > shown.rindex("Exchange")


def test_correlated_queries_become_joins(spark):
    assert "Join" in plan(QT.above_nation_average(spark, SF)) and "Join" in plan(QT.largest_orders_lateral(spark, SF))


def test_vocabulary_numbers(spark):
    terms = spark.createDataFrame([("a", "a", 3, [1, 2], ["s"]), ("É", "e", 1, [2], ["s", "t"]), ("b", "b", 2, [], ["t"])], "token string, ascii string, n long, chapters array<int>, sources array<string>")
    r = K.stats(terms).first()
    assert (r.unique_tokens, r.total_occurrences, r.mean, list(r.chapters), list(r.sources), r.marked) == (3, 6, 2.0, [1, 2], ["s", "t"], 1)
    r = K.stats(terms.limit(0)).first()
    assert (r.unique_tokens, r.total_occurrences, r.mean, list(r.chapters), list(r.sources)) == (0, 0, None, [], [])


# Functions on tables, numbers observed


def test_machines_from_sql_equal_folded_streams(spark):
    got = QT.cleaned_by_sql(spark, SF)
    want = Q.QUERIES["cross_segment_clean"](spark, SF)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="no such machine"):
        spark.sql("SELECT * FROM run_machine(TABLE (SELECT 1 AS a) PARTITION BY a ORDER BY (a), 'unknown', '')").collect()


def test_means_seeded_by_the_first_value_other_than_zero(spark):
    rows = [("a", k, v) for k, v in enumerate([0.0, 0.0, 2.0, None, 4.0, 1.0])] + [("zero", 0, 0.0), ("none", 0, None)]
    got = {r.k: r.ema for r in L.last_mean(spark.createDataFrame(rows, "k string, at int, v double"), "k", ["at"], "v").collect()}
    assert got == {"a": pytest.approx(0.9 * (0.9 * 2 + 0.1 * 4) + 0.1 * 1), "zero": 0.0}


def test_observed_counters_need_no_pass_of_their_own(spark):
    rows = spark.createDataFrame([("x", 1.5), ("y", 2.0), ("x", 0.5)], "strategy string, took double")
    counted, seen = ME.policy_counters(rows, "n", "strategy", ["x", "y", "z"], "took")
    assert counted.count() == 3
    assert seen.get == {"x_applied": 2, "x_seconds": 2.0, "y_applied": 1, "y_seconds": 2.0, "z_applied": 0, "z_seconds": 0.0}


# Pages


def test_retries_wait_longer_each_time():
    waits, left = [], [3]

    def flaky():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("no")
        return "page"

    assert P.retried(flaky, wait=waits.append) == ("page", 4) and waits == [1.0, 2.0, 4.0]
    waits.clear()

    def never():
        raise P.Refused(404)

    assert P.retried(never, wait=waits.append) == (None, 5) and waits == [1.0, 2.0, 4.0, 8.0]
    waits.clear()

    def busy():
        raise P.Refused(429)

    assert P.retried(busy, tries=8, wait=waits.append) == (None, 8) and waits == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 60.0, 60.0]


def test_page_folder(spark, tmp_path, monkeypatch):
    P.register(spark)
    folder = tmp_path / "pages"
    assert spark.read.format("page_folder").option("path", str(folder)).load().count() == 0
    folder.mkdir()

    def put(name, *pages):
        (folder / name).write_text("\n".join(json.dumps({"url": u, "html": h}, ensure_ascii=False) for u, h in pages) + "\n\n")

    put("a.json", ("u1", "<p>é\n</p>"), ("u2", None))
    put("b.json", ("u3", ""))
    put("_hidden", ("u", "x"))
    rows = spark.read.format("page_folder").option("path", f"file://{folder}").load()
    assert sorted(map(tuple, rows.collect()), key=str) == [("u1", "<p>é\n</p>", "a.json", 1), ("u2", None, "a.json", 1), ("u3", "", "b.json", 1)]
    assert rows.rdd.getNumPartitions() == 2
    # a file that can't be read gives a row that says so
    (folder / "c.json").symlink_to(tmp_path / "gone")
    left = spark.read.format("page_folder").option("path", str(folder)).option("tries", 2).option("wait", 0).option("opener", "lectern.sources.pages:opened").load()
    assert [tuple(r) for r in left.filter("file = 'c.json'").collect()] in ([], [(None, None, "c.json", 2)])


def test_a_file_passes_in_pieces_and_goes_on_after_a_failure(tmp_path, monkeypatch):
    pages = [(f"u{k}", None if k == 5 else "é" * 40) for k in range(50)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"url": u, "html": h}) for u, h in pages) + "\n\n")
    monkeypatch.setattr(P, "PIECE", 500)
    whole = list(P._Pages({"path": str(tmp_path)}).rows("a.json"))
    assert len(whole) > 10 and max(b.num_rows for b in whole) < 8
    assert [(r["url"], r["html"], r["tries"]) for b in whole for r in b.to_pylist()] == [(u, h, 1) for u, h in pages]
    left = [2]

    def failing(path):
        for k, line in enumerate(P.opened_lines(path)):
            if k == 20 and left[0] > 0:
                left[0] -= 1
                raise OSError("gone")
            yield line

    monkeypatch.setattr(P, "failing", failing, raising=False)
    for fails, rest in ((2, 30), (99, 0)):
        left[0] = fails
        got = [r for b in P._Pages({"path": str(tmp_path), "opener": "lectern.sources.pages:failing", "wait": "0", "tries": "3"}).rows("a.json") for r in b.to_pylist()]
        if rest:
            assert [(r["url"], r["html"]) for r in got] == pages and got[0]["tries"] == 1 and got[-1]["tries"] == 3
        else:
            assert got[-1] == {"url": None, "html": None, "file": "a.json", "tries": 3} and [(r["url"], r["html"]) for r in got[:-1]] == pages[: len(got) - 1]


def test_page_folder_as_a_stream(spark, tmp_path):
    P.register(spark)
    folder, out = tmp_path / "pages", str(tmp_path / "out")
    folder.mkdir()
    for k, names in enumerate((["1.json", "2.json"], ["3.json"], [])):
        for n in names:
            (folder / n).write_text(json.dumps({"url": n, "html": "x"}))
        stream = spark.readStream.format("page_folder").option("path", str(folder)).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["1.json", "2.json", "3.json"][: 2 + (k > 0)]
