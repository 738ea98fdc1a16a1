import pytest
from pyspark.sql import functions as F

from lectern import queries as Q
from lectern.functions import columns as C
from lectern.functions import segments as S
from lectern.operators import library as L


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert value(spark, C.similarity_norm(lit("Hello, World!"))) == "hello world"
    assert value(spark, C.similarity_norm(lit("Mixed-Case_Text"))) == "mixed case_text"
    assert value(spark, C.similarity_norm(lit("don ' t"))) == "don't"
    assert value(spark, C.similarity_norm(lit(None).cast("string"))) == ""
    for a, b, want in (("hello", "hallo", 0.8), ("hello", "help", 0.6), ("abc", "def", 0.0), ("", "", 0.0), (None, "x", 0.0)):
        assert value(spark, C.levenshtein_ratio(lit(a).cast("string"), lit(b).cast("string"))) == pytest.approx(want)
    assert value(spark, C.text_similarity(lit("hello world"), lit("hello world again"))) == pytest.approx(11 / 17)
    assert value(spark, C.text_similarity(lit("hello"), lit("hello my dear friend"))) == 0.0
    assert value(spark, C.srt_time(lit(3723.9999))) == "01:02:03,999"
    assert value(spark, C.dedup_lines(lit("A\nb\n a \nB\nc"))) == "A\nb\nc"
    wrapped = value(spark, C.wrap(lit("one two three four five six seven"), 12)).split("\n")
    assert all(len(x) <= 12 for x in wrapped) and " ".join(wrapped) == "one two three four five six seven"
    assert [value(spark, C.valid_duration(lit(x))) for x in (0.0, -1.0, 5.0, 11.0)] == [3.0, 3.0, 5.0, 10.0]
    assert value(spark, C.video_id(lit("https://youtu.be/abcdefghijk"))) == "abcdefghijk"
    assert value(spark, C.ema(F.array(lit(0.5)))) == 0.5
    assert value(spark, C.ema(F.array(lit(1.0), lit(0.5)))) == pytest.approx(0.95)


@pytest.mark.parametrize(
    "text,want",
    [("the the the cat", "the cat"), ("I I I think so", "I think so"), ("very very good", "very very good"), ("I think I think it's good", "I think it's good"), ("you know you know what I mean", "you know what I mean"), ("thank you thank you very much", "thank you thank you very much"), ("um um um I think", "um I think"), ("", "")],
)
def test_repetitions(text, want):
    assert S.clean_repetitions(text, [])[0] == want


def test_streams_and_sentences(spark):
    rows = [(1, 0, "learn to do is instead of identifying with the"), (1, 1, "identifying with the mind, they learn to identify"), (2, 0, None), (2, 1, "Krishna")]
    got = {(r.stream, r.seq): r for r in L.clean_streams(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[1, 0].action == "kept" and got[1, 1].cleaned == "mind, they learn to identify" and got[2, 0].cleaned == ""
    assert [s["state"] for s in S.sentences("This is a test. And the")] == ["complete", "incomplete"]
    assert S.indel_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert S.ascii_fold("Kṛṣṇa") == "krsna" and S.ascii_fold("Bhagavān") == "bhagavan"


def test_fuzzy_corrections_find_every_near_term(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1]

    words = ["krishna", "krshna", "kirshna", "gta", "gita", "arjunaa", "xrjuna", "zzzzz", "mantraas", "dhrama", "ab"]
    terms = L.dictionary(spark)
    every = [(r.wrong, r.canonical, r.entry) for r in terms.collect()]
    got = {r.word: (r.canonical, r.distance) for r in L.fuzzy_corrections(spark.createDataFrame([(w,) for w in words], "word string"), terms).collect()}
    want = {}
    for w in words:
        near = sorted((distance(w, t), e, c) for t, c, e in every if len(w) >= 3 and distance(w, t) <= 2)
        if near:
            want[w] = (near[0][2], near[0][0])
    assert got == want


def test_fuzzy_corrections_keep_the_best_ratio(spark):
    def common(a, b):
        return 0 if not a or not b else common(a[1:], b[1:]) + 1 if a[0] == b[0] else max(common(a[1:], b), common(a, b[1:]))

    def within(a, b, most):
        if not a or not b:
            return len(a) + len(b) <= most
        return within(a[1:], b[1:], most) if a[0] == b[0] else most > 0 and any(within(x, y, most - 1) for x, y in ((a[1:], b), (a, b[1:]), (a[1:], b[1:])))

    words = ["gnu", "jara", "erie", "gta", "kirma", "dharna", "abxyefg", "yogx", "xkirtan", "mantraas", "abcde", "ab", "karm", "pqrstu"]
    entries = ["pqrstv", "pqrstuyz", "abcdefg", "abyzefg", "abxzyefg", *(r.wrong for r in L.dictionary(spark).orderBy("entry").collect())]
    terms = spark.createDataFrame([(t, t.upper(), i) for i, t in enumerate(entries)], "wrong string, canonical string, entry int")
    got = {r.word: r.wrong for r in L.fuzzy_corrections(spark.createDataFrame([(w,) for w in words], "word string"), terms).collect()}
    want = {}
    for w in words:
        near = sorted((-200 * common(w, t) / (len(w) + len(t)), i, t) for i, t in enumerate(entries) if len(w) >= 3 and within(w, t, 2) and 10 * common(w, t) >= 4 * (len(w) + len(t)))
        if near:
            want[w] = near[0][2]
    assert got == want
    assert not {"gnu", "jara", "erie"} & set(got) and got["abxyefg"] == "abxzyefg" and got["karm"] == "karm" and got["pqrstu"] == "pqrstuyz"


def test_range_join_equals_the_plain_condition(spark):
    points = spark.createDataFrame([(i / 3,) for i in range(60)], "t double")
    spans = spark.createDataFrame([(k, k * 1.7, k * 1.7 + (k % 5)) for k in range(12)], "k int, s double, e double")
    got = {(r.t, r.k) for r in L.range_join(points, spans, "t", "s", "e", 2.0).collect()}
    assert got == {(r.t, r.k) for r in points.join(spans, F.expr("s <= t AND t <= e")).collect()}


def test_glossary(spark):
    rows = [(0, "Krishna speaks to Arjuna.", 2, "test"), (1, "krishna  speaks to arjuna.", 3, "other"), (2, "About Krishna", 2, "test")]
    got = {r.token: r for r in L.glossary(spark.createDataFrame(rows, "seq long, text string, chapter int, source string"), "text", "seq", "chapter", "source").collect()}
    assert got["Krishna"].n == 2 and got["Krishna"].chapters == [2] and got["Krishna"].sources == ["test"]
    assert got["Krishna"].contexts == ["Krishna speaks to Arjuna.", "About Krishna"] and "to" not in got


def test_captions_meet_every_frame_of_a_long_conversation(spark, tmp_path):
    turns = [(c, n, " ".join(["w"] * (3 + 5 * ((n + c) % 5)))) for c, last in ((1, 30), (2, 3), (3, 8)) for n in range(last)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    fades, latest = {}, {}
    for c, n, x in turns:
        s = n * 2.5
        e = s + min(4.0, max(1.5, len(x.split(" ")) / 4))
        for frame in range(1000):
            t = frame / 4
            if s <= t <= e:
                fades[c, n, frame] = round(max(0.1, min(1.0, (t - s) / 0.1, (e - t) / 0.1)), 6)
                latest[c, frame] = max(n, latest.get((c, frame), 0))
    assert {(r.conv_id, r.id, r.frame): r.fade for r in Q.caption_active_frames(spark, str(tmp_path)).collect()} == fades
    assert {(r.conv_id, r.frame): r.latest for r in Q.latest_caption_asof(spark, str(tmp_path)).collect()} == latest


def plain_phrases(text, longest=5, alike=0.8):
    """``collapse_phrases`` without bounds: every pair is compared."""
    words, cuts = text.split(), []
    for n in range(2, min(longest + 1, len(words) // 2)) if len(words) >= 4 else ():
        i = 0
        while i + 2 * n <= len(words):
            a, b = words[i : i + n], words[i + n : i + 2 * n]
            x, y = (" ".join(S._bare(w) for w in own) for own in (a, b))
            near = 1.0 if a == b else 0.95 if [S._bare(w) for w in a] == [S._bare(w) for w in b] else S.seq_ratio(x, y)
            if near >= alike and " ".join(a).lower() not in S.EMPHATIC:
                del words[i + n : i + 2 * n]
                cuts.append(near)
            else:
                i += 1
    return (" ".join(words) if len(text.split()) >= 4 else text), cuts


def test_bounds_of_phrases_change_no_result(monkeypatch):
    import random

    draw = random.Random(3)
    words = ["so", "the", "the,", "no", "very", "a", "Krishna", "krishna", "hare", "um", "one", "two", "ones", "twos", "..", "é", "zebra"]
    texts = [" ".join(draw.choice(words[: draw.randint(2, 17)]) for _ in range(draw.randint(0, 30))) for _ in range(400)]
    assert [S.collapse_phrases(t) for t in texts] == [plain_phrases(t) for t in texts]
    for a, b in zip(texts, texts[1:], strict=False):
        whole = S.seq_ratio(a, b)
        assert S.ratio_from(a, b, 0.6) in (whole, 0.0 if whole < 0.6 else whole)
    # few pairs are compared character by character
    seen = []
    monkeypatch.setattr(S, "_phrase_likeness", lambda *own: seen.append(own) or 0.0)
    S.collapse_phrases(" ".join(f"{chr(97 + k % 26) * 5}{k}" for k in range(200)))
    assert len(seen) < 40


def test_heavy_rows_are_dealt_to_more_tasks_than_a_table_has_parts(spark):
    from lectern.operators.streams import spread

    for parts in (1, 6):
        assert spread(spark.range(100).repartition(parts)).rdd.getNumPartitions() >= max(4, 4 * parts)
