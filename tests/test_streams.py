"""Ordered state machines: finished streams against the fixtures, live ones against finished ones; windows; jobs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.functions import machines as M
from lectern.functions import segments as S
from lectern.functions import udfs as U
from lectern.operators import captions as CP
from lectern.operators import corpus as K
from lectern.operators import correction as X
from lectern.operators import library as L
from lectern.operators import streams as T
from lectern.plans import jobs
from lectern.sinks import files as sinks
from lectern.sources import files as sources
from lectern.streaming import live


def cleaned(*texts):
    history: list = []
    return [S.clean_against_history(t, history) for t in texts]


def test_segments_of_the_fixtures():
    a, b = cleaned("learn to do is instead of identifying with the", "identifying with the mind, they learn to identify")
    assert a[1] == "kept" and b[:2] == ("mind, they learn to identify", "cleaned")
    a, b = cleaned("They learn to identify the mind", "They learn to identify the mind.")
    assert b[1] in ("removed", "cleaned") and S.history_confidence("They learn to identify the mind.", b[0], b[2]) > 0.8
    assert cleaned("  kept text  ", "")[0][0] == "kept text" and cleaned("")[0] == ("", "kept", [])
    # five empty results push the first segment out of the window, so the seventh copy is kept again
    out = cleaned(*["one two three four five"] * 8)
    assert [x[0] != "" for x in out] == [True, False, False, False, False, False, True, False]


def machine_rows(machine, rows):
    state, out = machine.start(), []
    for r in rows:
        out += machine.step(state, r)
    return out


def test_folded_streams_equal_the_machine_and_span_batches(spark):
    rows = [(k % 3 if k % 7 else None, k, f"w{k} and some words {k % 4}") for k in range(300)]
    df = spark.createDataFrame(rows, "conv long, seq long, item string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {(r.conv, r.seq): (r.event, r.dropped, r["size"]) for r in T.folded(df, "conv", ["seq"], M.BoundedBuffer(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for conv in (None, 0, 1, 2):
        held = []
        for c, seq, item in rows:
            if c == conv:
                held.append(item)
                want[c, seq] = ("dropped oldest", held.pop(0), 5) if len(held) > 5 else ("added", None, len(held))
    assert got == want
    assert T.folded(df.limit(0), "conv", ["seq"], M.BoundedBuffer(5)).count() == 0


def test_small_machines():
    class R:
        def __init__(self, **k):
            self.__dict__.update(k)

    at = [0.0, 1.0, 4.9, 5.0, 7.0, 10.5, None]
    assert [x[0] for x in machine_rows(M.RateLimiter(5.0), [R(at=x) for x in at])] == [True, False, False, True, False, True, False]
    assert [x[0] for x in machine_rows(M.MovingMean(), [R(value=x) for x in (0.0, 1.0, 0.5, None)])] == pytest.approx([0.0, 1.0, 0.95, 0.95])
    assert [x[0] for x in machine_rows(M.WordWindow(3), [R(text=x) for x in ("a b", None, "c d")])] == ["", "a b", "a b"]
    assert machine_rows(M.BoundedBuffer(1), [R(item="a"), R(item="b", warm_up=True), R(item="c")]) == [("added", None, 1), ("skipped", "b", 1), ("dropped oldest", "a", 1)]


def test_caption_timeline():
    class R:
        def __init__(self, text, start_time, end_time, now):
            self.text, self.start_time, self.end_time, self.now = text, start_time, end_time, now

    rows = [
        R("we speak about the nature of things", 0.0, 9.0, 0.5), R("the nature of things again", 1.0, 2.0, 1.2), R("", 1.0, 2.0, 1.0), R("subscribe now", 5.0, 6.0, 5.0),
        R("Diana — yoga leads further on", 6.0, None, 6.0), R("too late for this picture", 7.0, 8.0, 20.0), R("too early for this picture", 90.0, 91.0, 20.0),
    ]
    out = machine_rows(M.CaptionTimeline(), rows)
    assert [x[0] for x in out] == ["added", "duplicate", "blank", "bogus", "added", "out of time", "out of time"]
    assert out[0][1:5] == (1, "we speak about the nature of things", 0.0, 4.0) and out[4][1:5] == (2, "Dhyāna - yoga leads further on", 6.0, 8.0)
    assert out[3][5] == 1 and [x[5] for x in out[5:]] == [1, 0]


@pytest.mark.parametrize("machine,columns", [(M.SegmentCleaner("MODERATE"), "text"), (M.BoundedBuffer(3), "text as item")])
def test_live_equals_finished(spark, tmp_path, machine, columns):
    for k, v in live.STATE_STORE.items():
        spark.conf.set(k, v)
    rows = [(c, n, f"segment {n // 2} of stream {c} says some words {n % 3}") for c in range(4) for n in range(12)]
    df = spark.createDataFrame(rows, "conv long, seq long, text string").selectExpr("conv", "seq", columns)
    for part in range(3):  # three micro-batches, each stream in order
        df.filter(f"seq div 4 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.live(stream, "conv", ["seq"], machine).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = sorted(map(repr, spark.table("live").collect()))
    assert got == sorted(map(repr, T.folded(df, "conv", ["seq"], machine).collect())) and len(got) == len(rows)


def test_live_windows_drop_what_is_late(spark, tmp_path):
    def batch(name, seconds):
        rows = [(f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", "a") for s in seconds]
        spark.createDataFrame(rows, "ts string, kind string").selectExpr("to_timestamp_ntz(ts) ts", "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)

    for k, seconds in enumerate([range(0, 100, 10), [300], [20], [600]]):
        batch(k, seconds)
    src = lambda: live.timed(spark.readStream.schema("ts timestamp_ntz, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "ts")
    made = {"tumbling": live.tumbling(src(), "ts", "1 minute", "kind"), "sliding": live.sliding(src(), "ts", "5 seconds", "3500 milliseconds", "kind"), "sessions": live.sessions(src(), "ts", "30 seconds", "kind")}
    got = {}
    for name, df in made.items():
        q = df.writeStream.format("memory").queryName(f"w_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        got[name] = sorted((str(r.start)[14:19], r.n) for r in spark.table(f"w_{name}").collect())
        assert name != "tumbling" or live.dropped_late(q) == 1
    assert got["tumbling"] == [("00:00", 6), ("01:00", 4), ("05:00", 1)] and ("00:00", 10) in got["sessions"]
    batch_form = spark.read.parquet(f"{tmp_path}/in").filter("ts <> to_timestamp_ntz('2024-01-01 00:00:20') AND ts < to_timestamp_ntz('2024-01-01 00:09:00')")
    assert sum(n for _, n in got["tumbling"]) == batch_form.count() + 1


def test_profanity():
    f = S.filter_profanity
    assert f("A clean text .") == ("A clean text.", [], 1.0) and f("what the hell", "OFF") == ("what the hell", [], 1.0)
    assert f("what the hell")[0] == "what the [BEEP]" and f("what the Hell", strategy="ASTERISK")[0] == "what the h**l" and f("hell no", strategy="REMOVE")[0] == "no"
    assert f("damn it", strategy="SYNONYM")[0] == "darn it" and f("pissed off", strategy="SYNONYM")[0] == "[FILTERED] off"
    assert f("krishna and god spare us from hell")[0] == "krishna and god spare us from hell" and f("hello class")[0] == "hello class"
    assert f("hello class", compat=True)[0] == "h***o cla**" and f("sh1t")[0] == "[BEEP]" and f("sh!t")[0] == "s***"
    assert f("a stupid idea", "STRICT")[0] == "a [BEEP] idea" and f("a stupid idea", "MILD")[0] == "a stupid idea"
    assert f("stupid hell", "STRICT")[2] == pytest.approx((0.95 + 0.75) / 2 * 0.8)


def test_texts_of_columns(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert value(C.caption_lines(lit("  a  b \n\n \t\nc "))) == "a  b\nc" and value(C.display_text(lit(" a – b\t"))) == "a - b"
    assert value(C.prompt(lit("x y"), lit("# head\nKrishna"))) == "x y Krishna" and len(value(C.prompt(lit("w " * 200), lit("g")))) == 224
    page = "Intro TEXT 1: Kṛṣṇa and dhyāna of Arjuna\nTEXT 2: The Yadavas and krishna, KARMA ātma"
    assert [(v.verse, v.content[:5]) for v in value(C.verses(lit(page)))] == [(1, "Kṛṣṇa"), (2, "The Y")]
    terms = K.verse_terms(spark.createDataFrame([(1, page), (2, "none")], "chapter int, text string"), "text", ["the"], ["krishna"])
    assert [(r.chapter, r.text, r.word_count) for r in terms.collect()] == [(1, "Arjuna dhyāna ātma", 3)]
    assert value(C.key_sentences(lit("Short. Krishna speaks about the nature of all things! And this is another long sentence about soul."))) == "Krishna speaks about the nature of all things. And this is another long sentence about soul"
    assert value(C.key_sentences(lit("Nothing of the kind is said in this long sentence."))) is None
    assert value(C.devanagari_words(lit("धर्म, क x"))) == ["धर्म"]
    assert S.ascii_fold("धर्मक्षेत्रे कुरु") == "dharmakṣetre kuru" and S.rewrite_terms("KRISHNA krisna Diana") == "KRISHNA krishna Dhyāna"
    assert S.incomplete_ending("I am here. And the") == "And the" and S.incomplete_ending("I am here.") is None and S.is_complete("I am here now.")
    seg = F.struct(lit("t").alias("text"), lit(0.0).alias("start"), lit(1.0).alias("end"), F.array(F.struct(lit("t").alias("word"), lit(0.0).alias("start"), lit(0.5).alias("end"))).alias("words"))
    moved = value(C.rebased(seg, lit(5.0)))
    assert (moved.start, moved.end, moved.words[0].end) == (5.0, 6.0, 5.5)
    assert value(C.mean_confidence(F.array(lit(0.9), lit(0.7)), lit(0.6))) == pytest.approx(0.76) and value(C.mean_confidence(F.array().cast("array<double>"))) == 1.0
    assert value(C.valid_chunk(lit(1.0), lit(1.0))) is False and value(C.valid_audio(lit(None).cast("array<float>"), lit(1.0))) is False


def test_corrections_of_whole_texts(spark):
    terms = L.dictionary(spark)
    rows = [(1, "krishna and Arjun, the dharm of Krishna!"), (2, None), (3, " "), (4, "a an"), (5, "Kirshna gta — Kirshna")]
    got = {r.id: r for r in X.corrected(spark.createDataFrame(rows, "id long, text string"), terms, "id", "text").collect()}
    assert got[1].corrected == "Krishna and Arjuna, the dharma of Krishna!" and [c.position for c in got[1].corrections] == [0, 4, 8] and got[1].confidence == 100.0
    assert (got[2].corrected, got[2].confidence) == (None, 1.0) and (got[3].corrected, got[3].confidence) == (" ", 1.0) and got[4].confidence == 100.0
    assert got[5].corrected == "Krishna Gita — Krishna" and got[5].corrections[0].distance == 2
    # suggestions against every term
    every = [(r.wrong, r.canonical, r.entry) for r in terms.collect()]
    words = ["krshna", "gta", "philosofy", "zz", "verses"]
    best = X.suggestions(spark.createDataFrame([(w,) for w in words], "word string"), terms).collect()
    for w in words:
        want = sorted((-S.indel_ratio(w, t), e, c) for t, c, e in every if S.indel_ratio(w, t) >= 50)[:5]
        assert [(r.canonical, round(r.score, 6)) for r in sorted((r for r in best if r.word == w), key=lambda r: r["rank"])] == [(c, round(-s, 6)) for s, _, c in want]


def test_first_of_equal_keeps_null_ids_and_one_row(spark):
    rows = [(1, "a b"), (1, "A  b"), (None, "solo"), (2, "c"), (None, None), (3, " C ")]
    got = L.first_of_equal(spark.createDataFrame(rows, "id long, text string"), "text", "id").collect()
    assert sorted((r.id is None, r.id or 0, (r.text or "").lower().split()) for r in got) == [(False, 1, ["a", "b"]), (False, 2, ["c"]), (True, 0, []), (True, 0, ["solo"])]


def test_caption_operators(spark):
    rows = [(1, 1, "one", 0.9, 3.0, True), (1, 2, "two", 1.5, 3.5, False), (1, 3, "three", 2.0, 4.0, True), (1, 4, "odd", 5.0, 4.0, True)]
    c = spark.createDataFrame(rows, "stream long, caption_id long, text string, start_time double, end_time double, is_primary boolean")
    frames = CP.frames(c, 10, "start_time", "end_time", seek=1.05)
    assert {(r.caption_id, r.frame) for r in frames.collect()} == {(i, f) for _, i, _, s, e, _ in rows for f in range(11, 60) if s <= f / 10 <= e}
    assert [r.caption_id for r in CP.layered(frames.filter("frame = 25"), "stream", "frame").orderBy("layer").collect()] == [1, 3, 2]
    assert CP.latest_only(frames.filter("frame = 25"), "stream", "frame").first().caption_id == 3
    assert CP.removed(c, spark.createDataFrame([(1, 2)], "stream long, caption_id long"), ["stream", "caption_id"]).count() == 3
    added = CP.added(spark.createDataFrame([(1, 1, "x", 100.5), (1, 2, " ", 101.0), (1, 3, "y", -2.0)], "stream long, seq long, text string, at double"), "stream", "seq", "text", "at", F.lit(2.5), F.col("at") > 50, F.lit(100.0))
    assert [(r.caption_id, r.start_time, r.end_time) for r in added.orderBy("seq").collect()] == [(1, 0.5, 3.0), (2, 0.0, 2.5)]
    assert [r.start_time for r in CP.scheduled(spark, 10.0).collect()] == [11.0, 13.0, 15.0]
    paused = T.without_pauses(spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 5.0, 2.0), (1, 2, 6.0, None)], "s long, n long, at double, p double"), "s", "n", F.col("at"), F.col("p"))
    assert [r.played for r in paused.orderBy("n").collect()] == [0.0, 3.0, 4.0]


def test_files_and_the_vocabulary_job(spark, tmp_path):
    docs = [
        {"url": "u1", "text": "Krishna speaks to Arjuna about dharma.", "chapter": 2, "source": "test", "word_count": 6}, {"url": "u2", "text": "krishna  speaks to arjuna about dharma.", "chapter": 3, "source": "other"},
        {"url": "u3", "text": "Kṛṣṇa and Krishna teach yoga", "chapter": 2, "source": "test"}, {"url": "u4", "text": "About karma", "chapter": None, "source": "test"},
    ]
    (tmp_path / "raw.jsonl").write_text("\n".join([json.dumps(docs[0]), "", "{broken", *map(json.dumps, docs[1:])]), encoding="utf-8")
    path, out = f"file://{tmp_path}/raw.jsonl", f"file://{tmp_path}/out"
    assert sources.corpus(spark, path).count() == 4 and [r.line for r in sources.malformed(spark, path).collect()] == ["{broken"]
    assert jobs.vocabulary(spark, path, out) == {"common_glossary": True, "chapter_glossaries": False, "all_valid": False}
    table = spark.read.option("header", True).option("escape", '"').csv(f"{out}/gita_tokens").collect()
    assert (table[0].token, table[0]["count"], table[0].chapters, table[0].sources, table[0].contexts) == ("Krishna", "2", "2", "test", "Krishna speaks to Arjuna about dharma | Kṛṣṇa and Krishna teach yoga")
    common = (tmp_path / "out/glossaries/common_200.txt").read_text(encoding="utf-8").splitlines()
    assert common[4] == f"# Total terms: {len(common) - 6}" and common[5] == "#" and common[-1] == "Krishna" and len(table) == len(common) - 6
    ascii_ = (tmp_path / "out/glossaries/by_chapter/02_ascii.txt").read_text(encoding="utf-8").splitlines()
    assert "krsna" in ascii_ and not (tmp_path / "out/glossaries/by_chapter/03.txt").exists()
    assert "1. **Krishna** - 2 occurrences" in (tmp_path / "out/glossaries/README.md").read_text(encoding="utf-8")
    sinks.corpus(sources.corpus(spark, path).drop("seq"), f"{out}/again")
    assert sources.corpus(spark, f"{out}/again").count() == 4

    (tmp_path / "terms.txt").write_text("# head\n\nkrsna -> Krishna\nGovinda\nkrsna -> Krsna\n", encoding="utf-8")
    assert {r.wrong: r.canonical for r in sources.dictionary(spark, f"file://{tmp_path}/terms.txt").collect()} == {"krsna": "Krsna", "govinda": "Govinda"}
    (tmp_path / "g").mkdir()
    (tmp_path / "g/Chapter2.txt").write_text("# c\nalpha beta\n")
    (tmp_path / "g/bg3.txt").write_text("gamma")
    g = sources.glossaries(spark, f"file://{tmp_path}/g")
    asked = spark.createDataFrame([(1, "/x/BG_Chapter 2.mp3", ""), (2, "/x/ch3.wav", None), (3, "/x/talk.wav", "as in chapter2 before"), (4, "/x/talk.wav", "")], "id long, path string, previous string")
    found = {r.id: (r.guessed_chapter, r.confidence, r.glossary) for r in K.chapter_glossaries(asked, g, "path", "previous").collect()}
    assert found[1] == ("chapter2", 0.8, "# c\nalpha beta") and found[2][0] == "bg3" and found[3][0] == "chapter2" and found[4][:2] == (None, 0.3) and found[4][2].startswith("Krishna Arjuna")
    assert K.chosen_glossary(asked, "empty").first().glossary == "" and "Bhagavad Gita" in K.chosen_glossary(asked, "static_common").first().glossary
    (tmp_path / "pairs.tsv").write_text('hello\thola\tm\nhe said "x\tdijo\t\n')
    assert [tuple(r) for r in sources.parallel(spark, f"file://{tmp_path}/pairs.tsv").collect()] == [("hello", "hola"), ('he said "x', "dijo")]


def test_pages_sound_and_outputs(spark):
    page = '<p>A &amp; b</p><div class="verse-container x"><div class="sanskrit">धर्म <b>क</b></div><div class="sanskrit">no</div></div><div class="sanskrit">out</div>'
    row = sources.page_texts(spark.createDataFrame([(1, page), (2, None)], "id long, html string")).orderBy("id").collect()
    assert row[0].text.startswith("A & b") and list(row[0].verse_texts) == ["धर्म क"] and row[1].text == ""
    assert [r.chapter for r in sources.chapter_pages(spark, "https://a.example/", 3, spark.createDataFrame([("https://a.example/2/",)], "url string")).orderBy("chapter").collect()] == [1, 3]
    sound = spark.createDataFrame([("s", [1.0, 3.0] * 10), ("t", None)], "stream string, samples array<double>")
    chunks = {(r.stream, r.chunk): (r.start, list(r.samples)) for r in sources.audio_chunks(sound, rate=4, size=1.0, overlap=0.5, channels=2).collect()}
    assert chunks["s", 0] == (0.0, [2.0] * 4) and chunks["s", 3] == (1.5, [2.0] * 4) and chunks["t", 0] == (0.0, [0.0] * 4) and len(chunks) == 5
    assert sources.durations(sound, 4, 2).orderBy("stream").first().seconds == 2.5
    media = sources.cached_media(spark.createDataFrame([("https://youtu.be/abcdefghijk",), ("file.mp4",)], "url string"), spark.createDataFrame([("abcdefghijk", "/c/1.mp4")], "video_id string, path string"))
    assert {r.url: (r.remote, r.path) for r in media.collect()} == {"https://youtu.be/abcdefghijk": (True, "/c/1.mp4"), "file.mp4": (False, None)}
    segments = spark.createDataFrame([("s", 0.0, 1.5, " hi "), ("s", 2.0, 3.9999, "you")], "stream string, start double, end double, text string")
    assert [r.block for r in sinks.subtitles(segments).orderBy("number").collect()] == ["1\n00:00:00,000 --> 00:00:01,500\nhi\n", "2\n00:00:02,000 --> 00:00:03,999\nyou\n"]
    results = segments.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("segments")).withColumn("glossary", F.lit("You and"))
    done = jobs.transcripts(results, L.dictionary(spark)).first()
    assert done.text == "hi you" and done.glossary_matches == 1 and json.loads(done.out)["corrected"] == "hi you"
    beats = sinks.heartbeats(spark.createDataFrame([(0.5, 1), (59.0, 2), (60.0, 3)], "timestamp double, n int")).orderBy("timestamp").collect()
    assert [json.loads(r.line)["n"] for r in beats] == [1, 3]
    U.register(spark)
    assert [r.token for r in spark.sql("SELECT token FROM tokens('Hi, the world') ORDER BY pos").collect()] == ["Hi", "the", "world"]
    assert spark.sql("SELECT state FROM sentences('This is a test. And the') ORDER BY pos").first().state == "complete"
    assert spark.sql("SELECT clean_repetitions('um um um I think').text AS t, indel_ratio('abc', 'abd') AS r").first().t == "um I think"
    with pytest.raises(ValueError):
        K.model_settings(beam=1)
