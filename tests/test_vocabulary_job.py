"""The vocabulary job on the sample corpus against its known result; sound at other rates."""

import csv
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus as K
from lectern.operators import library as L
from lectern.plans import jobs
from lectern.sources import files as sources
from lectern.sources.samples import sample_corpus

# Known results: the most frequent terms, the second chapter's glossary (most frequent last).
TOP = [
    ("bhakti", 7), ("dharma", 4), ("mā", 4), ("yoga", 4), ("mad", 3), ("māṁ", 3), ("jīva", 3), ("Sañjaya", 2), ("kṣetre", 2), ("uvāca", 2), ("karma", 2), ("yadā", 2),
    ("prakṛti", 2), ("mām", 2), ("sarva", 2), ("ārati", 2), ("prasādam", 2), ("prema", 2), ("bhāva", 2), ("Dhṛtarāṣṭra", 1), ("Pāṇḍu", 1), ("Kurukṣetra", 1), ("kuru", 1),
]
SECOND = """yoga akarmaṇi stv saṅgo bhūr hetur phala kadācana phaleṣu evādhikāras karmaṇy Madhusūdana uvāca vākyam idaṁ viṣīdantam īkṣaṇa pūrṇa aśru paripūrṇa kṛpayā Arjuna dharma Sañjaya
karma mā""".split()


def test_sample_corpus(spark):
    rows = sample_corpus(spark)
    assert [r.seq for r in rows.collect()] == list(range(10)) and rows.filter("chapter IS NULL").count() == 1
    terms = L.glossary(rows, "text", "seq", "chapter", "source").collect()
    assert [(r.token, r.n) for r in terms[: len(TOP)]] == TOP
    s = K.stats(L.term_counts(rows, "text", "seq", "chapter", "source")).first()
    assert (s.unique_tokens, s.total_occurrences, list(s.chapters), list(s.sources)) == (168, 201, [1, 2, 4, 7, 9, 15, 18], ["sample_sanskrit"])
    by = {r.token: r for r in terms}
    assert by["bhakti"].ascii == "bhakti" and list(by["bhakti"].chapters) == [7, 9, 18] and list(by["bhakti"].contexts)[:2] == ["yathā jñāsyasi tac chṛṇu yoga bhakti jñāna", "tānāṁ yoga-kṣemaṁ vahāmy aham bhakti yoga kṣema"]
    assert by["Dhṛtarāṣṭra"].ascii == "dhrtarastra" and list(by["ārati"].chapters) == []


def test_vocabulary_of_the_sample_corpus(spark, tmp_path):
    done = jobs.vocabulary_of(sample_corpus(spark), str(tmp_path), table="tokens")
    assert done["common_glossary"]
    lines = (tmp_path / "glossaries" / "by_chapter" / "02.txt").read_text().split("\n")
    assert lines[4] == "# Total terms: 26" and lines[6:-1] == SECOND
    common = (tmp_path / "glossaries" / "common_200.txt").read_text().split("\n")
    assert common[4] == "# Total terms: 168" and common[-13:-1] == [t for t, _ in TOP[:12]][::-1]
    page = (tmp_path / "glossaries" / "README.md").read_text()
    assert "- **Unique tokens**: 168" in page and "- **Total occurrences**: 201" in page and "- **Chapters covered**: 7" in page and " 1. **bhakti** - 7 occurrences" in page
    rows = [r for name in sorted(glob.glob(f"{tmp_path}/tokens/*.csv")) for r in csv.DictReader(open(name, encoding="utf-8"))]
    assert len(rows) == 168 and sum(int(r["count"]) for r in rows) == 201


def test_sound_at_another_rate(spark):
    for given, rate in ((44100, 16000), (8000, 16000), (48000, 16000), (16000, 16000)):
        t = np.arange(given) / given
        got = sources.resampled((0.3 * np.sin(2 * np.pi * 440 * t)).astype(np.float32), given, rate)
        assert len(got) == rate and got.dtype == np.float32
        want = 0.3 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
        assert np.abs(got - want)[500:-500].max() < 1e-3
    # what the lower rate can't hold goes
    high = sources.resampled(np.sin(2 * np.pi * 12000 * np.arange(48000) / 48000).astype(np.float32), 48000, 16000)
    assert np.abs(high[200:-200]).max() < 1e-3
    assert len(sources.resampled(np.zeros(0, np.float32), 44100, 16000)) == 0
    stereo = np.repeat(np.sin(2 * np.pi * 100 * np.arange(44100 * 2) / 44100), 2).astype(float).tolist()
    df = spark.createDataFrame([("a", stereo), ("none", None)], "stream string, samples array<float>")
    rows = sources.audio_chunks(df, size=1.0, overlap=0.0, channels=2, given=44100).orderBy("stream", "chunk").collect()
    assert [(r.stream, r.chunk, len(r.samples)) for r in rows] == [("a", 0, 16000), ("a", 1, 16000), ("none", 0, 16000)]
    assert np.abs(np.array(rows[0].samples) - np.sin(2 * np.pi * 100 * np.arange(16000) / 16000))[300:-300].max() == pytest.approx(0, abs=1e-3)
    assert df.select(F.size("samples")).count() == 2


def test_terms_of_batches_against_brute_force(spark, monkeypatch):
    """Words are counted by batch: repeated and null ids, null chapters, sources and texts, a batch in several parts."""
    text = lambda k: None if k == 7 else " ".join(f"w{(k * j) % 11} x{k}" for j in range(k % 9))
    rows = [(None if k == 5 else k // 2, text(k), None if k % 4 == 0 else k % 4 - 1, None if k % 5 == 0 else f"s{k % 3}") for k in range(40)]
    df = spark.createDataFrame(rows, "seq long, text string, chapter int, source string").coalesce(1)
    want = {}
    for seq, own, chapter, source in rows:
        for pos, token in enumerate((own or "").split()):
            n, chapters, sources, places = want.setdefault(token, [0, set(), set(), []])
            want[token][0] += 1
            chapters |= {chapter} - {None, 0}
            sources |= {source} - {None}
            places.append((seq is not None, seq or 0, pos))
    unique = df.filter("text IS NOT NULL")
    for most in (1, 3):
        got = {r.token: [r.n, set(r.chapters), set(r.sources), [(p.seq is not None, p.seq or 0, p.pos) for p in r.places]] for r in L._counted(unique, most).collect()}
        assert got == {t: [n, c, s, sorted(p)[:most]] for t, (n, c, s, p) in want.items()}
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array([["a"] * 3, None, [], ["b"] * 2])], ["seq", "words"])
    monkeypatch.setattr(L, "_AT_ONCE", 2)
    assert [r for part in L._parts(batch) for r in part.column(0).to_pylist()] == [1, 2, 3, 4] and len(list(L._parts(batch))) > 1


def test_texts_are_tokenised_once_and_only_wanted_terms_get_contexts(spark):
    rows = sample_corpus(spark)
    shown = L.term_counts(rows, "text", "seq", "chapter", "source")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in shown and "Generate posexplode" not in shown and shown.count("MapInArrow") == 1
    whole = L.glossary(rows, "text", "seq", "chapter", "source").collect()
    assert L.glossary(rows, "text", "seq", "chapter", "source", top=20).collect() == whole[:20]
