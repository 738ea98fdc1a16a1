"""Further named queries: captions, streams, corrections and corpus numbers over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.functions import machines as M
from lectern.functions import udfs as U
from lectern.functions.lists import COLOURS, GLOSSARY_TERMS, LEET, RELIGIOUS
from lectern.operators import captions as CP
from lectern.operators import corpus as K
from lectern.operators import correction as X
from lectern.operators import library as L
from lectern.operators import streams as S
from lectern.sinks.shared import written
from lectern.queries import _CAPTIONS_SQL, _EVENTS, _PAIRS, _SIMILAR, _TERMS, _UNIQUE, _captions, _events, _list, _turn_pairs, query, table

#: White space of any kind, and a text without it at both ends.
_W = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_W}+'), lambda w: w <> '')"


# Texts


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10)) AS lines FROM documents")
def caption_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.caption_lines(F.col("text")).alias("lines"))


@query(
    f"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), k AS (SELECT doc_id, ls, list_transform(ls, lambda x: lower({_strip('x')})) AS ks FROM l) "
    "SELECT doc_id, array_to_string(list_filter(ls, lambda x, i: list_position(ks, ks[i]) = i), chr(10)) AS kept FROM k"
)
def line_dedup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.dedup_lines(F.col("text")).alias("kept"))


@query(f"SELECT conv_id, turn, CAST(len({_words('text')}) AS BIGINT) AS words FROM conversations")
def word_counts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", C.word_count(F.col("text")).alias("words"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, CAST(len(list_intersect(list_distinct({_words('lower(text)')}), list_distinct({_words('lower(before)')}))) AS BIGINT) AS matches FROM p")
def glossary_match_counts(spark, sf):
    return _turn_pairs(spark, sf).select("conv_id", "turn", C.glossary_matches(F.col("text"), F.col("before")).alias("matches"))


_FILTERED = ["the", "ass", "and", "house", "of"]
_EDGE = r"[^\p{L}\p{N}_]"


def _replaced(x: str, pattern: str, to: str) -> str:
    """Whole words of a text; two words may share the sign between them, so twice."""
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|{_EDGE})(?:{pattern})($|{_EDGE})', '\\1{to}\\2', 'gi')"
    return x


def _filtered(religious: bool) -> str:
    x = _replaced("text", "|".join(_FILTERED), "[BEEP]")
    for pattern, to in LEET:
        if religious and pattern in ("h[e3]ll", "d[a@4]mn"):
            continue
        x = _replaced(x, pattern.replace("[a@4]ss", "[a4]ss"), to)
        if pattern == "[a@4]ss":
            x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])@ss($|{_EDGE})', '\\1{to}\\2', 'gi')"
    return x


@query(
    f"WITH d AS (SELECT doc_id, text, len(list_filter({list(RELIGIOUS)}, lambda t: contains(lower(text), t))) >= 2 AS religious FROM documents), f AS (SELECT doc_id, CASE WHEN religious THEN {_filtered(True)} ELSE {_filtered(False)} END AS text FROM d) "
    "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\s+([,.!?;:])', '\\1', 'g')) AS text FROM f"
)
def profanity_beep(spark, sf):
    """All documents, with a list of words that the texts have, and spellings with digits and signs."""
    return S.spread(table(spark, sf, "documents")).select("doc_id", U.filter_profanity(words=_FILTERED)("text").text.alias("text"))


@query(None)
def profanity_levels(spark, sf):
    """What each level and strategy makes of every turn, by numbers of findings."""
    out = None
    for level, strategy in (("OFF", "BEEP"), ("MILD", "ASTERISK"), ("MODERATE", "REMOVE"), ("STRICT", "SYNONYM")):
        rows = S.spread(table(spark, sf, "conversations")).select(U.filter_profanity(level, strategy)("text").alias("r")).groupBy("r.findings").agg(F.count("*").alias("n"))
        rows = rows.select(F.lit(level).alias("level"), "findings", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(None)
def repetition_clean(spark, sf):
    return S.spread(table(spark, sf, "conversations")).select("conv_id", "turn", U.clean_repetitions("text").alias("r")).select("conv_id", "turn", "r.*")


@query(None)
def rewritten_terms(spark, sf):
    return S.spread(table(spark, sf, "conversations")).select("conv_id", "turn", U.rewrite_terms("text").alias("text"))


@query(r"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS token FROM documents) SELECT token, strip_accents(lower(token)) AS ascii FROM t")
def ascii_tokens(spark, sf):
    return L.tokens(table(spark, sf, "documents"), "text").select("token").distinct().withColumn("ascii", U.ascii_fold("token"))


# Captions


@query(
    "SELECT event_id, CASE WHEN value <= 0 THEN 3.0 WHEN value > 10 THEN 10.0 ELSE value END::DOUBLE AS duration, "
    "CASE WHEN least(4.0, greatest(1.5, value)) IS NULL THEN NULL ELSE least(4.0, greatest(1.5, value)) END::DOUBLE AS caption, "
    "greatest(value, 50.0)::DOUBLE AS not_past, (value - 40 BETWEEN -10 AND 30) AS in_time, least(value, 20.0)::DOUBLE AS clipped FROM events WHERE value IS NOT NULL"
)
def caption_times(spark, sf):
    v = F.col("value")
    rows = table(spark, sf, "events").filter("value IS NOT NULL")
    return rows.select(
        "event_id", C.valid_duration(v).alias("duration"), C.caption_duration(F.lit(0.0), v).alias("caption"), C.not_past(v, F.lit(50.0)).alias("not_past"),
        C.in_time(v, F.lit(40.0)).alias("in_time"), C.clip_duration(v, F.lit(20.0)).alias("clipped"),
    )


_EPOCH = 1704067200.0


@query(f"WITH {_EVENTS}, r AS (SELECT event_id, CASE WHEN t > {_EPOCH} + 1000000 - 86400 AND t < {_EPOCH} + 1000000 + 3600 THEN t - ({_EPOCH} + 950000) ELSE t END AS r FROM e) SELECT event_id, round(CASE WHEN r < -1 THEN 0.0 ELSE r END, 3)::DOUBLE AS seconds FROM r")
def relative_times(spark, sf):
    t = F.col("ts").cast("double")
    return _events(spark, sf).select("event_id", F.round(C.relative_time(t, F.lit(_EPOCH + 1000000), F.lit(_EPOCH + 950000)), 3).alias("seconds"))


_GRID_SQL = "SELECT c.*, unnest(generate_series(CAST(greatest(ceil(s * 4), 0) AS BIGINT), CAST(floor(e * 4) AS BIGINT))) AS frame FROM c"


@query(f"WITH {_CAPTIONS_SQL}, a AS ({_GRID_SQL}), x AS (SELECT *, frame / 4.0::DOUBLE AS t, least(0.05, (e - s) / 8) AS i, least(0.2, (e - s) / 6) AS o FROM a) SELECT conv_id, id, frame, round(greatest(0.1, least(1.0, CASE WHEN t - s < i THEN (t - s) / i WHEN e - t < o THEN (e - t) / o ELSE 1.0 END)), 6)::DOUBLE AS fade FROM x")
def display_fades(spark, sf):
    rows = CP.frames(_captions(spark, sf), 4)
    return rows.select("conv_id", "id", "frame", F.round(C.display_fade(F.col("t"), F.col("s"), F.col("e")), 6).alias("fade"))


_PICTURE = "p AS (SELECT event_id, CAST(320 + event_id % 1600 AS INT) AS w, CAST(240 + event_id % 900 AS INT) AS h, CAST(event_id % 3 AS INT) AS i, CAST(5 + event_id % 9 AS INT) AS pad, CAST(200 + event_id % 700 AS INT) AS tw, CAST(25 + event_id % 60 AS INT) AS th FROM events)"


@query(
    f"WITH {_PICTURE}, b AS (SELECT *, tw + 2 * pad AS bw, th + 2 * pad AS bh, h - CASE WHEN i = 0 THEN 20 ELSE 20 + (th + 2 * pad) + 3 * i END AS low FROM p), "
    "y AS (SELECT *, CASE WHEN bw > w THEN 0 ELSE (w - bw) // 2 END AS x1, CASE WHEN i > 0 AND low - bh < 20 THEN 20 ELSE low - bh END AS y1 FROM b) "
    "SELECT event_id, CAST(greatest(12, least(CAST(floor(30 * sqrt(w * h / 2073600.0::DOUBLE)) AS INT), 60)) AS INT) AS font, CAST(greatest(5, CAST(floor(10 * w / 1920.0::DOUBLE) AS INT)) AS INT) AS padding, "
    "CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(CASE WHEN bw > w THEN w ELSE x1 + bw END AS INT) AS x2, CAST(y1 + bh AS INT) AS y2, CAST(x1 + pad AS INT) AS text_x, CAST(y1 + pad AS INT) AS text_y FROM y"
)
def caption_boxes(spark, sf):
    n = lambda a, m: (F.lit(a) + F.col("event_id") % m).cast("int")
    w, h = n(320, 1600), n(240, 900)
    box = C.caption_box(w, h, n(200, 700), n(25, 60), n(5, 9), n(0, 3), F.lit(0))
    rows = table(spark, sf, "events").select("event_id", C.font_size(F.lit(1.0), w, h).alias("font"), C.box_padding(F.lit(10), w, h).alias("padding"), box.alias("b"))
    return rows.select("event_id", "font", "padding", "b.*")


@query("SELECT doc_id, " + "CASE lang " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in COLOURS.items()) + " ELSE [255, 255, 255] END[1] AS blue, CAST(len(lang) AS INT) AS n FROM documents")
def language_colours(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.colour(F.col("lang"))[0].alias("blue"), F.length("lang").alias("n"))


@query("SELECT event_id, CAST(floor((value - 1.5) * 30) AS BIGINT) AS target, CAST(CASE WHEN floor((value - 1.5) * 30) - 100 > 3 THEN floor((value - 1.5) * 30) - 101 ELSE 0 END AS BIGINT) AS skip, CASE WHEN value > 0 AND event_id % 2 = 0 AND abs(10.0 - value) > 0.016 THEN value ELSE 10.0 END::DOUBLE AS synced FROM events WHERE value IS NOT NULL")
def frame_sync(spark, sf):
    target = C.target_frame(F.col("value"), F.lit(1.5), F.lit(30))
    rows = table(spark, sf, "events").filter("value IS NOT NULL")
    return rows.select("event_id", target.alias("target"), C.frames_to_skip(target, F.lit(100)).alias("skip"), C.synced(F.lit(10.0), F.col("value"), F.col("event_id") % 2 == 0).alias("synced"))


@query(
    "WITH u AS (SELECT event_id, value, event_id % 13 AS n FROM events WHERE value IS NOT NULL) SELECT event_id, (n >= 10 * 0.6) AS busy, CASE WHEN value > 80 THEN 'warning' WHEN value > 40 THEN 'info' END AS alert, "
    "('Audio Q: ' || n || '/10 | Result Q: 3') AS label, ('#' || event_id || CASE WHEN n = 0 THEN ' (warmup)' ELSE ' (normal)' END) AS chunk, round(n / 10.0, 6)::DOUBLE AS usage, "
    "round(CASE WHEN n / 10.0 > 0.6 THEN least(1.0, w * (1 + n / 10.0 * 2)) ELSE w END, 6)::DOUBLE AS wait FROM (SELECT *, CASE WHEN n = 1 OR 3.5 - value <= 0 THEN 0.1 ELSE least(0.5, greatest(0.1, (3.5 - value) * 0.8)) END::DOUBLE AS w FROM u)"
)
def queue_signals(spark, sf):
    n = F.col("event_id") % 13
    rows = table(spark, sf, "events").filter("value IS NOT NULL")
    wait = C.adaptive_sleep(n == 1, F.col("value"), F.lit(5.0), F.lit(1.5), n / 10)
    return rows.select(
        "event_id", C.over_threshold(n, F.lit(10)).alias("busy"), C.drop_alert(F.col("value")).alias("alert"), C.queue_label(n, F.lit(10), F.lit(3)).alias("label"),
        C.chunk_label(F.col("event_id"), n == 0).alias("chunk"), F.round(C.queue_stats(n, F.lit(10)).usage, 6).alias("usage"), F.round(wait, 6).alias("wait"),
    )


_NAMED = "n AS (SELECT conv_id, turn, role, text, turn * 2.5::DOUBLE AS start_time, turn * 2.5::DOUBLE + least(4.0, greatest(1.5, len(string_split(text, ' ')) / 4.0))::DOUBLE AS end_time FROM conversations)"


def _named(spark, sf):
    length = F.least(F.lit(4.0), F.greatest(F.lit(1.5), F.size(F.split("text", " ")) / 4.0))
    rows = table(spark, sf, "conversations").withColumn("start_time", F.col("turn") * 2.5)
    return rows.withColumn("end_time", F.col("start_time") + length).withColumn("caption_id", F.col("turn"))


@query(f"WITH {_NAMED} SELECT conv_id, turn FROM n WHERE start_time > 4.0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY start_time) <= 3")
def upcoming_captions(spark, sf):
    return CP.upcoming(_named(spark, sf), "conv_id", F.lit(4.0)).select("conv_id", "turn")


@query(f"WITH {_NAMED} SELECT conv_id, turn FROM n WHERE end_time > 6.0 - 1.0 AND NOT (start_time < 9.0 AND end_time > 7.5)")
def pruned_captions(spark, sf):
    return CP.without_overlap(CP.pruned(_named(spark, sf), F.lit(6.0)), F.lit(7.5), F.lit(9.0)).select("conv_id", "turn")


@query(f"WITH {_NAMED}, a AS (SELECT n.*, unnest(generate_series(CAST(ceil(start_time * 4) AS BIGINT), CAST(floor(end_time * 4) AS BIGINT))) AS frame FROM n) SELECT conv_id, turn, frame, CAST(row_number() OVER (PARTITION BY conv_id, frame ORDER BY role = 'assistant' DESC, start_time, turn) - 1 AS INT) AS layer FROM a")
def caption_layers(spark, sf):
    rows = CP.frames(_named(spark, sf), 4, "start_time", "end_time").withColumn("is_primary", F.col("role") == "assistant")
    return CP.layered(rows, "conv_id", "frame").select("conv_id", "turn", "frame", "layer")


@query(f"WITH {_NAMED} SELECT n.conv_id, n.turn, coalesce(e.value_text, n.text) AS subtitle FROM n LEFT JOIN (SELECT CAST(event_id % 40 AS DOUBLE) AS start, min('event ' || event_id) AS value_text FROM events GROUP BY 1) e ON e.start = n.start_time")
def external_subtitles(spark, sf):
    other = table(spark, sf, "events").select((F.col("event_id") % 40).cast("double").alias("start"), F.concat(F.lit("event "), F.col("event_id")).alias("text"))
    return CP.subtitled(_named(spark, sf), other).select("conv_id", "turn", "subtitle")


@query(f"WITH {_NAMED} SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'buffered ' || turn ELSE text END AS translation FROM n WHERE turn % 2 = 0")
def translated_captions(spark, sf):
    rows = _named(spark, sf).withColumn("lang", F.lit("fr"))
    buffered = rows.filter("turn % 2 = 0").select(F.col("start_time").alias("ts"), "lang", F.concat(F.lit("buffered "), F.col("turn")).alias("text")).distinct()
    return CP.translated(rows, buffered, "start_time", "lang", F.col("text")).select("conv_id", "turn", "translation")


@query("SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, a.text AS one, b.text AS two FROM (SELECT * FROM conversations WHERE turn % 3 <> 0) a FULL JOIN (SELECT * FROM conversations WHERE turn % 3 <> 1) b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def compared_captions(spark, sf):
    rows = table(spark, sf, "conversations")
    return CP.compared(rows.filter("turn % 3 <> 0"), rows.filter("turn % 3 <> 1"), ["conv_id", "turn"]).drop("similarity")


@query("SELECT doc_id, language FROM documents, (SELECT unnest(['fr', 'de', 'it']) AS language)")
def language_fan_out(spark, sf):
    return S.fanned_out(table(spark, sf, "documents").select("doc_id"), ["fr", "de", "it", "fr"])


@query("SELECT doc_id, lang AS language, lang = 'en' AS is_primary FROM documents")
def merged_languages(spark, sf):
    docs = table(spark, sf, "documents")
    return S.merged({x: docs.filter(F.col("lang") == x).select("doc_id") for x in ("en", "fr", "de", "es")}, "en")


@query(None)
def admitted_captions(spark, sf):
    """Turns as live segments, half a second behind the picture."""
    rows = _named(spark, sf).withColumn("now", F.col("start_time") + 0.5)
    return S.folded(rows.select("conv_id", "turn", "text", "start_time", "end_time", "now"), "conv_id", ["turn"], M.CaptionTimeline())


# Streams


@query("SELECT event_id, CASE WHEN row_number() OVER w <= 10 THEN 'added' ELSE 'dropped oldest' END AS event, CAST(lag(event_id, 10) OVER w AS VARCHAR) AS dropped, least(10, row_number() OVER w) AS size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def buffer_drops(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").cast("string").alias("item"))
    return L.buffer_events(rows, "user_id", "event_id", "item", 10).select("event_id", "event", "dropped", "size")


@query(
    f"WITH RECURSIVE {_EVENTS}, s AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e), "
    "r AS (SELECT user_id, event_id, k, t AS last, true AS emitted FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.event_id, s.k, CASE WHEN s.t - r.last >= 86400 THEN s.t ELSE r.last END, s.t - r.last >= 86400 FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1) "
    "SELECT user_id, event_id, emitted FROM r"
)
def rate_limited(spark, sf):
    rows = _events(spark, sf).select("user_id", "event_id", F.col("ts").cast("double").alias("at"))
    return S.folded(rows, "user_id", ["event_id"], M.RateLimiter(86400.0))


@query(
    f"WITH w AS (SELECT conv_id, turn, {_words('text')} AS ws FROM conversations), c AS (SELECT conv_id, turn, flatten(list(ws) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS ws FROM w) "
    "SELECT conv_id, turn, coalesce(array_to_string(ws[greatest(1, len(ws) - 31):], ' '), '') AS context FROM c"
)
def prompt_contexts(spark, sf):
    return S.folded(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", ["turn"], M.WordWindow(32))


_CONTEXTS = (
    f"w AS (SELECT conv_id, turn, {_words('text')} AS ws FROM conversations), c AS (SELECT conv_id, turn, flatten(list(ws) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS ws FROM w), "
    "b AS (SELECT conv_id, turn, coalesce(array_to_string(ws[greatest(1, len(ws) - 31):], ' '), '') AS context FROM c)"
)


@query(f"WITH {_CONTEXTS} SELECT conv_id, turn, substr(concat_ws(' ', nullif(context, ''), CASE WHEN 214 - length(context) > 0 THEN substr('{' '.join(GLOSSARY_TERMS)}', 1, 214 - length(context)) END), 1, 224) AS prompt FROM b")
def prompts(spark, sf):
    rows = S.folded(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", ["turn"], M.WordWindow(32))
    return K.common_glossary(rows).select("conv_id", "turn", C.prompt(F.col("context"), F.col("glossary")).alias("prompt"))


@query(f"WITH {_EVENTS} SELECT event_type, CAST(floor(t / 3600) * 3600 AS BIGINT) AS start, count(*) AS n FROM e GROUP BY ALL")
def tumbling_counts(spark, sf):
    rows = _events(spark, sf).groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.unix_timestamp("window.start").alias("start"), "n")


@query(f"WITH {_EVENTS}, f AS (SELECT user_id, min(t) AS first FROM e GROUP BY 1) SELECT event_id FROM e JOIN f USING (user_id) WHERE t >= first + 86400")
def after_warm_up(spark, sf):
    rows = _events(spark, sf).withColumn("at", F.col("ts").cast("double"))
    return S.after_warm_up(rows, "user_id", "at", 86400.0).select("event_id")


@query("SELECT user_id, round(avg(value), 6) AS mean, max(value) AS most, min(value) AS least FROM events WHERE value IS NOT NULL GROUP BY 1")
def frame_times(spark, sf):
    return K.frame_times(table(spark, sf, "events").filter("value IS NOT NULL"), "value", "user_id").withColumn("mean", F.round("mean", 6))


@query(f"WITH {_PAIRS}, {_SIMILAR} SELECT conv_id, turn, coalesce(similarity > 0.8, false) AS skipped FROM conversations LEFT JOIN s USING (conv_id, turn)")
def skipped_repeats(spark, sf):
    return S.repeats_last(table(spark, sf, "conversations"), "conv_id", "turn", "text", C.text_similarity).select("conv_id", "turn", "skipped")


# Corpus and corrections

_CHAPTER = "CAST(doc_id % 18 + 1 AS INT)"


@query(f"WITH {_UNIQUE} SELECT CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')))")
def duplicate_contents(spark, sf):
    return K.duplicate_contents(table(spark, sf, "documents"), "text")


@query(f"SELECT count(*) AS items, CAST(sum(n_chars) AS BIGINT) AS words, round(avg(n_chars), 6) AS mean_words, count(DISTINCT source) AS sources, count(DISTINCT {_CHAPTER}) AS chapters FROM documents")
def scrape_stats(spark, sf):
    rows = table(spark, sf, "documents").withColumn("chapter", (F.col("doc_id") % 18 + 1).cast("int"))
    return K.scrape_stats(rows, "n_chars").withColumn("mean_words", F.round("mean_words", 6))


def _counts(spark, sf):
    rows = table(spark, sf, "documents").withColumn("chapter", (F.col("doc_id") % 18 + 1).cast("int"))
    return L.term_counts(rows, "text", "doc_id", "chapter", "source")


def _glossary(spark, sf, top):
    rows = table(spark, sf, "documents").withColumn("chapter", (F.col("doc_id") % 18 + 1).cast("int"))
    return L.glossary(rows, "text", "doc_id", "chapter", "source", top=top)


_SEEN = rf"t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS token, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+'), 1) AS pos FROM u WHERE text IS NOT NULL)"
_COUNTED = f"g AS (SELECT token, count(*) AS n, list_sort(list_distinct(list({_CHAPTER}))) AS chapters, list_sort(list_distinct(list(source))) AS sources, min((doc_id, pos)) AS first FROM k GROUP BY token)"


@query(f"WITH {_UNIQUE}, {_SEEN}, {_TERMS}, {_COUNTED} SELECT count(*) AS unique_tokens, CAST(sum(n) AS BIGINT) AS total_occurrences, round(avg(n), 6) AS mean, CAST(len(list_distinct(flatten(list(chapters)))) AS BIGINT) AS chapters, CAST(len(list_distinct(flatten(list(sources)))) AS BIGINT) AS sources, CAST(count(*) FILTER (token <> strip_accents(lower(token))) AS BIGINT) AS marked FROM g")
def corpus_stats(spark, sf):
    out = K.stats(written(_counts(spark, sf), "terms"))
    return out.select("unique_tokens", F.col("total_occurrences").cast("long").alias("total_occurrences"), F.round("mean", 6).alias("mean"), F.size("chapters").cast("long").alias("chapters"), F.size("sources").cast("long").alias("sources"), "marked")


@query(
    f"WITH {_UNIQUE}, {_SEEN}, {_TERMS}, {_COUNTED}, r AS (SELECT token, doc_id, row_number() OVER (PARTITION BY token ORDER BY doc_id, pos) AS rank FROM k QUALIFY rank <= 5), "
    "i AS (SELECT r.token, rank, text, instr(lower(text), lower(r.token)) AS p FROM r JOIN u USING (doc_id)), "
    f"x AS (SELECT token, list(CASE WHEN p > 0 THEN substr({_strip('substr(text, greatest(p - 30, 1), p + length(token) + 30 - greatest(p - 30, 1))')}, 1, 100) ELSE '' END ORDER BY rank) AS contexts FROM i GROUP BY token) "
    "SELECT token, strip_accents(lower(token)) AS ascii, n, array_to_string(chapters, ',') AS chapters, array_to_string(sources, ',') AS sources, array_to_string(contexts, ' | ') AS contexts FROM g JOIN x USING (token) ORDER BY n DESC, first LIMIT 200"
)
def glossary_rows(spark, sf):
    numbers = F.transform("chapters", lambda c: c.cast("string"))
    joined = (F.array_join(numbers, ",").alias("chapters"), F.array_join("sources", ",").alias("sources"), F.array_join("contexts", " | ").alias("contexts"))
    return _glossary(spark, sf, 200).select("token", "ascii", "n", *joined)


@query(f"WITH {_UNIQUE}, {_SEEN}, {_TERMS}, {_COUNTED}, c AS (SELECT token, n // len(chapters) AS score, first, unnest(chapters) AS chapter FROM g) SELECT chapter, token, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY chapter ORDER BY score DESC, first) AS INT) AS rank FROM c QUALIFY rank <= 100")
def chapter_terms(spark, sf):
    return L.chapter_glossary(_counts(spark, sf).select("token", "n", "chapters", "first")).select("chapter", "token", "score", "rank")


_BENCH_WORDS = r"b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS wrong FROM benchmark)"


@query(rf"WITH {_BENCH_WORDS}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS word FROM documents) SELECT word, 'the word ' || wrong AS canonical FROM w JOIN b ON word = wrong")
def dict_exact_from_benchmark(spark, sf):
    terms = L.tokens(table(spark, sf, "benchmark"), "text").select(F.lower("token").alias("wrong")).distinct()
    words = L.tokens(table(spark, sf, "documents"), "text").select(F.lower("token").alias("word")).distinct()
    return words.join(terms, words.word == terms.wrong).select("word", F.concat(F.lit("the word "), F.col("wrong")).alias("canonical"))


@query(None)
def corrected_turns(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return X.corrected(rows, L.dictionary(spark), "id", "text").select("conv_id", "turn", "corrected", F.size("corrections").alias("n"), F.round("confidence", 6).alias("confidence"))


@query(None)
def correction_suggestions(spark, sf):
    words = L.tokens(table(spark, sf, "conversations"), "text").select(F.lower("token").alias("word"))
    return X.suggestions(words, L.dictionary(spark))


@query("SELECT event_id, lpad(CAST(event_id AS VARCHAR), 11, 'x') AS video_id FROM events WHERE event_id % 5 < 4")
def media_ids(spark, sf):
    own = F.lpad(F.col("event_id").cast("string"), 11, "x")
    forms = [F.concat(F.lit(x), own) for x in ("https://www.youtube.com/watch?v=", "https://youtu.be/", "https://www.youtube.com/embed/", "https://www.youtube.com/v/")]
    url = F.element_at(F.array(*forms, F.concat(F.lit("https://a.example/"), own)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", C.video_id(url).alias("video_id")).filter("video_id IS NOT NULL")


# Relational categories without a counterpart of their own


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_large_orders(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("lectern_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM lectern_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS even, count(*) FILTER (user_id % 2 = 1) AS odd FROM events GROUP BY 1")
def pivoted_events(spark, sf):
    rows = table(spark, sf, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return rows.groupBy("event_type").pivot("side", ["even", "odd"]).count().na.fill(0)


@query("SELECT event_id, lead(value) OVER w AS after, first_value(value) OVER w AS first, round(percent_rank() OVER w, 6) AS share FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def window_values(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", F.lead("value").over(w).alias("after"), F.first("value").over(w).alias("first"), F.round(F.percent_rank().over(w), 6).alias("share"))


@query("SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_sums(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.from_json("props", "k long").k).alias("k"))
