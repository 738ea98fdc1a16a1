"""Named queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.functions.lists import BOGUS, CANONICAL, SILENCE_WORDS, STOP_WORDS
from lectern.operators import captions as CP
from lectern.operators import library as L
from lectern.operators.streams import dealt, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


#: White space of any kind.
_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_UNIQUE = "u AS (SELECT doc_id, text, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) ORDER BY doc_id) = 1)"
_TOKENS = r"t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS token FROM u)"
_TERMS = rf"k AS (SELECT * FROM t WHERE length(token) BETWEEN 2 AND 50 AND lower(token) NOT IN {_list(STOP_WORDS)} AND NOT regexp_full_match(token, '\p{{N}}+'))"


@query(f"WITH {_UNIQUE}, {_TOKENS}, {_TERMS} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY token ORDER BY n DESC, token LIMIT 200")
def vocab_topk(spark, sf):
    unique = L.first_of_equal(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")
    return L.vocabulary(unique, "text", "doc_id").orderBy(F.desc("n"), "token").limit(200)


@query(f"WITH {_UNIQUE}, {_TOKENS}, {_TERMS}, g AS (SELECT source, token, count(*) AS n FROM k GROUP BY ALL) SELECT source, token, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS rank FROM g QUALIFY rank <= 100")
def vocab_topk_per_source(spark, sf):
    unique = L.first_of_equal(table(spark, sf, "documents").select("doc_id", "text", "source"), "text", "doc_id")
    n = L.tokens(unique, "text", "source").filter(L.is_term(F.col("token"))).groupBy("source", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "token"))
    return n.withColumn("rank", rank.cast("long")).filter("rank <= 100")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) ORDER BY doc_id) = 1")
def doc_dedup_first(spark, sf):
    return L.first_of_equal(table(spark, sf, "documents").select("doc_id", "lang", "text"), "text", "doc_id").select("doc_id", "lang")


@query(r"WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS token FROM documents) SELECT lang, count(*) AS total, count(DISTINCT token) AS terms, round(count(*) / count(DISTINCT token), 6) AS mean, count(DISTINCT CASE WHEN token <> strip_accents(lower(token)) THEN token END) AS marked FROM t GROUP BY lang")
def token_stats(spark, sf):
    t = L.tokens(table(spark, sf, "documents"), "text", "lang").groupBy("lang", "token").agg(F.count("*").alias("n"))
    folded = F.translate(F.lower("token"), "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ", "aaaaaaaeeeeeiiiiioooooouuuuuncyy")
    return t.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("terms"), F.round(F.sum("n") / F.count("*"), 6).alias("mean"), F.count(F.when(F.col("token") != folded, 1)).alias("marked"))


@query(rf"WITH t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS token FROM documents) SELECT token FROM t WHERE token NOT IN {_list(STOP_WORDS)}")
def stopword_antijoin(spark, sf):
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "token string")
    return L.tokens(table(spark, sf, "documents"), "text").select(F.lower("token").alias("token")).distinct().join(F.broadcast(stop), "token", "left_anti")


_SETS = r"a AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS token FROM documents), b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS token FROM benchmark)"


@query(f"WITH {_SETS} SELECT 'both' AS kind, token FROM (SELECT token FROM a INTERSECT SELECT token FROM b) UNION ALL SELECT 'benchmark only', token FROM (SELECT token FROM b EXCEPT SELECT token FROM a) UNION ALL SELECT 'either', token FROM (SELECT token FROM a UNION SELECT token FROM b)")
def term_sets(spark, sf):
    a = L.tokens(table(spark, sf, "documents"), "text").select(F.lower("token").alias("token"))
    b = L.tokens(table(spark, sf, "benchmark"), "text").select(F.lower("token").alias("token"))
    kinds = {"both": a.intersect(b), "benchmark only": b.subtract(a), "either": a.union(b).distinct()}
    out = None
    for kind, df in kinds.items():
        df = df.select(F.lit(kind).alias("kind"), "token")
        out = df if out is None else out.unionByName(df)
    return out


def _turn_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return dealt(table(spark, sf, "conversations"), "conv_id").withColumn("before", F.lag("text").over(w)).filter("before IS NOT NULL")


_PAIRS = "p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations QUALIFY before IS NOT NULL)"


#: Letters outside ASCII as capitals and control characters, which lower-cased texts don't have: distances count bytes.
_LETTERS = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿßæœ"
_AS_BYTES = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1) || chr(2) || chr(3) || chr(4)"


def _bytes(x: str) -> str:
    return f"translate({x}, '{_LETTERS}', {_AS_BYTES})"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) * length({b}) = 0 THEN 0.0 ELSE 1 - levenshtein({_bytes(f'lower({a})')}, {_bytes(f'lower({b})')}) / greatest(length({a}), length({b}))::DOUBLE END"


def _norm(x: str) -> str:
    x = f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({x}, '''\\s+', '''', 'g'), '\\s+''', '''', 'g')"


_SIMILAR = (
    f"n AS (SELECT *, {_norm('text')} AS na, {_norm('before')} AS nb FROM p), m AS (SELECT *, length(na) AS la, length(nb) AS lb, string_split(na, ' ') AS wa, string_split(nb, ' ') AS wb FROM n), "
    "s AS (SELECT conv_id, turn, CASE WHEN trim(text) = '' OR trim(before) = '' THEN 0.0 WHEN text = before THEN 1.0 WHEN la = 0 AND lb = 0 THEN 1.0 WHEN la = 0 OR lb = 0 THEN 0.0 WHEN na = nb THEN 1.0 "
    "WHEN contains(na, nb) OR contains(nb, na) THEN CASE WHEN least(la, lb) / greatest(la, lb)::DOUBLE >= 0.6 THEN least(la, lb) / greatest(la, lb)::DOUBLE ELSE 0.0 END "
    f"ELSE ({_ratio('na', 'nb')} + len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))::DOUBLE) / 2 END AS similarity FROM m)"
)


@query(f"WITH {_PAIRS} SELECT conv_id, turn, round({_ratio('text', 'before')}, 6) AS ratio FROM p")
def levenshtein_ratio(spark, sf):
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.round(C.levenshtein_ratio(F.col("text"), F.col("before")), 6).alias("ratio"))


@query(rf"WITH {_PAIRS}, s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(before), '[\p{{L}}\p{{N}}_]+')) AS b FROM p) SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) END AS similarity FROM s")
def word_jaccard(spark, sf):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(L.TOKEN), F.lit(0))
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.round(C.jaccard(words("text"), words("before")), 6).alias("similarity"))


@query(f"WITH {_PAIRS}, {_SIMILAR} SELECT conv_id, turn, round(similarity, 6) AS similarity FROM s")
def text_similarity(spark, sf):
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.round(C.text_similarity(F.col("text"), F.col("before")), 6).alias("similarity"))


@query(f"WITH d AS (SELECT doc_id, {_strip('lower(text)')} AS low FROM documents) SELECT doc_id, CASE WHEN length(low) < 2 OR " + " OR ".join(f"contains(low, '{b}')" for b in BOGUS) + f" OR (len(string_split_regex(low, '{_SPACE}+')) <= 2 AND len(list_filter(string_split_regex(low, '{_SPACE}+'), lambda w: w NOT IN {_list(SILENCE_WORDS)})) = 0) THEN true ELSE false END AS dropped FROM d")
def bogus_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (C.bogus_filter(F.col("text")) == "").alias("dropped"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s+([,.!?;:])', '\1', 'g')) AS cleaned FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.clean_text(F.col("text")).alias("cleaned"))


@query(
    "WITH d AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '–', '-'), '—', '-'), '…', '...'), '€', 'EUR'), '£', 'GBP'), '¥', 'JPY'), '°', 'deg'), '±', '+/-'), '×', 'x'), '÷', '/') AS x FROM documents) "
    f"SELECT doc_id, {_strip('x')} AS shown FROM d"
)
def display_cleanup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.display_text(F.col("text")).alias("shown"))


#: Captions: one a turn, 2.5 s apart, as long as its words need.
_CAPTIONS_SQL = "c AS (SELECT conv_id, turn AS id, turn * 2.5::DOUBLE AS s, turn * 2.5::DOUBLE + least(4.0, greatest(1.5, len(string_split(text, ' ')) / 4.0))::DOUBLE AS e FROM conversations)"


def _captions(spark, sf):
    length = F.least(F.lit(4.0), F.greatest(F.lit(1.5), F.size(F.split("text", " ")) / 4.0))
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("id"), (F.col("turn") * 2.5).alias("s"), (F.col("turn") * 2.5 + length).alias("e"))


@query(f"WITH {_CAPTIONS_SQL} SELECT conv_id, id, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), CAST(floor(s % 60) AS BIGINT), CAST(floor((s - floor(s)) * 1000) AS BIGINT)) AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS number FROM c")
def srt_lines(spark, sf):
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("id")).cast("long")
    return _captions(spark, sf).select("conv_id", "id", C.srt_time(F.col("s")).alias("shown"), number.alias("number"))


#: Four frames a second up to the last caption's end.
_FRAMES_SQL = "f AS (SELECT n AS frame, n / 4.0::DOUBLE AS t FROM (SELECT unnest(generate_series(0, CAST((SELECT floor(max(e) * 4) FROM c) AS BIGINT))) AS n))"


@query(f"WITH {_CAPTIONS_SQL}, {_FRAMES_SQL} SELECT conv_id, id, frame, round(greatest(0.1, least(1.0, (t - s) / 0.1, (e - t) / 0.1))::DOUBLE, 6) AS fade FROM c JOIN f ON s <= t AND t <= e")
def caption_active_frames(spark, sf):
    return CP.frames(_captions(spark, sf), 4).select("conv_id", "id", "frame", F.round(C.fade(F.col("t"), F.col("s"), F.col("e")), 6).alias("fade"))


@query(f"WITH {_CAPTIONS_SQL}, {_FRAMES_SQL} SELECT conv_id, frame, max(id) AS latest FROM c JOIN f ON s <= t AND t <= e GROUP BY ALL")
def latest_caption_asof(spark, sf):
    return CP.frames(_captions(spark, sf), 4).groupBy("conv_id", "frame").agg(F.max_by("id", "s").alias("latest"))


@query(f"WITH {_CAPTIONS_SQL}, d AS (SELECT conv_id, conv_id * 100000 + id AS id, s, e FROM c) SELECT id FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE a.conv_id = b.conv_id AND a.id > b.id AND a.s < b.e + 1 AND a.e > b.s - 1)")
def caption_overlap_anti(spark, sf):
    c = _captions(spark, sf).withColumn("id", F.col("conv_id") * 100000 + F.col("id"))
    return L.outside_overlap(c, c, "s", "e", "conv_id").select("id")


_EVENTS = "e AS (SELECT event_id, user_id, event_type, value, ts, epoch(ts) AS t FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {_EVENTS} SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS errors FROM e")
def trailing_errors(spark, sf):
    out = L.trailing(_events(spark, sf), "user_id", F.col("ts").cast("double"), 86400, F.col("event_type") == "error", "errors")
    return out.select("event_id", "errors")


@query(f"WITH {_EVENTS} SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM e")
def rolling_20_failures(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return _events(spark, sf).select("event_id", F.sum((F.col("event_type") == "error").cast("long")).over(w).alias("failures"))


@query(f"WITH {_EVENTS}, g AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM e WHERE value IS NOT NULL GROUP BY user_id) SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, x: CASE WHEN a = 0 THEN x ELSE 0.1 * x + 0.9 * a END), 4) AS ema FROM g")
def ema_by_user(spark, sf):
    e = _events(spark, sf).filter("value IS NOT NULL").select("user_id", "ts", "event_id", "value")
    return L.last_mean(e, "user_id", ["ts", "event_id"], "value").select("user_id", F.round("ema", 4).alias("ema"))


@query(f"WITH {_EVENTS}, w AS (SELECT event_id, event_type, CAST(floor(t / 12600) AS BIGINT) AS k, t FROM e), x AS (SELECT event_type, (k - d) * 12600 AS start, t FROM w, unnest([0, 1]) AS g(d)) SELECT event_type, CAST(start AS BIGINT) AS start, count(*) AS n FROM x WHERE t >= start AND t < start + 18000 GROUP BY ALL")
def sliding_window_counts(spark, sf):
    w = F.window("ts", "18000 seconds", "12600 seconds")
    return _events(spark, sf).groupBy("event_type", w).agg(F.count("*").alias("n")).select("event_type", F.unix_timestamp("window.start").alias("start"), "n")


@query(f"WITH {_EVENTS}, g AS (SELECT user_id, ts, CASE WHEN floor(t) - floor(lag(t) OVER (PARTITION BY user_id ORDER BY ts)) > 21600 THEN 1 ELSE 0 END AS fresh FROM e), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY ALL")
def session_gaps(spark, sf):
    return L.sessions(_events(spark, sf), "user_id", "ts", 21600).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query(f"WITH {_EVENTS}, g AS (SELECT user_id, ts, event_id, value > 100 AS high, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > 100 ORDER BY ts, event_id) AS island FROM e WHERE value IS NOT NULL) SELECT user_id, min(event_id) AS first, count(*) AS n FROM g WHERE high GROUP BY user_id, island HAVING count(*) >= 2")
def high_value_islands(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = Window.partitionBy("user_id", "high").orderBy("ts", "event_id")
    e = _events(spark, sf).filter("value IS NOT NULL").withColumn("high", F.col("value") > 100).withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    return e.filter("high").groupBy("user_id", "island").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).filter("n >= 2").select("user_id", "first", "n")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def bounded_buffer(spark, sf):
    e = _events(spark, sf).withColumn("at", F.struct("ts", "event_id"))
    return L.keep_last(e, "user_id", "at", 5).select("event_id", "user_id")


@query("WITH g AS (SELECT user_id, ts, event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT event_id, round(avg(gap) OVER w, 3) AS mean, round(min(gap) OVER w, 3) AS least, round(max(gap) OVER w, 3) AS most FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def gap_statistics(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.col("ts").cast("double")
    e = _events(spark, sf).withColumn("gap", t - F.lag(t).over(w))
    v = w.rowsBetween(-9, 0)
    return e.select("event_id", *(F.round(f("gap").over(v), 3).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"))))


_DICT = "d AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{c}', {i})" for i, (w, c) in enumerate(CANONICAL.items())) + ") AS v(wrong, canonical, entry))"
_WORDS = r"w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS word FROM documents)"


@query(f"WITH {_DICT}, {_WORDS} SELECT word, canonical FROM w JOIN d ON word = wrong")
def dict_exact_correct(spark, sf):
    words = L.tokens(table(spark, sf, "documents"), "text").select(F.lower("token").alias("word")).distinct()
    return words.join(F.broadcast(L.dictionary(spark)), words.word == F.col("wrong")).select("word", "canonical")


def _shorter(x: str, i: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda {i}: substr({x}, 1, {i} - 1) || substr({x}, {i} + 1))"


def _variants(x: str) -> str:
    return f"list_distinct(list_concat([{x}], {_shorter(x, 'i')}, flatten(list_transform({_shorter(x, 'j')}, lambda y: {_shorter('y', 'k')}))))"


@query(
    f"WITH {_DICT}, {_WORDS}, p AS (SELECT word, wrong, canonical, entry, levenshtein({_bytes('word')}, {_bytes('wrong')}) AS distance FROM w JOIN d ON length(word) >= 3 AND abs(length(word) - length(wrong)) <= 2 AND levenshtein({_bytes('word')}, {_bytes('wrong')}) <= 2), "
    f"r AS (SELECT *, 200 * list_max(list_transform(list_intersect({_variants('word')}, {_variants('wrong')}), lambda z: length(z))) / (length(word) + length(wrong))::DOUBLE AS ratio FROM p) "
    "SELECT word, canonical, CAST(distance AS BIGINT) AS distance FROM r WHERE ratio >= 80 QUALIFY row_number() OVER (PARTITION BY word ORDER BY ratio DESC, entry) = 1"
)
def dict_fuzzy_lev2(spark, sf):
    words = L.tokens(table(spark, sf, "documents"), "text").select(F.lower("token").alias("word"))
    return L.fuzzy_corrections(words, L.dictionary(spark)).select("word", "canonical", F.col("distance").cast("long").alias("distance"))


@query(r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+'), 1) AS pos FROM documents), g AS (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM t) SELECT doc_id, count(*) AS repeats FROM g WHERE token = before GROUP BY doc_id")
def word_runs(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(L.TOKEN), F.lit(0))
    shifted = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(shifted, lambda x: x)).cast("long").alias("repeats")).filter("repeats > 0")


@query(None)
def cross_segment_clean(spark, sf):
    return L.clean_streams(table(spark, sf, "conversations"))


@query(None)
def sentence_states(spark, sf):
    return L.sentence_states(spread(table(spark, sf, "conversations")), "text", "conv_id", "turn").groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(None)
def glossary_terms(spark, sf):
    d = table(spark, sf, "documents").withColumn("chapter", (F.col("doc_id") % 18 + 1).cast("int"))
    return L.glossary(d, "text", "doc_id", "chapter", "source", top=200).select("token", "n", F.size("chapters").alias("chapters"), F.size("sources").alias("sources"), "contexts")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def page_hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"))


# Relational categories without a counterpart of their own, on the star schema


@query("SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_region_nation(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 4) AS discount, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 4).alias("discount"), F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_large_orders(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_no_orders(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quartile FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY CAST(floor(o_totalprice / 1000) AS BIGINT))")
def ranking(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.floor(F.col("o_totalprice") / 1000))
    v = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(v).cast("long").alias("quartile"))
