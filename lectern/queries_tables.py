"""Named queries: joins by time and likeness, summaries that merge, recursive and correlated SQL, tables dealt by a key,
functions on tables, numbers observed, pages in folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import udfs as U
from lectern.functions.aggregates import skewness
from lectern.operators import corpus as K
from lectern.operators import library as L
from lectern.operators import neighbourhood as N
from lectern.operators import summaries as SM
from lectern.operators.asof import asof_join
from lectern.queries import _events, query, table
from lectern.sinks.bucketed import bucketed, buckets_for
from lectern.sinks.shared import folder, written
from lectern.sources import pages as P
from lectern.streaming.metrics import policy_counters

# Likeness and time

#: Letters outside ASCII as others, so that a distance of bytes is one of characters.
_LETTERS = ("àáâäãåçèéêëìíîïñòóôöõùúûüýÿßæœ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%")


def _plain_words(name: str) -> str:
    return f"SELECT DISTINCT word, translate(word, '{_LETTERS[0]}', '{_LETTERS[1]}') AS plain, length(word) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS word FROM {name})"


@query(
    f"WITH a AS ({_plain_words('documents')}), b AS ({_plain_words('benchmark')}), p AS (SELECT a.word, b.word AS term, levenshtein(a.plain, b.plain) AS distance, least(a.n, b.n) AS n FROM a JOIN b ON abs(a.n - b.n) <= 2) "
    "SELECT word, term, CAST(distance AS BIGINT) AS distance FROM p WHERE distance <= CASE WHEN n < 3 THEN 0 WHEN n < 6 THEN 1 ELSE 2 END"
)
def fuzzy_benchmark_words(spark, sf):
    """Words of documents with the words of the benchmark that are like them."""
    words, terms = (L.tokens(table(spark, sf, t), "text").select(F.lower("token").alias(c)) for t, c in (("documents", "word"), ("benchmark", "term")))
    return N.fuzzy_join(words, terms, "word", "term").withColumn("distance", F.col("distance").cast("long"))


@query("SELECT a.event_id, coalesce(CASE WHEN a.ts - b.ts <= INTERVAL 5 DAY THEN b.error_id END, -1) AS error_id, CASE WHEN a.ts - b.ts <= INTERVAL 5 DAY THEN b.error_value END AS error_value FROM events a ASOF LEFT JOIN (SELECT event_id AS error_id, user_id, ts, value AS error_value FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def last_error_asof(spark, sf):
    """Each event with its user's last error of the five days before it."""
    e = _events(spark, sf)
    errors = e.filter("event_type = 'error'").select("user_id", F.col("ts").alias("error_at"), F.col("event_id").alias("error_id"), F.col("value").alias("error_value"))
    return asof_join(e.select("event_id", "user_id", "ts"), errors, ["user_id"], "ts", "error_at", 86400.0, within=5 * 86400.0).select("event_id", F.coalesce("error_id", F.lit(-1)).alias("error_id"), "error_value")


# Summaries

_LANG_TOKENS = r"t AS (SELECT lang, source, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS token FROM documents)"


@query(f"WITH {_LANG_TOKENS} SELECT lang, source, count(*) AS n, count(DISTINCT token) AS terms, true AS near FROM t GROUP BY ROLLUP (lang, source)")
def merged_sketches(spark, sf):
    """Different tokens by language and source from stored sketches, rolled up, against exact numbers: near within 3 %."""
    t = L.tokens(table(spark, sf, "documents"), "text", "lang", "source")
    guess = SM.rolled_up(written(SM.sketches(t, ["lang", "source"], "token"), "sketches"), ["lang", "source"])
    guess = guess.select(F.col("lang").alias("l"), F.col("source").alias("s"), "level", "n", F.hll_sketch_estimate("seen").alias("guess"))
    exact = t.rollup("lang", "source").agg(F.countDistinct("token").alias("terms"), (F.lit(2) - F.grouping("lang") - F.grouping("source")).alias("depth"))
    met = exact.join(guess, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("depth") == F.col("level")))
    return met.select("lang", "source", "n", "terms", (F.abs(F.col("guess") - F.col("terms")) <= 0.03 * F.col("terms") + 2).alias("near"))


_SHARES = [0.01, 0.25, 0.5, 0.9, 0.999]


@query(f"WITH r AS (SELECT l_returnflag, l_extendedprice AS value, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL) SELECT l_returnflag, share, CAST(value AS DOUBLE) AS value FROM r, (SELECT unnest({_SHARES}::DOUBLE[]) AS share) WHERE r = greatest(1, ceil(share * n))")
def exact_percentiles(spark, sf):
    return SM.percentiles(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], _SHARES)


@query("SELECT lang, count(*) AS n, true AS near FROM documents GROUP BY lang")
def sketched_medians(spark, sf):
    """Medians of text lengths from sketches of each source, merged by language: near within 2 % of ranks."""
    d = table(spark, sf, "documents").select("lang", "source", F.length("text").alias("chars"))
    guess = SM.merged(written(SM.sketches(d, ["lang", "source"], values="chars"), "sketches"), ["lang"]).select("lang", "n", F.kll_sketch_get_quantile_double("spread", F.lit(0.5)).alias("guess"))
    ends = SM.percentiles(d, "chars", ["lang"], [0.48, 0.52]).groupBy(F.col("lang").alias("l")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return guess.join(ends, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "n", F.col("guess").between(F.col("lo"), F.col("hi")).alias("near"))


@query("SELECT event_type, count(value) AS n, round(stddev_samp(value), 6) AS deviation, round(var_pop(value), 6) AS variance, round((avg(value ^ 3) - 3 * avg(value) * var_pop(value) - avg(value) ^ 3) / stddev_pop(value) ^ 3, 5) AS skewness FROM events GROUP BY event_type")
def value_spread(spark, sf):
    e = table(spark, sf, "events")
    plain = e.groupBy(F.col("event_type").alias("t")).agg(F.round(F.stddev_samp("value"), 6).alias("deviation"), F.round(F.var_pop("value"), 6).alias("variance"))
    return skewness(e, "value", "event_type").join(plain, F.col("event_type") == F.col("t")).select("event_type", "n", "deviation", "variance", F.round("skewness", 5).alias("skewness"))


_DRAWN = {"en": 0.1, "fr": 0.5, "de": 0.25}


@query("SELECT doc_id, lang FROM documents WHERE ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _DRAWN.items()) + " END")
def stratified_documents(spark, sf):
    """A share of each language's documents, drawn by a hash; sampling is the feature."""
    return SM.stratified(table(spark, sf, "documents"), "lang", "doc_id", _DRAWN).select("doc_id", "lang")


# SQL of one text for both engines


def _shared(sql: str, *tables: str):
    """The oracle's text, and what runs it on a session."""
    return sql.format(**{t: t for t in tables}), lambda spark, sf, text=sql: spark.sql(text, **{t: table(spark, sf, t) for t in tables})


_CHAINS = (
    "WITH RECURSIVE chain AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars, CAST(1 AS BIGINT) AS depth FROM {conversations} WHERE turn = 0 "
    "UNION ALL SELECT c.conv_id, c.turn, chain.chars + length(c.text), chain.depth + 1 FROM chain JOIN {conversations} c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 1) "
    "SELECT conv_id, max(depth) AS turns, max(chars) AS chars FROM chain GROUP BY conv_id"
)
_sql, _chains = _shared(_CHAINS, "conversations")


@query(_sql)
def reply_chains(spark, sf):
    """Each conversation from its first turn on, reply by reply. Spark gives up after 100 steps unless told otherwise."""
    return _chains(spark, sf, _CHAINS.replace("chain AS (", "chain MAX RECURSION LEVEL 100000 AS (", 1))


_sql, _above = _shared("SELECT c.c_custkey, c.c_acctbal FROM {customer} c WHERE c.c_acctbal > (SELECT avg(d.c_acctbal) FROM {customer} d WHERE d.c_nationkey = c.c_nationkey)", "customer")


@query(_sql)
def above_nation_average(spark, sf):
    """A correlated scalar subquery, which the engine turns into a join with an aggregate."""
    return _above(spark, sf)


_sql, _largest = _shared("SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM {customer} c, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o", "customer", "orders")


@query(_sql)
def largest_orders_lateral(spark, sf):
    return _largest(spark, sf)


_sql, _page = _shared("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100", "orders")


@query(_sql)
def third_page_of_orders(spark, sf):
    """A page of a report."""
    return _page(spark, sf)


_sql, _late = _shared("SELECT o.o_orderpriority, count(*) AS n FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) AND o.o_totalprice > (SELECT avg(x.o_totalprice) FROM {orders} x) GROUP BY o.o_orderpriority", "orders", "lineitem")


@query(_sql)
def bulky_orders_by_priority(spark, sf):
    return _late(spark, sf)


@query(
    "SELECT event_id, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, CAST(date_part('quarter', ts) AS INT) AS quarter, CAST(dayofweek(ts) + 1 AS INT) AS day, CAST(weekofyear(ts) AS INT) AS number, CAST(last_day(ts) AS VARCHAR) AS month_end, "
    "CAST(CAST(CAST(ts AS DATE) + INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS later, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS days, strftime(ts, '%Y/%m/%d %H:%M') AS shown, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour FROM events"
)
def event_calendar(spark, sf):
    ts = F.col("ts")
    return _events(spark, sf).select(
        "event_id", F.to_date(F.date_trunc("week", ts)).cast("string").alias("week"), F.quarter(ts).alias("quarter"), F.dayofweek(ts).alias("day"), F.weekofyear(ts).alias("number"), F.last_day(ts).cast("string").alias("month_end"),
        F.add_months(F.to_date(ts), 2).cast("string").alias("later"), F.date_diff(F.to_date(ts), F.lit("2024-01-01").cast("date")).alias("days"), F.date_format(ts, "yyyy/MM/dd HH:mm").alias("shown"),
        F.unix_timestamp(F.date_trunc("hour", ts)).alias("hour"),
    )


# Tables dealt by a key

_TOTALS = "SELECT o_orderpriority, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority"


def _totals(orders, lines):
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def co_partitioned(spark, sf):
    """Orders and their lines as tables of buckets by order, as many as their size asks for."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    many = buckets_for(orders, lines)
    return bucketed(orders, "o_orderkey", many, "orders"), bucketed(lines, "l_orderkey", many, "lines")


@query(_TOTALS)
def co_partitioned_totals(spark, sf):
    """Neither table is shuffled for the join."""
    orders, lines = co_partitioned(spark, sf)
    return _totals(orders.hint("merge"), lines)


@query(_TOTALS)
def hash_joined_totals(spark, sf):
    """A join for which the smaller side's partitions are hashed, not sorted."""
    return _totals(table(spark, sf, "orders").hint("shuffle_hash"), table(spark, sf, "lineitem"))


# Functions on tables


@query(
    "WITH RECURSIVE s AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), "
    "r AS (SELECT user_id, event_id, k, t AS last, true AS emitted FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.event_id, s.k, CASE WHEN s.t - r.last >= 43200 THEN s.t ELSE r.last END, s.t - r.last >= 43200 FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1) "
    "SELECT user_id, event_id, emitted FROM r"
)
def rate_limited_by_sql(spark, sf):
    """A state machine as a table function of SQL."""
    U.register(spark)
    rows = _events(spark, sf).select("user_id", "event_id", F.col("ts").cast("double").alias("at"))
    return spark.sql("SELECT user_id, event_id, emitted FROM run_machine(TABLE (SELECT * FROM {rows}) PARTITION BY user_id ORDER BY (event_id), 'rate_limiter', '43200')", rows=rows)


@query(None)  # tests hold it against cross_segment_clean
def cleaned_by_sql(spark, sf):
    """Segments cleaned against their stream's history, from SQL."""
    U.register(spark)
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), "text")
    return spark.sql("SELECT * FROM run_machine(TABLE (SELECT * FROM {rows}) PARTITION BY stream ORDER BY (seq), 'segment_cleaner', 'OFF')", rows=rows).drop("text")


# Numbers observed while a plan runs


@query("SELECT 'empty' AS strategy, count(*) FILTER (role = 'user') AS applied, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::DOUBLE AS seconds FROM conversations UNION ALL SELECT 'static_common', count(*) FILTER (role <> 'user'), coalesce(sum(length(text)) FILTER (role <> 'user'), 0)::DOUBLE FROM conversations")
def policy_counts(spark, sf):
    """How often each glossary policy was applied, counted in the pass that applies them."""
    rows = table(spark, sf, "conversations")
    chosen = K.no_glossary(rows.filter("role = 'user'")).unionByName(K.common_glossary(rows.filter("role <> 'user'")))
    chosen = chosen.withColumn("took", F.length("text").cast("double"))
    counted, seen = policy_counters(chosen, "policies", "strategy", ["empty", "static_common"], "took")
    counted.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(k, got[f"{k}_applied"], got[f"{k}_seconds"]) for k in ("empty", "static_common")], "strategy string, applied long, seconds double")


# Pages in folders


@query("SELECT url, length(html) AS chars, md5(html) AS digest, CAST(1 AS INT) AS tries FROM pages")
def pages_from_folder(spark, sf):
    """The pages as a folder of files, read by the library's data source."""
    P.register(spark)
    path = folder(spark, "pages")
    table(spark, sf, "pages").select("url", "html").write.json(path)
    rows = spark.read.format("page_folder").option("path", path).load()
    return rows.select("url", F.length("html").cast("long").alias("chars"), F.md5("html").alias("digest"), "tries")
