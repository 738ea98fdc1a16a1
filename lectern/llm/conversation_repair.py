"""Conversation structure repair by weighted finite-state composition.

Three automata are composed: the acceptor of a conversation's turns (one arc a turn: role initial and fault), a transducer
of edits (Keep, Rerole, Delete, Insert with their costs) and the acceptor of the role grammar ``(s?(ua)+)?``. Weights are
pairs (cost, label string) in lexicographic order; strings are the edits' initials. The composition is never built: the
states behind a turn are pairs of its place and a grammar state, and only those that a finite weight reaches are expanded,
in topological order (by place), so one pass finds the shortest path. Two paths between the same states over the same
turns with equal costs have strings of which neither is a prefix of the other (an Insert more costs more), hence a least
string stays the least with whatever follows, and the weights of consecutive parts of a conversation can be multiplied
in any grouping: a 4 x 4 matrix of weights stands for a part.

That is what splits a long conversation. Turns without their texts are sorted by ranges of (conversation, turn), so a
conversation of any length lies in as many partitions as it fills; each task folds the turns of a part (``PART`` labels at
most) to a matrix; a conversation's matrices, one row for each part, are multiplied in order. Texts move once, to be
edited and digested in order, in a stream that holds one turn. Only this last step (a digest is sequential) handles a
conversation in one task. Equal rows of a conversation are one row with a count until then.

Edge cases: null roles and texts count as one space; null turns come first; a null conversation is one of its own; turns
with an equal number are in the order of role and the SHA-256 of the text; equal rows are adjacent, and all but the first
are duplicates; an empty table gives an empty result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.storage import written

#: Grammar states: nothing yet, after s, after u, after a; and what each role initial leads to.
START, S, U, A = range(4)
GRAMMAR = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
FINAL = (True, False, False, True)
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Labels of one part of a conversation.
PART = 512
#: Characters that a blank turn has only.
SPACE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]


def _next(state: int) -> tuple[str, int]:
    """The one role initial that Insert and Rerole can give behind a state, and where it leads."""
    letter = "a" if state == U else "u"
    return letter, GRAMMAR[state][letter]


def arcs(initial: str, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For each grammar state the edits of one turn: (state after it, cost, labels). Two Inserts before a turn lead to
    where none leads, and an Insert before a Delete sorts behind one after it, so neither is needed."""
    out: list[list[tuple[int, int, str]]] = []
    for state in range(4):
        own = [(state, DELETE, "D")]
        for cost, label, at in ((0, "", state), (INSERT, "I", _next(state)[1])):
            if initial in GRAMMAR[at]:
                own.append((GRAMMAR[at][initial], cost + TRUNCATED * truncated, label + "K"))
            own.append((_next(at)[1], cost + REROLE + TRUNCATED * truncated, label + "R"))
        out.append(own)
    return out


ARCS = {(x, t): arcs(x, t) for x in ("s", "u", "a", "") for t in (False, True)}


def step(row: dict[int, Weight], initial: str, truncated: bool) -> dict[int, Weight]:
    """Weights of the states after one more turn, from those before it."""
    table, out = ARCS[initial if initial in ("s", "u", "a") else "", truncated], {}
    for state, (cost, labels) in row.items():
        for to, more, label in table[state]:
            now = (cost + more, labels + label)
            if to not in out or now < out[to]:
                out[to] = now
    return out


def ended(row: dict[int, Weight]) -> Weight:
    """The least weight of a path that ends, with Inserts behind the last turn."""
    found = []
    for state, (cost, labels) in row.items():
        while not FINAL[state]:
            state, cost, labels = _next(state)[1], cost + INSERT, labels + "I"
        found.append((cost, labels))
    return min(found)


def product(row: dict[int, Weight], part: dict[int, dict[int, Weight]]) -> dict[int, Weight]:
    out: dict[int, Weight] = {}
    for state, (cost, labels) in row.items():
        for to, (more, own) in part[state].items():
            now = (cost + more, labels + own)
            if to not in out or now < out[to]:
                out[to] = now
    return out


class _Part:
    """A run of turns of one conversation: its matrix and its numbers."""

    def __init__(self, starts):
        self.rows = {s: {s: (0, "")} for s in starts}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.size = 0

    def add(self, n: int, turn, initial: str, blank: bool, later: bool, truncated: bool) -> None:
        if not n:
            return
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = initial if self.first is None else self.first, initial
        gone = n
        if blank:
            self.blank += n
        elif later:
            self.duplicate += n
        else:
            gone = n - 1
            self.duplicate += gone
            self.truncated += truncated
            self.rows = {s: step(r, initial, truncated) for s, r in self.rows.items()}
        if gone:
            self.rows = {s: {q: (c + DELETE * gone, x + "D" * gone) for q, (c, x) in r.items()} for s, r in self.rows.items()}
        self.size += n

    def record(self, conv, seq: int) -> tuple:
        weights = [(s, q, c, x) for s, r in self.rows.items() for q, (c, x) in r.items()]
        numbers = (self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last)
        return (conv, seq, *numbers, [dict(zip(("s", "q", "cost", "labels"), w, strict=True)) for w in weights])


_NUMBERS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
_PARTS = f"seq long, {_NUMBERS}, weights array<struct<s:int,q:int,cost:long,labels:string>>"


def _schema(conv: T.StructField, more: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv.dataType), *T._parse_datatype_string(more).fields])


def _batches(rows, schema: pa.Schema, size: int = 500):
    """Arrow batches of tuples."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _tuples(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_NONE = object()


def _folded(schema: pa.Schema):
    """Parts of the conversations of one range of sorted rows. Only a run that begins inside the range is known to begin
    its conversation; the others are folded from all four states."""

    def parts(batches):
        conv, part, seq = _NONE, None, TaskContext.get().partitionId() << 32
        for own, turn, n, initial, blank, later, truncated in _tuples(batches):
            if own != conv or part.size >= PART:
                if part is not None:
                    yield part.record(conv, seq)
                    seq += 1
                part = _Part(range(4) if conv is _NONE or own == conv else (START,))
                conv = own
            part.add(n, turn, initial, blank, later, truncated)
        if part is not None:
            yield part.record(conv, seq)

    return lambda batches: _batches(parts(batches), schema)


def _joined(schema: pa.Schema):
    """A row for each conversation from its parts in order."""

    def whole(conv, state) -> tuple:
        row, blank, duplicate, truncated, illegal, turns, low, high, _ = state
        cost, audit = ended(row)
        return (conv, 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, cost, audit)

    def runs(batches):
        conv, state = _NONE, None
        for own, _, blank, duplicate, truncated, illegal, turns, low, high, first, last, weights in _tuples(batches):
            matrix: dict[int, dict[int, Weight]] = {}
            for w in weights:
                matrix.setdefault(w["s"], {})[w["q"]] = (w["cost"], w["labels"])
            if own != conv or state is None:
                if state is not None:
                    yield whole(conv, state)
                conv, state = own, [matrix[START], blank, duplicate, truncated, illegal, turns, low, high, last]
                continue
            state[0] = product(state[0], matrix)
            for k, x in enumerate((blank, duplicate, truncated, illegal, turns), 1):
                state[k] += x
            state[4] += first is not None and state[8] is not None and state[8] + first not in ("su", "ua", "au")
            state[5] -= low is not None and low == state[7]
            state[6] = low if state[6] is None else state[6]
            state[7] = state[7] if high is None else high
            state[8] = state[8] if last is None else last
        if state is not None:
            yield whole(conv, state)

    return lambda batches: _batches(runs(batches), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _named(turns: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """conv, turn, role, text, digest and whether the row counts; one that doesn't only tells of its conversation."""
    there = F.lit(True) if present is None else present
    rows = turns.select(
        turns[conv].alias("conv"), F.when(there, turns[turn].cast("long")).alias("turn"), F.when(there, F.coalesce(turns[role], F.lit(" "))).alias("role"),
        F.when(there, F.coalesce(turns[text], F.lit(" "))).alias("text"), there.alias("present"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _order() -> list[Column]:
    """Of a conversation's turns."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def repairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """A row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows for which
    ``present`` is false only make their conversation occur."""
    seen = F.rtrim("text", F.lit(SPACE))
    rows = _named(turns, conv, turn, role, text, present)
    rows = rows.withColumn("blank", seen == "").withColumn("truncated", ~F.right(seen, F.lit(1)).isin(".", "!", "?"))
    counted = rows.groupBy("conv", "turn", "role", "digest").agg(F.count_if("present").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    counted = written(counted, "turns")
    when = F.struct(F.col("turn").isNotNull(), "turn")
    same = counted.filter("n > 0 AND NOT blank").groupBy("conv", "role", "digest").agg(F.min(when).alias("earliest"), F.count("*").alias("places")).filter("places > 1")
    same = written(same.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "earliest"), "repeated")
    met = counted.join(same, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(F.col("earliest") != when, F.lit(False))
    met = written(met.select("conv", "turn", "role", "digest", "n", F.left("role", F.lit(1)).alias("initial"), "blank", later.alias("later"), "truncated"), "faults")
    one = met.schema["conv"]
    schema = _schema(one, _PARTS)
    ranged = met.repartitionByRange("conv", *_order()).sortWithinPartitions("conv", *_order()).select("conv", "turn", "n", "initial", "blank", "later", "truncated")
    parts = written(ranged.mapInArrow(_folded(_arrow(schema)), schema), "parts")
    schema = _schema(one, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return parts.repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(_joined(_arrow(schema)), schema)


def _lines(batches):
    """(conversation, place, edit, role, text) of the repaired turns, in order, with a row (conversation, None, ...) at
    the head of each conversation."""
    conv = audit = _NONE
    state = at = place = 0

    def inserted():
        nonlocal state, at, place
        while at < len(audit) and audit[at] == "I":
            letter, state = _next(state)
            at, place = at + 1, place + 1
            yield conv, place, "I", "user" if letter == "u" else "assistant", ""

    for own, marks, role, text in _tuples(batches):
        if marks is not None:
            if conv is not _NONE:
                yield from inserted()
            conv, audit, state, at, place = own, marks, START, 0, 0
            yield conv, None, None, None, None
            continue
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        if edit == "R":
            letter, state = _next(state)
            role = "user" if letter == "u" else "assistant"
        else:
            state = GRAMMAR[state][role[0]]
        place += 1
        yield conv, place, edit, role, text
    if conv is not _NONE:
        yield from inserted()


def _ordered(found: DataFrame, turns: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Each conversation's audit and behind it its turns in order."""
    rows = _named(turns, conv, turn, role, text, present).filter("present").select("conv", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "digest")
    heads = found.select("conv", F.lit(0).alias("kind"), "audit", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest")))
    both = rows.unionByName(heads).repartition("conv")
    return both.sortWithinPartitions("conv", "kind", *_order()).select("conv", "audit", "role", "text")


def repaired_turns(found: DataFrame, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired turns of the conversations that ``repairs`` found: conv, place (from 1), edit, role, text."""
    schema = _schema(found.schema["conv"], "place long, edit string, role string, text string")
    arrow = _arrow(schema)
    return _ordered(found, turns, conv, turn, role, text, present).mapInArrow(lambda b: _batches((x for x in _lines(b) if x[1] is not None), arrow), schema)


def repaired_digests(found: DataFrame, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """conv and the SHA-256 of its repaired turns, ``role:text`` joined by line feeds."""
    schema = _schema(found.schema["conv"], "repaired_sha256 string")
    arrow = _arrow(schema)

    def digests(batches):
        conv, digest = _NONE, None
        for own, place, _, role, text in _lines(batches):
            if place is None:
                if conv is not _NONE:
                    yield conv, digest.hexdigest()
                conv, digest = own, hashlib.sha256()
                continue
            digest.update((("\n" if place > 1 else "") + f"{role}:{text}").encode())
        if conv is not _NONE:
            yield conv, digest.hexdigest()

    return _ordered(found, turns, conv, turn, role, text, present).mapInArrow(lambda b: _batches(digests(b), arrow), schema)


def damaged(turns: DataFrame) -> DataFrame:
    """The query's damage by crc32(``conv_id:turn``) % 20, nulls as one space: conv_id, turn, role, text, present. A
    dropped row stays, marked as not present, so that its conversation is known."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(copies).alias("_copy")).drop("_copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """A row for each conversation of the damaged table: gaps, faults, cheapest repair and the repaired text's digest."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    found = written(repairs(rows, present=F.col("present")), "repairs")
    digests = repaired_digests(found, rows, present=F.col("present")).withColumnRenamed("conv", "c")
    out = found.join(digests, F.col("conv").eqNullSafe(F.col("c")))
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _crc_table() -> str:
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return "[" + ", ".join(map(str, out)) + "]"


#: Backwards from the last turn: the least (cost, labels) from each grammar state to the end, one recursion a turn. The
#: first labels of the choices of a state differ, so the order of (cost, labels) needs no more than the strings.
OP13_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {_crc_table()} AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM conversations, crc),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, (VALUES (1), (2)) AS c(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
numbered AS (SELECT *, substr(role, 1, 1) AS x, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
  count(*) OVER (PARTITION BY conv_id) AS n FROM dam),
faults AS (SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
back AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'l': ''}} AS f, {{'c': 6, 'l': 'II'}} AS s, {{'c': 3, 'l': 'I'}} AS u, {{'c': 0, 'l': ''}} AS a
  FROM (SELECT DISTINCT conv_id, n FROM numbered)
  UNION ALL
  SELECT conv_id, i, least(f0, {{'c': u1.c + 3, 'l': 'I' || u1.l}}), least(s0, {{'c': u1.c + 3, 'l': 'I' || u1.l}}), u1, a1
  FROM (SELECT *, least(u0, {{'c': a0.c + 3, 'l': 'I' || a0.l}}) AS u1, least(a0, {{'c': u0.c + 3, 'l': 'I' || u0.l}}) AS a1
  FROM (SELECT r.conv_id, r.i,
    CASE WHEN gone THEN df ELSE least(df, CASE WHEN r.x = 's' THEN {{'c': b.s.c + t, 'l': 'K' || b.s.l}} WHEN r.x = 'u' THEN ku ELSE ru END, ru) END AS f0,
    CASE WHEN gone THEN ds ELSE least(ds, CASE WHEN r.x = 'u' THEN ku ELSE ru END, ru) END AS s0,
    CASE WHEN gone THEN du ELSE least(du, CASE WHEN r.x = 'a' THEN {{'c': b.a.c + t, 'l': 'K' || b.a.l}} ELSE {{'c': b.a.c + t + 3, 'l': 'R' || b.a.l}} END) END AS u0,
    CASE WHEN gone THEN da ELSE least(da, CASE WHEN r.x = 'u' THEN ku ELSE ru END, ru) END AS a0
    FROM back b JOIN (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM faults) r
      ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.i = r.i + 1,
    LATERAL (SELECT {{'c': b.f.c + 4, 'l': 'D' || b.f.l}} AS df, {{'c': b.s.c + 4, 'l': 'D' || b.s.l}} AS ds, {{'c': b.u.c + 4, 'l': 'D' || b.u.l}} AS du, {{'c': b.a.c + 4, 'l': 'D' || b.a.l}} AS da,
      {{'c': b.u.c + t, 'l': 'K' || b.u.l}} AS ku, {{'c': b.u.c + t + 3, 'l': 'R' || b.u.l}} AS ru) AS o))),
best AS (SELECT conv_id, f.c AS cost, f.l AS audit FROM back WHERE i = 1),
marks AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS p FROM best WHERE audit <> ''),
made AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS i,
  sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS place,
  sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS places FROM marks),
lines AS (SELECT m.conv_id, p, CASE WHEN edit = 'K' THEN r.role WHEN (places - place) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END AS line
  FROM made m LEFT JOIN faults r ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.i = r.i WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS repaired FROM lines GROUP BY conv_id),
numbers AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN numbers k ON o.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts x ON o.conv_id IS NOT DISTINCT FROM x.conv_id
"""
