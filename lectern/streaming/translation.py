"""Translations of a live stream: a buffer by time, and a cache of a fixed size, both in typed state.

A caption is translated to every target language when it comes, and the translations wait in a buffer for ``KEEP`` seconds
of the stream's own time, so that they are there when the caption is shown. Every translation goes through a cache; when
that holds more than ``MOST`` entries, the ``EVICTED`` that came first go. A call to the state store costs far more than a
row, so a stream's state is read and written once a micro-batch: what the buffer holds with the stream's numbers, and the
cache in blocks of ``EVICTED`` entries by place, of which only those that got entries are written. A stream has one timer of
event time, so a silent stream's buffer goes when the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that the buffer keeps an entry; entries that the cache holds, and those that go once there are more.
KEEP, MOST, EVICTED = 30.0, 1000, 100

OUT = "lang string, asked double, translated string, found string"


class _Cache:
    """Translations in the order in which they came, in blocks of ``evicted`` places."""

    def __init__(self, state, first: int, following: int, most: int, evicted: int):
        self.state, self.first, self.next, self.most, self.evicted = state, first, following, most, evicted
        self.made: dict[tuple[str, str], str] = {}
        self.blocks: dict[int, list[tuple[str, str]]] = {}
        if following > first:
            for (block,), (texts, langs, made) in state.iterator():
                self.blocks[block] = list(zip(texts, langs, strict=True))
                self.made.update(zip(self.blocks[block], made, strict=True))
        self.stored, self.changed = set(self.blocks), set()

    def translated(self, text: str, lang: str, translate: Callable[[str, str], str]) -> tuple[str, str]:
        """The translation, and whether the cache had it."""
        if (text, lang) in self.made:
            return self.made[text, lang], "cache"
        made = self.made[text, lang] = translate(text, lang)
        block = self.next // self.evicted
        self.blocks.setdefault(block, []).append((text, lang))
        self.changed.add(block)
        self.next += 1
        if self.next - self.first > self.most:
            for entry in self.blocks.pop(self.first // self.evicted):
                del self.made[entry]
            self.first += self.evicted
        return made, "translator"

    def save(self) -> None:
        for block in self.stored - set(self.blocks):
            self.state.removeKey((block,))
        for block in self.changed & set(self.blocks):
            entries = self.blocks[block]
            self.state.updateValue((block,), ([text for text, _ in entries], [lang for _, lang in entries], [self.made[x] for x in entries]))


class Translations(StatefulProcessor):
    """For each row (at, text, asked, asked_text): the text is translated and buffered, older entries go, and what was asked
    for comes out for each language, with where it was found: buffer, cache or translator."""

    def __init__(self, langs: list[str], translate: Callable[[str, str], str], columns: list[str], keep: float = KEEP, most: int = MOST, evicted: int = EVICTED):
        if not 0 < evicted <= most:
            raise ValueError("evicted has to be from 1 to most")
        self.langs, self.translate, self.row, self.keep, self.most, self.evicted = langs, translate, Row(*columns), keep, most, evicted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "first long, next long, timed boolean, at array<double>, lang array<string>, text array<string>")
        self.cache = handle.getMapState("cache", "block long", "text array<string>, lang array<string>, translated array<string>")

    def _load(self) -> tuple[int, int, bool, dict]:
        first, following, timed, at, lang, text = self.own.get() or (0, 0, False, [], [], [])
        return first, following, timed, dict(zip(zip(at, lang, strict=True), text, strict=True))

    def _save(self, first: int, following: int, timed: bool, buffer: dict) -> None:
        """A stream whose buffer holds entries has one timer, for its newest one."""
        if buffer and not timed:
            self.handle.registerTimer(int((max(at for at, _ in buffer) + self.keep) * 1000) + 1)
        self.own.update((first, following, bool(buffer) or timed, [at for at, _ in buffer], [lang for _, lang in buffer], list(buffer.values())))

    def _left(self, buffer: dict, now: float) -> dict:
        return {k: text for k, text in buffer.items() if now - k[0] <= self.keep}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, following, timed, buffer = self._load()
        cache = _Cache(self.cache, first, following, self.most, self.evicted)
        oldest = min((at for at, _ in buffer), default=None)
        out = []
        for row in sorted(rows, key=lambda r: (r.at, r.turn is None, r.turn)):
            for lang in self.langs:
                made, _ = cache.translated(row.text or "", lang, self.translate)
                if made.strip():
                    buffer[row.at, lang] = made
                    oldest = row.at if oldest is None else min(row.at, oldest)
            if oldest is not None and row.at - oldest > self.keep:
                buffer = self._left(buffer, row.at)
                oldest = min((at for at, _ in buffer), default=None)
            if row.asked is None:
                continue
            for lang in self.langs:
                if (row.asked, lang) in buffer:
                    made, found = buffer[row.asked, lang], "buffer"
                else:
                    made, found = cache.translated(row.asked_text or "", lang, self.translate)
                out.append(self.row(key[0], row.turn, lang, row.asked, made, found))
        cache.save()
        self._save(cache.first, cache.next, timed, buffer)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, following, _, buffer = self._load()
        self._save(first, following, False, self._left(buffer, expiredTimerInfo.getExpiryTimeInMs() / 1000))
        yield from ()

    def close(self) -> None:
        pass


def translations(df: DataFrame, stream: str, langs: list[str], translate: Callable[[str, str], str], late: str = "10 seconds", keep: float = KEEP, most: int = MOST, evicted: int = EVICTED) -> DataFrame:
    """A stream of captions (``stream``, turn long, at double in seconds, text, asked: the time of the caption to be shown or
    null, asked_text: its text) with the translations asked for: ``stream``, turn, lang, asked, translated, found.
    ``translate`` is a model's hook of (text, language). Rows of a stream come in order or within ``late``."""
    schema = T.StructType([df.schema[stream], T.StructField("turn", T.LongType()), *T._parse_datatype_string(OUT).fields])
    rows = df.withColumn("_time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("_time", late)
    processor = Translations(langs, translate, schema.names, keep, most, evicted)
    return rows.groupBy(stream).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
