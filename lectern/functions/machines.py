"""Ordered state machines over one stream: the same step serves a finished stream and a live one.

A machine has ``schema`` (DDL of what it puts out), ``start()`` (a state of plain lists, numbers and texts, so that it can
be kept as JSON) and ``step(state, row)`` (rows to put out; the state is changed in place).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from lectern.functions.lists import BOGUS, DISPLAY, SILENCE_WORDS
from lectern.functions.segments import clean_segment, rewrite_terms

State = dict[str, Any]


def bogus(text: str) -> bool:
    """Whether a text is one that a speech model makes up."""
    low = text.lower().strip()
    words = low.split()
    return len(low) < 2 or any(b in low for b in BOGUS) or len(words) <= 2 and all(w in SILENCE_WORDS for w in words)


def displayed(text: str) -> str:
    for mark, plain in DISPLAY:
        text = text.replace(mark, plain)
    return text.strip()


@dataclass(frozen=True)
class SegmentCleaner:
    """Segments (text) without what the stream said before, without repetitions and, by level, profanity."""

    level: str = "OFF"
    schema = "cleaned string, action string, findings long, confidence double"

    def start(self) -> State:
        return {"history": [], "context": []}

    def step(self, state: State, row) -> list[tuple]:
        return [clean_segment(row.text or "", state["history"], state["context"], self.level)]


@dataclass(frozen=True)
class BoundedBuffer:
    """A buffer of ``most`` elements (item): a full one drops its oldest for a new one, or, while it warms up (``warm_up``
    true), the new one. Puts out what each element did and what was dropped."""

    most: int = 10
    schema = "event string, dropped string, size long"

    def start(self) -> State:
        return {"held": []}

    def step(self, state: State, row) -> list[tuple]:
        held = state["held"]
        if len(held) < self.most:
            held.append(row.item)
            return [("added", None, len(held))]
        if getattr(row, "warm_up", False):
            return [("skipped", row.item, len(held))]
        held.append(row.item)
        return [("dropped oldest", held.pop(0), len(held))]


@dataclass(frozen=True)
class RateLimiter:
    """Which elements (at, in seconds) are put out: at least ``interval`` after the last one that was."""

    interval: float = 5.0
    schema = "emitted boolean"

    def start(self) -> State:
        return {"last": None}

    def step(self, state: State, row) -> list[tuple]:
        due = row.at is not None and (state["last"] is None or row.at - state["last"] >= self.interval)
        if due:
            state["last"] = row.at
        return [(due,)]


@dataclass(frozen=True)
class MovingMean:
    """Exponential mean of values (value); the first one, or one after a mean of 0, seeds it; nulls leave it."""

    keep: float = 0.9
    schema = "ema double"

    def start(self) -> State:
        return {"mean": 0.0}

    def step(self, state: State, row) -> list[tuple]:
        if row.value is not None:
            state["mean"] = row.value if state["mean"] == 0 else (1 - self.keep) * row.value + self.keep * state["mean"]
        return [(state["mean"],)]


@dataclass(frozen=True)
class WordWindow:
    """The last ``most`` words of a stream before each segment (text), which is the context of its prompt."""

    most: int = 32
    schema = "context string"

    def start(self) -> State:
        return {"words": []}

    def step(self, state: State, row) -> list[tuple]:
        out = " ".join(state["words"])
        state["words"] = (state["words"] + (row.text or "").split())[-self.most :]
        return [(out,)]


@dataclass(frozen=True)
class CaptionTimeline:
    """Transcribed segments (text, start_time, end_time, now: the picture's time) become captions.

    In order: a blank text is left out; the duration is held to 1.5 to 4 s (2 s without an end); a text that shares more
    than two words with an active caption that starts less than 3 s apart is a duplicate; captions that overlap the new
    one (a second wider) go, and those that ended over a second ago; a start over 10 s ago or 30 s ahead is out of time;
    then made-up texts go, misheard terms are rewritten, the stream's cleaners run, and the text is made fit for display.
    Puts out what became of the segment and the caption, whose id is the stream's count of captions."""

    seek: float = 0.0
    offset: float = 0.0
    level: str = "MODERATE"
    schema = "action string, caption_id long, caption string, caption_start double, caption_end double, removed long"

    def start(self) -> State:
        return {"captions": [], "made": 0, "history": [], "context": []}

    def step(self, state: State, row) -> list[tuple]:
        text = (row.text or "").strip()
        if not text or row.start_time is None:
            return [("blank", None, None, None, None, 0)]
        end = row.start_time + 2.0 if row.end_time is None else row.end_time
        duration, start, now = min(4.0, max(1.5, end - row.start_time)), row.start_time - self.seek, row.now - self.seek
        at, words = start + self.offset, set(text.lower().split())
        for own, s, e in state["captions"]:
            if s <= now <= e and abs(s - at) < 3.0 and len(words & set(own.lower().split())) > 2:
                return [("duplicate", None, None, None, None, 0)]
        kept = [c for c in state["captions"] if not (c[1] < at + duration + 1.0 and c[2] > at - 1.0) and c[2] > now - 1.0]
        removed, state["captions"] = len(state["captions"]) - len(kept), kept
        if not -10.0 <= start - now <= 30.0:
            return [("out of time", None, None, None, None, removed)]
        if bogus(text):
            return [("bogus", None, None, None, None, removed)]
        out = clean_segment(rewrite_terms(text), state["history"], state["context"], self.level)[0]
        if not out.strip():
            return [("cleaned away", None, None, None, None, removed)]
        out, at = displayed(out), max(0.0, at)
        state["made"] += 1
        state["captions"].append([out, at, at + duration])
        return [("added", state["made"], out, at, at + duration, removed)]
