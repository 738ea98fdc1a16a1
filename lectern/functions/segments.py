"""Pure functions on one text or one stream of texts, shared by batch and streaming operators.

A stream's state is a plain list of its last cleaned segments, so the same step serves ``applyInPandas`` over a
finished stream and a stateful streaming processor.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from itertools import groupby

import numpy as np

from lectern.functions.lists import (
    COMPLETE_PHRASES, CONSONANTS, CONTINUERS, EMPHATIC, FILLERS, INCOMPLETE, LEET, MILD, MISHEARD, PREDICATES, PROFANITY,
    RELIGIOUS, RELIGIOUS_KEPT, SIGNS, SUBJECTS, SYNONYMS, VIRAMA, VOWEL_SIGNS, VOWELS,
)

EDGE = '.,!?;:"'
_TOKEN = re.compile(r"\b\w+\b")
_INCOMPLETE = re.compile("|".join(INCOMPLETE))
HISTORY, CONTEXT = 5, 10


def transliterated(text: str) -> str:
    """Devanagari in the international transliteration: a consonant has the vowel a unless a sign says otherwise."""
    out, bare = [], False
    for c in text:
        if c in CONSONANTS:
            out.append("a" * bare + CONSONANTS[c])
            bare = True
        elif c == VIRAMA:
            bare = False
        else:
            out.append(VOWEL_SIGNS[c] if c in VOWEL_SIGNS else "a" * bare + (VOWELS.get(c) or SIGNS.get(c) or c))
            bare = False
    return "".join(out) + "a" * bare


def ascii_fold(text: str) -> str:
    """Lower case: Devanagari transliterated, other texts without combining marks."""
    if text.isascii():
        return text.lower()
    if any("\u0900" <= c <= "\u097f" for c in text):
        return transliterated(text).lower()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def seq_ratio(a, b) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def common_length(a, b) -> int:
    """Length of the longest common subsequence: a bit for each element of ``b`` tells where it hasn't grown."""
    places: dict = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    whole = open_ = (1 << len(b)) - 1
    for x in a:
        met = open_ & places.get(x, 0)
        open_ = (open_ + met | open_ - met) & whole
    return len(b) - open_.bit_count()


def ratio_from(a, b, least: float) -> float:
    """``seq_ratio`` where it may reach ``least``, else 0: sizes, shared elements and the longest common subsequence, of
    which the matching blocks are one, bound it from above."""
    total = len(a) + len(b)
    if total and 2 * min(len(a), len(b)) < least * total:
        return 0.0
    if total:
        have = Counter(b)
        shared = sum(min(n, have[x]) for x, n in Counter(a).items())
        if 2 * shared < least * total or 2 * common_length(a, b) < least * total:
            return 0.0
    return seq_ratio(a, b)


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def indel_ratios(words: list[str], term: str) -> np.ndarray:
    """``indel_ratio`` of many words and one term: for all words at once, character by character, a bit for each of the
    term's characters tells where the longest common subsequence hasn't grown."""
    if not 0 < len(term) < 64 or any("\0" in w for w in words):
        return np.array([indel_ratio(w, term) for w in words], dtype=float)
    length = np.array([len(w) for w in words])
    codes = np.array([w or "\0" for w in words]).view(np.uint32).reshape(len(words), -1)
    letters = np.array(sorted({ord(c) for c in term}), np.uint32)
    places = np.array([sum(1 << k for k, c in enumerate(term) if ord(c) == x) for x in letters.tolist()], np.uint64)
    open_ = np.full(len(words), ~np.uint64(0))
    for column in codes.T:
        at = np.minimum(np.searchsorted(letters, column), len(letters) - 1)
        own = np.where(letters[at] == column, places[at], np.uint64(0))
        met = open_ & own
        open_ = (open_ + met) | (open_ - met)
    shared = len(term) - np.bitwise_count(open_ & np.uint64((1 << len(term)) - 1)).astype(np.int64)
    return 200.0 * shared / (length + len(term))


def tidy(text: str) -> str:
    return re.sub(r"\s+([,.!?;:])", r"\1", re.sub(r"\s+", " ", text)).strip()


def _bare(word: str) -> str:
    return word.lower().strip(EDGE)


def collapse_words(text: str) -> tuple[str, list[float]]:
    """Runs of one word are cut to one; an emphatic word may stand twice unless it is a filler. Also the confidence of
    each cut."""
    kept, cuts = [], []
    for key, run in groupby(text.split(), key=_bare):
        run = list(run)
        emphatic = key in EMPHATIC
        meant = len(run) <= 2 and emphatic and key not in FILLERS and not (len(key) <= 2 and len(run) > 2)
        if len(run) == 1 or meant:
            kept += run
        else:
            kept += run[: 2 if emphatic and len(run) <= 3 else 1]
            cuts.append(0.9 if len(run) > 2 else 0.7)
    return " ".join(kept), cuts


def _phrase_likeness(a: list[str], b: list[str], alike: float) -> float:
    if a == b:
        return 1.0
    x, y = [_bare(w) for w in a], [_bare(w) for w in b]
    return 0.95 if x == y else ratio_from(" ".join(x), " ".join(y), alike)


#: Kinds of characters that the bound of two phrases' likeness tells apart.
_KINDS = 32


def _kinds_until(words: list[str]) -> np.ndarray:
    """How many characters of each kind stand before each word, and in all of them."""
    bare = [_bare(w) for w in words]
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in bare])
    until = np.zeros((len(words) + 1, _KINDS), np.int64)
    np.cumsum(np.bincount(owner * _KINDS + codes % _KINDS, minlength=len(words) * _KINDS).reshape(-1, _KINDS), axis=0, out=until[1:])
    return until


def _maybe_like(until: np.ndarray, n: int, alike: float) -> list[int]:
    """Where two phrases of ``n`` words stand side by side that may be ``alike``: the characters that both have bound their
    likeness from above. Characters of a kind count as one, which only raises the bound."""
    of = until[n:] - until[:-n]
    shared = np.minimum(of[:-n], of[n:]).sum(axis=1) + n - 1
    sizes = of.sum(axis=1) + n - 1
    return np.flatnonzero(2 * shared >= alike * (sizes[:-n] + sizes[n:])).tolist()


def collapse_phrases(text: str, longest: int = 5, alike: float = 0.8) -> tuple[str, list[float]]:
    """Of two like phrases side by side the second goes, for short phrases first. Also how alike each pair was."""
    words, cuts = text.split(), []
    if len(words) < 4:
        return text, cuts
    until = None
    for n in range(2, min(longest + 1, len(words) // 2)):
        i, fresh = 0, -1
        until = _kinds_until(words) if until is None or len(until) != len(words) + 1 else until
        places = set(_maybe_like(until, n, alike)) if 2 * n <= len(words) else set()
        gone = 0  # words cut so far: a pair that begins at ``fresh`` or later stood ``gone`` words further on before
        while i + 2 * n <= len(words):
            if i >= fresh and i + gone not in places:
                i += 1
                continue
            a, b = words[i : i + n], words[i + n : i + 2 * n]
            near = _phrase_likeness(a, b, alike)
            if near >= alike and " ".join(a).lower() not in EMPHATIC:
                del words[i + n : i + 2 * n]
                gone, fresh = gone + n, i + n  # pairs that begin before reach over the cut
                cuts.append(near)
            else:
                i += 1
    return " ".join(words), cuts


def _cleaned(text: str, context: list[str]) -> tuple[str, list[float]]:
    out, cuts = collapse_words(text)
    out, more = collapse_phrases(out)
    words, cuts = out.split(), cuts + more
    near = max((ratio_from(words, own, 0.9) for old in reversed(context) if 2 * min(len(words), len(own := old.split())) >= 0.9 * (len(words) + len(own))), default=0.0)
    if near > 0.9 and not any(w.lower() in EMPHATIC for w in words[:3]):
        out, cuts = "", [*cuts, near]
    out = tidy(out)
    context.append(out)
    del context[:-CONTEXT]
    return out, cuts


def clean_repetitions(text: str, context: list[str]) -> tuple[str, int]:
    """Word and phrase runs go; a text almost equal to one of the last ones goes whole. ``context`` is updated."""
    out, cuts = _cleaned(text, context)
    return out, len(cuts)


def repetitions(text: str) -> tuple[str, int, float]:
    """A text on its own without repetitions, the number of findings and their confidence."""
    out, cuts = _cleaned(text, [])
    n, left = len(text.split()), len(out.split())
    gone = (n - left) / n if n else 0.0
    sure = min(1.0, sum(cuts) / len(cuts) * (0.8 if gone > 0.7 else 0.95 if gone > 0.5 else 1.0)) if cuts else 1.0
    return out, len(cuts), sure


def overlap(now: list[str], old: list[str], least: int = 2, share: float = 0.21) -> tuple[int, bool] | None:
    """Longest run of words that starts ``now`` and ends ``old``, else the reverse: (words, at the start)."""
    most = min(len(now), len(old))
    for at_start in (True, False):
        for n in range(most, least - 1, -1):
            if n / len(now) < max(0.2, share):
                break
            if (now[:n] == old[-n:]) if at_start else (now[-n:] == old[:n]):
                return n, at_start
    return None


def clean_against_history(text: str, history: list[str], alike: float = 0.7) -> tuple[str, str, list[float]]:
    """Remove from a segment what its stream's last segments said. Returns text, action and each finding's confidence;
    ``history`` (the last five cleaned segments, oldest first, empty ones too) is updated. A blank segment is kept as it
    is and not remembered."""
    if not text.strip():
        return text, "kept", []
    text = text.strip()
    now, out, action, found = _TOKEN.findall(text.lower()), text, "kept", []
    for old_text in reversed(history):
        old = _TOKEN.findall(old_text.lower())
        run = overlap(now, old)
        if run:
            rest = out.split()
            out = " ".join(rest[run[0] :] if run[1] else rest[: -run[0]])
            action = "cleaned"
            found.append(0.95)
            continue
        ratio = ratio_from(now, old, alike) if now and old else 0.0
        if ratio > alike:
            found.append(ratio)
            if ratio > 0.9:
                out, action = "", "removed"
            else:
                words = _TOKEN.findall(out.lower())
                block = max(difflib.SequenceMatcher(None, old, words).get_matching_blocks(), key=lambda b: b.size)
                if block.size >= 2:
                    out = " ".join(words[: block.b] + words[block.b + block.size :])
                action = "cleaned"
            break
        common = set(now) & set(old)
        if len(common) >= 3 and len(common) / len(now) > 0.4:
            rest = [w for w in text.split() if (own := _TOKEN.findall(w.lower())) and own[0] not in common]
            out, action = " ".join(rest), "cleaned" if rest else "removed"
            found.append(len(common) / len(now))
            break
    history.append(out)
    del history[:-HISTORY]
    return out, action, found


def history_confidence(text: str, cleaned: str, found: list[float]) -> float:
    """Mean confidence of a segment's findings, less where little of the text is left."""
    if not found:
        return 1.0
    share = len(cleaned) / len(text) if text and cleaned else 1.0
    return min(1.0, sum(found) / len(found) * (0.7 if share < 0.1 else 0.9 if share < 0.3 else 1.0))


def clean_segment(text: str, history: list[str], context: list[str], level: str = "OFF") -> tuple[str, str, int, float]:
    """A stream's next segment through all cleaners in order (other segments, repetitions, profanity), each left out
    once the text is blank. Returns text, action, findings and the confidence of the first cleaner."""
    out, action, found = clean_against_history(text, history)
    sure, n = history_confidence(text.strip(), out, found), len(found)
    if out.strip():
        out, more = clean_repetitions(out, context)
        n += more
    if out.strip() and level != "OFF":
        out, cut, _ = filter_profanity(out, level)
        n += len(cut)
    return out, action, n, sure


def sentences(text: str) -> list[dict]:
    """Sentences with their state and a confidence."""
    pieces = re.split(r"[.!?](?:\s|$)", text)
    out = []
    for k, piece in enumerate(pieces):
        piece = piece.strip()
        if not piece:
            continue
        low, words = piece.lower(), piece.lower().split()
        ended, subject, predicate, n = k < len(pieces) - 1, bool(SUBJECTS & set(words)), bool(PREDICATES & set(words)), len(words)
        if _INCOMPLETE.search(low):
            state = "incomplete"
        elif n < 2:
            state = "fragment"
        elif ended:
            state = "complete" if (subject and predicate) or n >= 3 else "fragment"
        elif subject and predicate and n >= 4:
            state = "incomplete"
        elif words[0] in CONTINUERS:
            state = "continuation"
        else:
            state = "fragment" if n < 3 else "incomplete"
        score = 0.5 + 0.2 * ended + 0.1 * subject + 0.1 * predicate + (0.1 if n >= 5 else -0.2 if n <= 2 else 0) + {"complete": 0.1, "fragment": -0.2}.get(state, 0) + 0.2 * any(p in low for p in COMPLETE_PHRASES)
        out.append({"text": piece, "state": state, "confidence": max(0.0, min(1.0, score)), "word_count": n})
    return out


def boundaries(text: str) -> list[tuple[int, int]]:
    """Start and end of each complete or incomplete sentence, counted over the pieces between sentence ends alone."""
    out, at = [], 0
    for piece, s in zip([p.strip() for p in re.split(r"[.!?](?:\s|$)", text) if p.strip()], sentences(text), strict=True):
        if s["state"] in ("complete", "incomplete"):
            out.append((at, at + len(piece)))
        at += len(piece) + 1
    return out


def incomplete_ending(text: str) -> str | None:
    """The last sentence if it goes on: incomplete, a continuation, or a fragment of two words and more."""
    last = (sentences(text) or [None])[-1]
    if last and (last["state"] in ("incomplete", "continuation") or last["state"] == "fragment" and last["word_count"] >= 2):
        return last["text"]
    return None


def is_complete(text: str, least: float = 0.7) -> bool:
    """Whether some sentence is complete with that confidence."""
    return any(s["state"] == "complete" and s["confidence"] >= least for s in sentences(text))


def replacement(word: str, strategy: str = "BEEP") -> str:
    """What a filtered word becomes: BEEP, ASTERISK (first and last letter stay), REMOVE or SYNONYM."""
    word = word.lower()
    if strategy == "ASTERISK":
        return "*" * len(word) if len(word) <= 2 else word[0] + "*" * (len(word) - 2) + word[-1]
    return {"BEEP": "[BEEP]", "REMOVE": ""}.get(strategy) if strategy != "SYNONYM" else SYNONYMS.get(word, "[FILTERED]")


def word_pattern(words) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.I)


_PROFANE = word_pattern(PROFANITY)
_LEET = {compat: [(re.compile(p if compat else rf"\b{p}\b", re.I), to) for p, to in LEET] for compat in (True, False)}


def filter_profanity(text: str, level: str = "MODERATE", strategy: str = "BEEP", context: str = "", words=None, compat: bool = False) -> tuple[str, list[tuple[str, str, float]], float]:
    """Text without profane words, the findings (kind, word, confidence) and their mean confidence. OFF leaves a text as
    it is; STRICT also takes mild words. With two religious terms in text and context, some words stay. Spellings with
    signs are taken as whole words; with ``compat`` inside words too ("hello" becomes "h***o"). ``words``: another list."""
    if level == "OFF" or not text:
        return text, [], 1.0
    found: list[tuple[str, str, float]] = []
    religious = sum(term in f"{text} {context}".lower() for term in RELIGIOUS) >= 2

    def profane(m):
        if religious and m[0].lower() in RELIGIOUS_KEPT:
            return m[0]
        found.append(("profanity", m[0], 0.95))
        return replacement(m[0], strategy)

    def spelt(to):
        return lambda m: found.append(("leetspeak", m[0], 0.85)) or to

    out = (_PROFANE if words is None else word_pattern(words)).sub(profane, text) if words is None or words else text
    for pattern, to in _LEET[compat]:
        keep = religious and not compat and pattern.pattern.strip("\\b") in ("h[e3]ll", "d[a@4]mn")
        out = out if keep else pattern.sub(spelt(to), out)
    if level == "STRICT":
        mild = []
        for w in out.split():
            clean = w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
            if clean in MILD:
                found.append(("mild_profanity", w, 0.75))
                w = replacement(clean, strategy)
            mild.append(w)
        out = " ".join(mild)
    sure = 1.0 if not found else sum(x[2] for x in found) / len(found) * (0.8 if len(found) / max(1, len(text.split())) > 0.5 else 1.0)
    return tidy(out), found, min(1.0, sure)


_MISHEARD = [(word_pattern([wrong]), right) for wrong, right in MISHEARD.items()]


def rewrite_terms(text: str, terms: list[tuple[re.Pattern, str]] | None = None) -> str:
    """Misheard terms rewritten one after the other, each in the case of what it replaces."""
    def cased(right):
        def to(m):
            own = m[0]
            return right.upper() if own.isupper() else right.lower() if own.islower() else right.title() if own.istitle() else right

        return to

    for pattern, right in _MISHEARD if terms is None else terms:
        text = pattern.sub(cased(right), text)
    return text


def pieces(text: str) -> list[tuple[str, bool]]:
    """A text cut into words and what is between them."""
    return [(m[0], m[1] is not None) for m in re.finditer(r"(\b\w+\b)|(?:(?!\b\w).)+", text, re.S)]


def mask_words(text: str, terms: set[str], strategy: str = "BEEP") -> str:
    """Replace whole words of a list."""
    if not terms:
        return text
    return tidy(word_pattern(sorted(terms, key=len, reverse=True)).sub(lambda m: replacement(m[0], strategy), text))
