"""Scalar expressions on columns; all native, all null-safe as documented on each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.lists import BOGUS, COLOURS, DIACRITICS, DISPLAY, KEY_WORDS, KNOWN_TERMS, SILENCE_WORDS, SUFFIXES, TOPIC_WORDS


#: White space of any kind as a character class, and as characters to trim.
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACES = " \t\n\x0B\x0C\r\u0085\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(SPACES))


def similarity_norm(x: Column) -> Column:
    """Lower case, punctuation (but apostrophes) to spaces, single spaces, no spaces beside apostrophes; null is ""."""
    x = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[^\w\s']", " ")
    x = strip(F.regexp_replace(x, SPACE + "+", " "))
    return F.regexp_replace(F.regexp_replace(x, r"'\s+", "'"), r"\s+'", "'")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length, case-insensitive; 0 where one is null or empty."""
    empty = F.coalesce(F.length(a), F.lit(0)) * F.coalesce(F.length(b), F.lit(0)) == 0
    return F.when(empty, 0.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 where one is null or empty."""
    some = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def text_similarity(a: Column, b: Column, least: float | None = None) -> Column:
    """1 for equal (normalised) texts; for a text inside the other the ratio of lengths, 0 under 0.6; else the mean of
    Levenshtein ratio and word Jaccard. Blank texts give 0. With ``least``, a value that can't be above it is 0: the
    Levenshtein ratio is no more than the ratio of lengths, so most distances needn't be computed."""
    na, nb = similarity_norm(a), similarity_norm(b)
    la, lb = F.length(na), F.length(nb)
    share = F.least(la, lb) / F.greatest(la, lb)
    common = jaccard(F.split(na, " "), F.split(nb, " "))
    mean = (levenshtein_ratio(na, nb) + common) / 2
    if least is not None:
        mean = F.when((share + common) / 2 > least, mean).otherwise(0.0)
    blank = (strip(F.coalesce(a, F.lit(""))) == "") | (strip(F.coalesce(b, F.lit(""))) == "")
    return (
        F.when(blank, 0.0).when(a == b, 1.0).when((la == 0) & (lb == 0), 1.0).when((la == 0) | (lb == 0), 0.0).when(na == nb, 1.0)
        .when(F.contains(na, nb) | F.contains(nb, na), F.when(share >= 0.6, share).otherwise(0.0))
        .otherwise(mean)
    )


def clean_text(x: Column) -> Column:
    """Single spaces, none before punctuation, trimmed."""
    x = F.regexp_replace(x, SPACE + "+", " ")
    return strip(F.regexp_replace(x, r"\s+([,.!?;:])", "$1"))


def display_text(x: Column) -> Column:
    """Typographic marks that fonts lack, spelt in ASCII."""
    for mark, plain in DISPLAY:
        x = F.replace(x, F.lit(mark), F.lit(plain))
    return strip(x)


def bogus_filter(x: Column) -> Column:
    """"" for texts that a speech model makes up: too short, with a credit line, or one or two silence words."""
    low = strip(F.lower(x))
    words = F.filter(F.split(low, SPACE + "+"), lambda w: w != "")
    credit = F.lit(False)
    for pattern in BOGUS:
        credit = credit | F.contains(low, F.lit(pattern))
    silence = (F.size(words) <= 2) & F.forall(words, lambda w: w.isin(SILENCE_WORDS))
    return F.when((F.length(low) < 2) | credit | silence, "").otherwise(x)


def srt_time(seconds: Column) -> Column:
    """hh:mm:ss,mmm with the milliseconds cut, not rounded."""
    whole = F.floor(seconds).cast("long")
    ms = F.floor((seconds - whole) * 1000).cast("long")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(pad(F.floor(whole / 3600), 2), F.lit(":"), pad(F.floor(whole % 3600 / 60), 2), F.lit(":"), pad(whole % 60, 2), F.lit(","), pad(ms, 3))


def caption_duration(start: Column, end: Column) -> Column:
    """Between 1.5 and 4 seconds; 2 where the end is missing."""
    return F.least(F.lit(4.0), F.greatest(F.lit(1.5), F.coalesce(end, start + 2.0) - start))


def valid_duration(x: Column) -> Column:
    return F.when(x <= 0, 3.0).when(x > 10, 10.0).otherwise(x)


def relative_time(x: Column, now: Column, start: Column) -> Column:
    """Absolute times (a day before to an hour after now) from the start on; before -1 s: 0."""
    rel = F.when((x > now - 86400) & (x < now + 3600), x - start).otherwise(x)
    return F.when(rel < -1, 0.0).otherwise(rel)


def fade(t: Column, start: Column, end: Column) -> Column:
    """Brightness of a caption at t: 0.1 s in and out, at least 0.1 while it is active, else 0."""
    inside = (t >= start) & (t <= end)
    return F.when(inside, F.greatest(F.lit(0.1), F.least(F.lit(1.0), (t - start) / 0.1, (end - t) / 0.1))).otherwise(0.0)


def dedup_lines(x: Column) -> Column:
    """Keep each line's first occurrence, compared without case and outer white space."""
    lines = F.split(x, "\n")
    both = F.struct(lines.alias("lines"), F.transform(lines, lambda s: F.lower(strip(s))).alias("keys"))
    # bound in an array of one, so that the keys are made once and not for each line
    kept = F.transform(F.array(both), lambda b: F.filter(b.lines, lambda s, i: F.array_position(b.keys, F.get(b.keys, i)) == i + 1))
    return F.array_join(F.get(kept, F.lit(0)), "\n")


def wrap(x: Column, width: int = 60) -> Column:
    """Greedy wrapping at spaces into lines of at most ``width`` characters (longer words have their own)."""
    state = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))

    def add(acc, word):
        longer = F.when(acc.now == "", word).otherwise(F.concat(acc.now, F.lit(" "), word))
        fits = (F.length(longer) <= width) | (acc.now == "")
        return F.struct(F.when(fits, acc.lines).otherwise(F.concat(acc.lines, F.array(acc.now))).alias("lines"), F.when(fits, longer).otherwise(word).alias("now"))

    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return F.aggregate(words, state, add, lambda acc: F.array_join(F.concat(acc.lines, F.array(acc.now)), "\n"))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), SPACE + "+"), lambda w: w != "")).cast("long")


def video_id(url: Column) -> Column:
    """The id in the four common forms of a video address."""
    forms = [r"[?&]v=([\w-]{11})", r"youtu\.be/([\w-]{11})", r"/embed/([\w-]{11})", r"/v/([\w-]{11})"]
    return F.coalesce(*(F.nullif(F.regexp_extract(url, f, 1), F.lit("")) for f in forms))


def ema(values: Column, keep: float = 0.9) -> Column:
    """Exponential mean of an ordered array; the first value (or one after a mean of 0) seeds it."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: F.when(acc == 0, x).otherwise((1 - keep) * x + keep * acc))


def caption_lines(x: Column) -> Column:
    """Stripped lines without the blank ones; spaces inside a line stay."""
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), strip), lambda line: line != ""), "\n")


def words_of(x: Column) -> Column:
    """Words between white space, as an array; none for null."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), SPACE + "+"), lambda w: w != "")


def not_past(x: Column, now: Column) -> Column:
    """A time, or now if that is later."""
    return F.greatest(x, now)


def in_time(start: Column, now: Column, late: float = 10.0, early: float = 30.0) -> Column:
    """Whether a caption starts at most ``late`` seconds ago and at most ``early`` seconds from now."""
    return (start - now).between(-late, early)


def display_fade(t: Column, start: Column, end: Column) -> Column:
    """Brightness for display: in within 0.05 s or an eighth, out within 0.2 s or a sixth of the duration; 0.1 to 1."""
    d = end - start
    rise, fall = F.least(F.lit(0.05), d / 8), F.least(F.lit(0.2), d / 6)
    value = F.when((t - start < rise) & (rise > 0), (t - start) / rise).when((end - t < fall) & (fall > 0), (end - t) / fall).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), value))


def font_size(scale: Column, width: Column, height: Column, base: int = 30) -> Column:
    """Points for a picture of that size, by the root of its share of 1920 x 1080; unknown sizes count as that."""
    known = F.floor(scale * base * F.sqrt(width * height / (1920.0 * 1080.0))).cast("int")
    plain = F.greatest(F.lit(16), F.floor(scale * base).cast("int"))
    return F.when(width.isNull() | height.isNull(), plain).otherwise(F.greatest(F.lit(12), F.least(known, F.lit(2 * base))))


def box_padding(padding: Column, width: Column, height: Column) -> Column:
    """Pixels around a caption, in proportion to the picture's width, 5 at least."""
    scaled = F.greatest(F.lit(5), F.floor(padding * width / 1920.0).cast("int"))
    return F.when(width.isNull() | height.isNull(), padding.cast("int")).otherwise(scaled)


def caption_box(width: Column, height: Column, text_width: Column, text_height: Column, padding: Column, index: Column, tall: Column) -> Column:
    """Box and text position of the caption with that index (0 is the lowest); ``tall`` is how many of those below it
    have several lines. Boxes are centred, 20 pixels from the bottom, 3 or 4 above each other, and not above 20."""
    box_w, box_h = text_width + 2 * padding, text_height + 2 * padding
    wide = box_w > width
    x1 = F.when(wide, F.lit(0)).otherwise(F.floor((width - box_w) / 2)).cast("int")
    x2 = F.when(wide, width).otherwise(x1 + box_w).cast("int")
    low = height - F.when(index == 0, F.lit(20)).otherwise(20 + box_h + 3 * index + tall)
    y1 = F.when((index > 0) & (low - box_h < 20), F.lit(20)).otherwise(low - box_h).cast("int")
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), (y1 + box_h).cast("int").alias("y2"), (x1 + padding).cast("int").alias("text_x"), (y1 + padding).cast("int").alias("text_y"))


def colour(language: Column) -> Column:
    """Blue, green and red of a language's captions; white for any other."""
    table = F.create_map(*(F.lit(x) for k, v in COLOURS.items() for x in (k, list(v))))
    return F.coalesce(F.try_element_at(table, language), F.array(*(F.lit(255) for _ in range(3))))


def target_frame(audio: Column, start: Column, fps: Column) -> Column:
    """Number of the frame that belongs to a time of the sound."""
    return F.floor((audio - start) * fps).cast("long")


def frames_to_skip(target: Column, now: Column) -> Column:
    """Frames to leave out when more than three behind, so that one is left to the target."""
    return F.when(target - now > 3, target - now - 1).otherwise(F.lit(0)).cast("long")


def synced(frame: Column, audio: Column, playing: Column, most: float = 0.016) -> Column:
    """A frame's time, or the sound's while that plays and is further off than ``most`` seconds."""
    return F.when((audio > 0) & playing & (F.abs(frame - audio) > most), audio).otherwise(frame)


def clip_duration(x: Column, most: Column) -> Column:
    return F.least(x, most)


def chunk_label(n: Column, warm_up: Column) -> Column:
    return F.concat(F.lit("#"), n.cast("string"), F.when(warm_up, F.lit(" (warmup)")).otherwise(F.lit(" (normal)")))


def queue_label(size: Column, most: Column, results: Column) -> Column:
    return F.format_string("Audio Q: %d/%d | Result Q: %d", size, most, results)


def queue_stats(size: Column, most: Column) -> Column:
    """Size, capacity and usage of a queue; an unbounded one (capacity 0) has usage 0."""
    usage = F.when(most > 0, size / most).otherwise(F.lit(0.0))
    return F.struct(size.alias("size"), most.alias("most"), usage.alias("usage"))


def over_threshold(size: Column, most: Column, share: float = 0.6) -> Column:
    return size >= most * share


def valid_chunk(size: Column, overlap: Column) -> Column:
    """Whether chunks of that size and overlap move on."""
    return (size > 0) & (overlap >= 0) & (overlap < size)


def valid_audio(samples: Column, at: Column) -> Column:
    """Whether a chunk has samples and a time."""
    return F.coalesce(F.size(samples) > 0, F.lit(False)) & at.isNotNull()


def adaptive_sleep(processed: Column, since: Column, size: Column, overlap: Column, usage: Column, least: float = 0.1, most: float = 1.0) -> Column:
    """Seconds to wait before looking again: little after work, most of the time to the next chunk otherwise, more while
    the queue is over 60 % full."""
    until = size - overlap - since
    wait = F.when(processed | (until <= 0), F.lit(least)).otherwise(F.least(F.lit(0.5), F.greatest(F.lit(least), until * 0.8)))
    return F.when(usage > 0.6, F.least(F.lit(most), wait * (1 + usage * 2))).otherwise(wait)


def drop_alert(drops: Column) -> Column:
    """What a minute's number of dropped chunks calls for."""
    return F.when(drops > 80, "warning").when(drops > 40, "info")


def glossary_matches(text: Column, glossary: Column) -> Column:
    """How many different words of a text are in a glossary, without case."""
    return F.size(F.array_intersect(words_of(F.lower(text)), words_of(F.lower(glossary)))).cast("long")


def prompt(context: Column, glossary: Column, most: int = 224) -> Column:
    """A context's words and the head of a glossary in at most ``most`` characters; lines that begin with # are left out
    of the glossary."""
    terms = strip(F.regexp_replace(F.coalesce(glossary, F.lit("")), r"(?m)^#.*$\n?", ""))
    before = F.array_join(words_of(context), " ")
    room = most - F.length(before) - 10
    parts = F.array(F.when(before != "", before), F.when((terms != "") & (room > 0), F.substring(terms, F.lit(1), F.greatest(room, F.lit(0)))))
    return F.substring(F.array_join(F.filter(parts, lambda x: x.isNotNull()), " "), 1, most)


def folded(token: Column) -> Column:
    """A token in lower case without the marks of the Latin letters that transliterations use; native. ``ascii_fold`` of
    the functions on texts knows every mark and Devanagari."""
    marked, plain = "āīūṛṝḷḹēōṃḥṅñṭḍṇśṣḻáàâäãåéèêëíìîïóòôöõúùûüçýÿ", "aiurrlleomhnntdnsslaaaaaaeeeeiiiiooooouuuucyy"
    return F.translate(F.lower(token), marked, plain)


def verses(text: Column) -> Column:
    """Number and content of each verse of a chapter's text ("TEXT 1: ...")."""
    found = r"(?is)TEXT\s+(\d+):\s*(.*?)(?=TEXT\s+\d+|$)"
    numbers, bodies = (F.regexp_extract_all(text, F.lit(found), F.lit(k)) for k in (1, 2))
    return F.zip_with(numbers, bodies, lambda n, body: F.struct(n.cast("int").alias("verse"), strip(body).alias("content")))


def marked_words(text: Column) -> Column:
    """Words with exactly one letter with a diacritic."""
    return F.regexp_extract_all(text, F.lit(rf"(?U)\b[A-Za-z]*[{DIACRITICS}][A-Za-z]*\b"), F.lit(0))


def known_words(text: Column) -> Column:
    """Words of the fixed list of terms, in any case."""
    return F.regexp_extract_all(text, F.lit(r"(?iU)\b(?:" + "|".join(KNOWN_TERMS) + r")\b"), F.lit(0))


def is_sanskrit(term: Column, english: Column, names: Column) -> Column:
    """Whether a term of a verse is kept: not in the arrays of English words and names, three characters and more, not in
    capitals; and with a diacritic, of the fixed list, or capitalised with a fitting end and over four characters."""
    low = F.lower(term)
    fitting = term.rlike(r"(?U)^\p{Lu}") & low.rlike("(?:" + "|".join(SUFFIXES) + ")$") & (F.length(term) > 4)
    listed = low.isin([x.lower() for x in KNOWN_TERMS])
    capitals = (F.upper(term) == term) & (low != term)
    return ~F.array_contains(english, low) & ~F.array_contains(names, low) & (F.length(term) >= 3) & ~capitals & (term.rlike(f"[{DIACRITICS}]") | listed | fitting)


def key_sentences(text: Column, most: int = 5) -> Column:
    """The first sentences of over 30 characters with a key word, where the text has a topic word; else null."""
    has = lambda x, words: F.lower(x).rlike("|".join(words))
    kept = F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: (F.length(s) > 30) & has(s, KEY_WORDS))
    return F.when(has(text, TOPIC_WORDS) & (F.size(kept) > 0), F.array_join(F.slice(kept, 1, most), ". "))


def key_paragraphs(text: Column, most: int = 3) -> Column:
    """The first lines of over 50 characters with a key word (or "lord"), where the text has a topic word; else null."""
    has = lambda x, words: F.lower(x).rlike("|".join(words))
    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: (F.length(s) > 50) & has(s, [*KEY_WORDS, "lord"]))
    return F.when(has(text, TOPIC_WORDS) & (F.size(kept) > 0), F.array_join(F.slice(kept, 1, most), " "))


def devanagari_words(text: Column) -> Column:
    """Words of two and more Devanagari characters, everything else removed from them."""
    return F.filter(F.transform(words_of(text), lambda w: F.regexp_replace(w, r"[^\u0900-\u097F]", "")), lambda w: F.length(w) > 1)


def mean_confidence(findings: Column, removed: Column | None = None) -> Column:
    """Mean of the findings' confidence (1 without any), shrunk where over half or over 70 % of a text was removed."""
    mean = F.aggregate(findings, F.lit(0.0), lambda a, x: a + x) / F.size(findings)
    factor = F.lit(1.0) if removed is None else F.when(removed > 0.7, 0.8).when(removed > 0.5, 0.95).otherwise(1.0)
    return F.when(F.size(findings) > 0, F.least(F.lit(1.0), mean * factor)).otherwise(1.0)


def rebased(segment: Column, at: Column) -> Column:
    """A segment (text, start, end, words) with its times, and those of its words, moved by the start of its chunk."""
    words = F.transform(segment.words, lambda w: w.withField("start", w.start + at).withField("end", w.end + at))
    return segment.withField("start", segment.start + at).withField("end", segment.end + at).withField("words", words)
