"""Numbers of a corpus, terms of verses, contexts and glossaries for prompts, and choice of a glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.functions.lists import FALLBACK_TERMS, GLOSSARY_TERMS


def stats(terms: DataFrame) -> DataFrame:
    """One row of numbers about the glossary job's tokens. ``marked``: tokens that differ from their ascii form, so
    capitalised ones too."""
    numbers = terms.agg(F.count("*").alias("unique_tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_occurrences"), F.avg("n").alias("mean"), F.count_if(F.col("token") != F.col("ascii")).alias("marked"))
    lists = [terms.select(F.explode(c).alias("x")).distinct().agg(F.array_sort(F.collect_list("x")).alias(c)) for c in ("chapters", "sources")]
    # three tables of one row each
    return numbers.join(lists[0]).join(lists[1]).select("unique_tokens", "total_occurrences", "mean", "chapters", "sources", "marked")


def duplicate_contents(df: DataFrame, text: str) -> DataFrame:
    """``duplicates``: how many different texts (without case and white space) occur more than once."""
    norm = F.sha2(C.strip(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), C.SPACE + "+", " ")), 256)
    return df.groupBy(norm.alias("_norm")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicates"))


def scrape_stats(df: DataFrame, words: str = "word_count") -> DataFrame:
    """One row: items, words, mean words, sources and chapters."""
    return df.agg(
        F.count("*").alias("items"), F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("words"), F.avg(words).alias("mean_words"),
        F.countDistinct("source").alias("sources"), F.countDistinct(F.when(F.col("chapter") != 0, F.col("chapter"))).alias("chapters"),
    )


def verse_terms(pages: DataFrame, text: str, english: list[str], names: list[str], key: str = "chapter") -> DataFrame:
    """Terms of each page's verses, sorted and joined by spaces, and their number; pages without any are left out. Words
    of the lists (lower case) are no terms."""
    verse = F.concat_ws(" ", F.transform(C.verses(F.col(text)), lambda v: v.content))
    found = F.array_distinct(F.concat(C.marked_words(F.col("_verses")), C.known_words(F.col("_verses"))))
    lists = [F.array(*(F.lit(x) for x in words)).cast("array<string>") for words in (english, names)]
    kept = F.array_sort(F.filter(found, lambda t: C.is_sanskrit(t, *lists)))
    out = pages.withColumn("_verses", verse).withColumn("_terms", kept).filter(F.size("_terms") > 0)
    return out.select(key, F.array_join("_terms", " ").alias("text"), F.size("_terms").cast("long").alias("word_count"))


def common_glossary(contexts: DataFrame, glossary: str | None = None) -> DataFrame:
    """Every row with the given glossary, or the fixed terms: glossary, strategy, confidence."""
    text = " ".join(GLOSSARY_TERMS) if glossary is None else glossary
    return contexts.withColumn("glossary", F.lit(text)).withColumn("strategy", F.lit("static_common")).withColumn("confidence", F.lit(1.0))


def no_glossary(contexts: DataFrame) -> DataFrame:
    return contexts.withColumn("glossary", F.lit("")).withColumn("strategy", F.lit("empty")).withColumn("confidence", F.lit(1.0))


def chapter_number(path: Column) -> Column:
    """Number of the chapter that a file's name tells, or null."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
    found = [F.nullif(F.regexp_extract(stem, p + r"[_\s]*(\d+)", 1), F.lit("")) for p in ("chapter", "ch", "bg", "sb")]
    return F.coalesce(*found)


def chapter_glossaries(contexts: DataFrame, glossaries: DataFrame, path: str, previous: str) -> DataFrame:
    """The glossary (name, text) of the chapter that a file's name tells, else of the first (by name) that the text before
    names, else the fallback terms; confidence 0.8, or 0.3 for the fallback. All names are put in one row, which every
    task gets (a name a file of a folder); the glossaries' texts are joined by name. Names are unique."""
    names = glossaries.agg(F.coalesce(F.array_sort(F.collect_list("name")), F.array().cast("array<string>")).alias("_g"))
    out = contexts.crossJoin(F.broadcast(names)).withColumn("_n", chapter_number(F.col(path)))
    by_file = F.filter(F.transform(F.array(*(F.lit(x) for x in ("chapter", "ch", "bg", "sb"))), lambda p: F.concat(p, F.col("_n"))), lambda name: F.array_contains("_g", name))
    by_text = F.filter("_g", lambda name: F.contains(F.lower(F.coalesce(previous, F.lit(""))), name))
    chapter = F.coalesce(F.try_element_at(by_file, F.lit(1)), F.try_element_at(by_text, F.lit(1)))
    out = out.withColumn("guessed_chapter", chapter).drop("_g", "_n").join(glossaries.select(F.col("name").alias("_name"), F.col("text").alias("_text")), F.col("guessed_chapter") == F.col("_name"), "left")
    out = out.withColumn("glossary", F.coalesce("_text", F.lit(" ".join(FALLBACK_TERMS)))).drop("_name", "_text")
    return out.withColumn("strategy", F.lit("chapter_guess")).withColumn("confidence", F.when(F.col("guessed_chapter").isNotNull(), 0.8).otherwise(0.3))


def chosen_glossary(contexts: DataFrame, strategy: str, **given) -> DataFrame:
    """By a strategy's name: static_common, chapter_guess or empty. An unknown name is an error, as it is a parameter."""
    made = {"static_common": common_glossary, "chapter_guess": chapter_glossaries, "empty": no_glossary}
    if strategy not in made:
        raise ValueError(f"no such strategy: {strategy}")
    return made[strategy](contexts, **given)


def counters(results: DataFrame, seconds: str, by: str = "strategy") -> DataFrame:
    """Applications, seconds and mean seconds by strategy."""
    return results.groupBy(by).agg(F.count("*").alias("applied"), F.sum(seconds).alias("seconds"), F.avg(seconds).alias("mean_seconds"))


def frame_times(df: DataFrame, seconds: str, *by: str) -> DataFrame:
    """Mean, least and most of frame times."""
    return df.groupBy(*by).agg(F.avg(seconds).alias("mean"), F.max(seconds).alias("most"), F.min(seconds).alias("least"))


def model_settings(**given) -> dict[str, object]:
    """Settings of a speech model's decoder with their defaults; names outside these are an error."""
    out = {"beam_size": 5, "best_of": 5, "temperature": 0.0, "no_speech_threshold": 0.7, "condition_on_previous_text": False, "word_timestamps": True, "vad_filter": False, "language": "en"}
    if unknown := set(given) - set(out):
        raise ValueError(f"no such settings: {sorted(unknown)}")
    return out | given


def by_model(df: DataFrame, model, schema) -> DataFrame:
    """A model's hook: ``model`` maps an iterator of pandas frames to frames of ``schema``, loaded once a task."""
    return df.mapInPandas(model, schema)
