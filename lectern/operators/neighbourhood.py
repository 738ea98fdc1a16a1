"""Words that are alike, by deletion neighbourhoods.

Two words within a Levenshtein distance of d have a common string that either becomes by deleting d characters at most.
So each word is listed under all such strings, and words meet by equality: no side is broadcast by demand, no pairs of
lengths are tried, and the longest common string is their longest common subsequence, from which their ratio follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shorter(word: Column) -> Column:
    """All strings with one character less (the empty one for an empty word)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def variants(word: Column, most: Column) -> Column:
    """The word and what it becomes without one or two characters; ``most`` is 0, 1 or 2."""
    none = F.array().cast("array<string>")
    one = F.when(most >= 1, _shorter(word)).otherwise(none)
    two = F.when(most >= 2, F.flatten(F.transform(one, _shorter))).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), one, two))


def edits(length: Column) -> Column:
    """How far words of a length may be apart: 0 below three characters, 1 below six, else 2."""
    return F.when(length < 3, 0).when(length < 6, 1).otherwise(2)


def met(left: DataFrame, right: DataFrame, word: str, term: str, most) -> DataFrame:
    """Pairs (``word``, ``term``) with the length of their longest common string, ``shared``. ``most`` gives of a length
    the characters that may be deleted. Words of either side are different ones."""
    a = left.select(word, F.explode(variants(F.col(word), most(F.length(word)))).alias("_variant"))
    b = right.select(term, F.explode(variants(F.col(term), most(F.length(term)))).alias("_variant"))
    return a.join(b, "_variant").groupBy(word, term).agg(F.max(F.length("_variant")).alias("shared"))


def fuzzy_join(left: DataFrame, right: DataFrame, word: str, term: str) -> DataFrame:
    """Different words of both sides that are within the distance of the shorter one's length (``edits``): ``word``,
    ``term``, ``distance``. Nulls meet nothing."""
    a, b = (x.select(c).filter(F.col(c).isNotNull()).distinct() for x, c in ((left, word), (right, term)))
    near = met(a, b, word, term, edits).withColumn("distance", F.levenshtein(word, term, 2))
    return near.filter((F.col("distance") >= 0) & (F.col("distance") <= edits(F.least(F.length(word), F.length(term))))).select(word, term, "distance")


def corrections(words: DataFrame, terms: DataFrame, most: int = 2, least: float = 80.0) -> DataFrame:
    """word -> wrong, canonical, entry, distance, ratio: for different words of three characters and more the term (wrong,
    canonical, entry) within a distance of ``most`` (2 at most) and of an Indel ratio of ``least`` at least; of several the
    one with the best ratio, then the first entry. A ratio of r lets a word of n characters lack n (1 - r) / (1 - r / 2)
    at most, so short words have few strings."""
    if most > 2:
        raise ValueError("words are listed without two characters at most")
    share = (1 - least / 100) / (1 - least / 200)
    lacking = lambda n: F.least(F.lit(most), F.floor(n * F.lit(share) + F.lit(1e-9)))
    left = words.select("word").filter(F.length("word") >= 3).distinct()
    pairs = met(left, terms.select("wrong").filter("wrong IS NOT NULL").distinct(), "word", "wrong", lacking)
    pairs = pairs.withColumn("ratio", 200.0 * F.col("shared") / (F.length("word") + F.length("wrong"))).filter(F.col("ratio") >= least)
    pairs = pairs.withColumn("distance", F.levenshtein("word", "wrong", most)).filter("distance >= 0")
    near = pairs.join(terms.select("wrong", "canonical", "entry"), "wrong")
    return near.groupBy("word").agg(F.min_by(F.struct("wrong", "canonical", "entry", "distance", "ratio"), F.struct(-F.col("ratio"), "entry")).alias("best")).select("word", "best.*")
