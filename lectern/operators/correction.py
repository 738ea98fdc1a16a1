"""Fuzzy correction of texts by a dictionary (wrong, canonical, entry)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.segments import indel_ratios
from lectern.operators.library import fuzzy_corrections

WORD = r"(?U)\b\w+\b"
PIECES = r"(?Us)\b\w+\b|(?:(?!\b\w).)+"


def corrections(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word (lower case) -> canonical, distance, confidence, exact. A dictionary word needs no ratio; the others take the
    best term by ratio. How the two meet is the engine's choice by their sizes."""
    words = words.select("word").distinct().filter(F.length("word") >= 3)
    exact = words.join(terms, words.word == F.col("wrong")).select("word", "canonical", F.lit(0).alias("distance"), F.lit(100.0).alias("confidence"), F.lit(True).alias("exact"))
    rest = words.join(terms.select(F.col("wrong").alias("word")), "word", "left_anti")
    near = fuzzy_corrections(rest, terms).select("word", "canonical", "distance", F.col("ratio").alias("confidence"), F.lit(False).alias("exact"))
    return exact.unionByName(near)


def suggestions(words: DataFrame, terms: DataFrame, most: int = 5, least: float = 50.0) -> DataFrame:
    """The ``most`` best terms of each word by ratio (at least ``least`` of 100), in order: rank, canonical, score,
    distance. Words and terms meet on their lengths, of which one is at most (200 - least) / least times the other; the
    ratios of all words that meet a term are computed at once, a bit for each of its characters."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        words, out = a.to_numpy(), np.zeros(len(a))
        for term, at in b.groupby(b, sort=False).indices.items():
            out[at] = indel_ratios(words[at].tolist(), term)
        return pd.Series(out)

    wide = (200 - least) / least
    left = words.select("word").distinct().filter(F.length("word") > 0).withColumn("size", F.length("word"))
    sizes = F.sequence(F.ceil(F.length("wrong") / F.lit(wide)).cast("int"), F.floor(F.length("wrong") * F.lit(wide)).cast("int"))
    right = terms.select("wrong", "canonical", "entry", F.explode(sizes).alias("size"))
    met = left.join(right, "size").withColumn("score", ratio("word", "wrong")).filter(F.col("score") >= least)
    w = Window.partitionBy("word").orderBy(F.desc("score"), "entry")
    out = met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return out.select("word", "rank", "canonical", "score", F.levenshtein("word", "wrong").alias("distance"))


def corrected(df: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns with ``corrected``, ``corrections`` (original, corrected, position among words and what is between
    them, distance, confidence) and ``confidence``, the mean over words of three characters and more (1 for a blank text,
    100 without such words). Only different words meet the dictionary; texts move once, to meet what was found for them.
    Ids tell rows apart; a null text is null with no corrections."""
    low = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD), F.lit(0)), F.lower))
    words = df.select(F.col(id_col).alias("_id"), F.explode(F.filter(low, lambda w: F.length(w) >= 3)).alias("word"))
    found = words.join(corrections(words, terms), "word").groupBy("_id")
    found = found.agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("canonical", "distance", "confidence", "exact")))).alias("_found"))
    out = df.join(found, F.col(id_col) == F.col("_id"), "left").drop("_id")
    own = lambda p: F.try_element_at(F.coalesce("_found", F.create_map().cast(found.schema["_found"].dataType)), F.lower(p))
    pieces = F.transform(
        F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(PIECES), F.lit(0)),
        lambda p, i: F.struct(p.alias("piece"), i.alias("position"), p.rlike(WORD).alias("word"), own(p).alias("to")),
    )
    out = out.withColumn("_pieces", pieces)
    used = lambda p: p.word & (F.length(p.piece) >= 3) & p.to.isNotNull() & (~p.to.exact | (p.to.canonical != p.piece))
    done = F.transform(F.filter("_pieces", used), lambda p: F.struct(p.piece.alias("original"), p.to.canonical.alias("corrected"), p.position.alias("position"), p.to.distance.alias("distance"), p.to.confidence.alias("confidence")))
    long_words = F.filter("_pieces", lambda p: p.word & (F.length(p.piece) >= 3))
    sure = F.aggregate(long_words, F.lit(0.0), lambda a, p: a + F.when(used(p), p.to.confidence).otherwise(100.0)) / F.size(long_words)
    blank = F.coalesce(F.col(text_col), F.lit("")).rlike(r"(?U)^\s*$")
    text = F.array_join(F.transform("_pieces", lambda p: F.when(used(p), p.to.canonical).otherwise(p.piece)), "")
    out = out.withColumn("corrected", F.when(F.col(text_col).isNotNull(), text)).withColumn("corrections", done)
    return out.withColumn("confidence", F.when(blank, 1.0).when(F.size(long_words) == 0, 100.0).otherwise(sure)).drop("_pieces", "_found")
