"""From documents to token ids: quality, near copies, repeated passages, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the
shared folder and rereads it, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontaminate import contaminated, matches
from lectern.llm.jaccard_join import jaccard_components, text_key
from lectern.llm.quality import scored, train
from lectern.llm.sentencepiece_codec import encoded
from lectern.llm.storage import dropped, perhaps_in, scratch, written
from lectern.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (a score of 0.5 and more). Null and empty texts are scored like any
    other; without labels nothing is rejected."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).filter("score >= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the first by id (nulls last) and by a
    hash of the text: rows are told apart by both, so of two linked texts of one id one goes. Rows with equal ids and
    texts count as one. Documents that are kept and have one row don't move."""
    found = jaccard_components(docs, shingle=5, percent=80)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key"))
    texts = found.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.count_if(stays).alias("kept")).filter("n > 1 OR kept = 0")
    texts = written(texts.select(F.xxhash64("doc_id", "key").alias("text_id"), "doc_id", "key", "n", "kept"), "texts")
    rows = docs.select(docs.doc_id.cast("long").alias("id"), text_key("text").alias("own"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = perhaps_in(rows.withColumn("text_id", F.xxhash64("id", "own")), texts, "text_id")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("key"))
    met = rows.filter("met").join(texts.drop("text_id"), same, "left").filter("coalesce(kept, 1) > 0")
    again = met.filter("n > 1").dropDuplicates(["id", "own"])
    out = rows.filter("NOT met").select("row").unionByName(met.filter("coalesce(n, 1) = 1").select("row")).unionByName(again.select("row"))
    return out.select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 35 words that occur more than once; a document left without a word goes. Null and
    empty texts, and those of fewer words, stay as they are; equal rows are occurrences of each other."""
    out = remove_repeats(docs, layout=True)
    cut = F.size("removed_from") > 0
    text = F.when(cut, F.trim("kept")).otherwise(F.col("row.text"))
    out = out.filter(~cut | F.col("kept").rlike(r"[^\x20\x09-\x0D]")).withColumn("row", F.col("row").withField("text", text))
    return out.select(F.col("row").withField("n_chars", F.when(cut, F.length("row.text").cast("long")).otherwise(F.col("row.n_chars"))).alias("row")).select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty are in passages of the benchmark. Null and empty texts stay."""
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(~contaminated()).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a null or empty text has none."""
    return encoded(docs).select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can't express the classifier; tests/llm/test_pipeline.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row. Each result is written and reread; what a stage wrote before is deleted once the next one's
    result stands. An empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with scratch() as keep:
            docs = keep(written(stage(spark, before, sf_dir), name))
        dropped(before)
    return docs
