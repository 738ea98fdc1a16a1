"""Sinks of live streams: each micro-batch once, and a bounded queue of results.

Both write a folder for each micro-batch, named by its number. A batch that is replayed after a stop has the rows and the
number that it had before, and replaces what its first attempt left, so a stop between the write and the commit of the
checkpoint neither loses nor doubles a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to


def _numbers(spark: SparkSession, path: str) -> set[int]:
    """Batches that are written whole in a folder."""
    fs, to = _path(spark, path)
    if not fs.exists(to):
        return set()
    found = [s.getPath() for s in fs.listStatus(to) if s.getPath().getName().startswith("batch=")]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return {int(p.getName().split("=")[1]) for p in found if fs.exists(done(p, "_SUCCESS"))}


class Batches:
    """Writes each micro-batch to ``path`` once; ``read`` gives the rows of all written ones."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows with the number of their ``batch``; folders that a stopped attempt left unfinished don't count."""
        whole = sorted(_numbers(spark, self.path))
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if not whole:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/batch={k}" for k in whole))

    def last(self, spark: SparkSession, number: int) -> DataFrame:
        """Rows of the last batch before ``number``; those before it, which no replay goes back to, are deleted."""
        whole = sorted(k for k in _numbers(spark, self.path) if k < number)
        for k in whole[:-1]:
            fs, to = _path(spark, f"{self.path}/batch={k}")
            fs.delete(to, True)
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch={whole[-1]}") if whole else spark.createDataFrame([], self.schema)


class ResultQueue:
    """A queue of at most ``size`` rows between a stream and its readers: of a micro-batch the first rows by ``order`` fit
    in, the others are dropped and counted. ``size`` is a small fixed number, a queue's room."""

    def __init__(self, path: str, size: int, order: list[str], schema: T.StructType):
        self.path, self.size, self.order, self.schema = path, size, order, schema

    def _batches(self, kind: str) -> Batches:
        return Batches(f"{self.path}/{kind}", self.schema if kind == "rows" else T._parse_datatype_string("dropped long"))

    def write(self, rows: DataFrame, number: int) -> None:
        """Room is what the rows of other batches leave that nobody has taken."""
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            room = max(0, self.size - self.waiting(spark).filter(F.col("batch") != number).count())
            self._batches("rows").write(rows.orderBy(*self.order).limit(room), number)
            dropped = max(0, rows.count() - room)
            self._batches("drops").write(spark.createDataFrame([(dropped,)], "dropped long"), number)
        finally:
            rows.unpersist()

    def waiting(self, spark: SparkSession) -> DataFrame:
        """Rows that nobody has taken."""
        taken = _numbers(spark, f"{self.path}/taken")
        return self._batches("rows").read(spark).filter(~F.col("batch").isin([*taken, -1]))

    read = waiting

    def take(self, spark: SparkSession, read: Callable[[DataFrame], None]) -> None:
        """Hand all waiting rows to ``read``; they count as taken once it returns."""
        taken = _numbers(spark, f"{self.path}/taken")
        numbers = sorted(_numbers(spark, f"{self.path}/rows") - taken)
        read(self._batches("rows").read(spark).filter(F.col("batch").isin([*numbers, -1])))
        for k in numbers:
            spark.createDataFrame([(k,)], "taken long").write.mode("overwrite").parquet(f"{self.path}/taken/batch={k}")

    def dropped(self, spark: SparkSession) -> int:
        return self._batches("drops").read(spark).agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("n")).first().n
