"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
#: While a table is written: bounds of what Python and the JVM hold at once of texts and sets; an end to the job's
#: shuffle files with the job, since what it made is in the table; and no broadcast but those that the code asks for, of
#: data with a proven bound, so that a plan is the same at every size and skewed joins can be split.
_WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20,
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.adaptive.autoBroadcastJoinThreshold": -1,
}
#: Bits of ``perhaps_in``'s filter; 2 MB, whatever the input.
BITS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine (tests), a temporary
    one; on a cluster without it ValueError, since a machine's own folder can't be read by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _OWN[app]


@contextmanager
def _while_writing(spark: SparkSession) -> Iterator[None]:
    """Hold the session to ``_WRITING``, and give it back its own settings after that."""
    own = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Tables written within the open ``scratch`` blocks.
_OPEN: list[list[DataFrame]] = []
#: Tables written so far; the driver collects its garbage (plans, broadcasts) after every ``_GARBAGE`` of them.
_count, _GARBAGE = itertools.count(1), 8


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, so a lost
    executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}/{name}"
    with _while_writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    if next(_count) % _GARBAGE == 0:
        spark.sparkContext._jvm.System.gc()
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads; others are left alone."""
    for table in tables:
        path = getattr(table, "_lectern_path", None)
        if path:
            removed(table.sparkSession, path)
            table._lectern_path = None


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within the block, keep track of written tables; at its end all go but those handed to the yielded function, and
    the driver collects its garbage, so that executors let go of broadcasts that nothing refers to."""
    _OPEN.append([])
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        own = _OPEN.pop()
        for table in own:
            if any(table is k for k in kept):
                if _OPEN:
                    _OPEN[-1].append(table)
            else:
                dropped(table)
        if own:
            own[0].sparkSession.sparkContext._jvm.System.gc()


def perhaps_in(base: DataFrame, rows: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``base`` with ``met``: false only where no row of ``rows`` has the key (nulls are equal). So rows without a
    partner needn't move in a join. The filter is one bitmap of a fixed size, so it can be broadcast; once it fills up,
    more rows are met than need be, never fewer."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    pages = rows.select((h / 32768).cast("long").alias("_page"), (h % 32768).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = F.expr("conv(hex(substring(_bits, _bit div 8 + 1, 1)), 16, 10)").cast("int").bitwiseAND(F.expr("shiftleft(1, CAST(_bit % 8 AS INT))")) > 0
    out = base.withColumn("_page", (h / 32768).cast("long")).withColumn("_bit", h % 32768).join(F.broadcast(pages), "_page", "left")
    return out.select(*(base[c] for c in base.columns), F.coalesce(bit, F.lit(False)).alias("met"))


def framed(docs: DataFrame, more: str = ""):
    """All columns as one, ``row``, and the schema of it with the columns of ``more`` (DDL)."""
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return out, T.StructType([out.schema["row"], *(T._parse_datatype_string(more).fields if more else [])])
