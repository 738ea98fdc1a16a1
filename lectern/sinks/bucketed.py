"""Tables that are written dealt by a key, so that later joins and groups on it don't shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lectern.sinks.shared import folder

#: Bytes of the read files for each bucket, and the least number of buckets.
BUCKET, LEAST = 8 << 20, 8


def buckets_for(*tables: DataFrame) -> int:
    """A number of buckets that grows with the largest of the tables (by the planner's size), so that a task's doesn't."""
    size = max(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in tables)
    return max(LEAST, -(-size // BUCKET))


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "table") -> DataFrame:
    """``df`` as a table of ``buckets`` sorted buckets of ``key``. Tables with the same number of buckets of a key join
    without an exchange, also when they are read by other sessions that know the table. Each task writes one bucket."""
    spark, table = df.sparkSession, f"lectern_{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", folder(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)
