"""Content-addressed web archive.

``archive`` writes two tables: ``payloads`` holds each distinct payload once, under its SHA-256 digest; ``records``
holds for every record its exact header bytes and the digest of its payload. ``records_of`` joins them back into the
original WARC/1.1 records, verifying each payload's digest once, and ``parse_record`` reads such bytes.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is a response, the others are
revisits that refer to it; smaller payloads are always responses.

Edge cases: a null payload is empty; a null id is smaller than every other, and its record names no id; a null or
broken url gets an empty target; repeated ids with equal payloads give one response, the others (ties by url, then
arbitrarily) are revisits of that id; the number of copies of a payload has no effect on any task's size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.storage import dropped, removed, shared_dir, written

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests of 16 first digits make the WARC-Record-ID; the same record always gets the same one.
_CRLF = "\r\n"


def _uuid(key) -> F.Column:
    h = F.md5(key)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _headers() -> F.Column:
    """WARC header bytes of a record. A header's value holds no line breaks."""
    own = lambda i: F.concat(F.lit("page:"), F.coalesce(i.cast("string"), F.lit("")))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), _uuid(F.concat(own(F.col("page_id")), F.lit(":"), F.col("digest"), F.lit(":"), target))),
        F.concat(F.lit("WARC-Target-URI: "), target), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit("Content-Type: text/html; charset=utf-8"),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.coalesce(F.col("refers_to").cast("string"), F.lit("")))),
        F.when(revisit, F.concat(F.lit("WARC-Original-Payload-Length: "), F.col("payload_bytes"))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
    ]
    return F.encode(F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2)), "UTF-8")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """Write ``records`` and ``payloads`` under ``path``. Payloads move once, to meet their copies, and only after each
    task has kept one of the copies it has; digests and ids move for the choice of the response."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    base = base.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    rows = written(base.drop("payload").withColumn("rid", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), F.coalesce("url", F.lit("")), "rid")
    best = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max_by("rid", order).alias("first"), F.max("page_id").alias("first_id"))
    typed = rows.join(best, "digest", "left").withColumn("revisit", F.coalesce(F.col("first") != F.col("rid"), F.lit(False)))
    typed = typed.select("page_id", "url", "digest", "sha1", "payload_bytes", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"))
    typed.select("digest", _headers().alias("headers"), (F.col("record_type") == "revisit").alias("revisit")).write.option("compression", "zstd").parquet(f"{path}/records")
    dropped(rows)
    base.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (first line under "") and body of a WARC record; ValueError if it is not whole."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split(_CRLF)
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the bytes of every original record; ``digest`` and ``length`` of its payload as stored and verified.
    A payload that doesn't have its digest raises. Only responses fetch payload bytes."""
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    good = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))))
    lengths = good.select("digest", F.octet_length("payload").cast("long").alias("length"), F.sha1("payload").alias("sha1"))
    end = F.lit(_CRLF * 2).cast("binary")
    responses = records.filter("NOT revisit").join(good, "digest").select("digest", F.octet_length("payload").cast("long").alias("length"), F.sha1("payload").alias("sha1"), F.concat("headers", "payload", end).alias("record"))
    revisits = records.filter("revisit").join(lengths, "digest").select("digest", "length", "sha1", F.concat("headers", end).alias("record"))
    return responses.unionByName(revisits)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for length, sha1, record in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            fields, body = parse_record(record)
            revisit = fields["warc-type"] == "revisit"
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            if digest != (sha1 if revisit else hashlib.sha1(body).hexdigest()):
                raise ValueError(f"payload digest of {fields['warc-record-id']} is wrong")
            own, to = fields["warc-page-id"], fields.get("warc-refers-to-page-id")
            out.append((int(own) if own else None, length, digest, fields["warc-type"], int(to) if to else None))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """What the records of the archive of all pages say once they are read back; the archive goes after that."""
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{path}/warc")
    said = records_of(spark, f"{path}/warc").select("length", "sha1", "record").mapInArrow(_parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    out = written(said, "said")
    removed(spark, path)
    return out


OP3_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM s)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM t
"""
