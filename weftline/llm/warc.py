"""WARC archives with revisit resolution.

Headers are shuffled by payload digest; of equal payloads one record stays a response and the others become revisits
of it, with fresh headers and without the payload. Read back, each revisit is joined to its original response.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import fresh_path, small, stage

#: Payloads of fewer bytes are stored again instead of being revisited.
MIN_REVISIT = 1000
#: Bounds of an archive: records, and bytes of payloads; a larger payload is an archive of its own.
RECORDS_PER_FILE, FILE_BYTES = 20_000, 64 << 20
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(refers_to: Column, date: str) -> Column:
    """The bytes of one record, written at date, as text, without the closing blank lines (the sink's line separator)."""
    revisit = refers_to.isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\s<>]", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(f">\r\nWARC-Profile: {_PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), block_bytes.cast("string"), F.lit(_END), http, F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )


def _with_digest(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    return rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))


def _archive_numbers(most_bytes: int, most_records: int) -> Callable[[Column], Column]:
    """The archive of each record by the running bytes of its task: a new one where the next record would go beyond a bound."""

    @F.pandas_udf("int")
    def numbers(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        archive, held, records = 0, 0, 0
        for batch in sizes:
            out = []
            for n in batch.tolist():
                if records and (held + n > most_bytes or records >= most_records):
                    archive, held, records = archive + 1, 0, 0
                held, records = held + n, records + 1
                out.append(archive)
            yield pd.Series(out, dtype="int32")

    return numbers


def revisited(headers: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Headers (page_id, payload_bytes, payload_digest, ...) whose payload another record holds, with that record's page_id as original."""
    by = ["payload_digest", "payload_bytes"]
    shared = headers.where(F.col("payload_bytes") >= min_revisit).groupBy(*by).agg(F.max("page_id").alias("original"), F.count("*").alias("rows"))
    shared = stage(shared.where("rows > 1").drop("rows"), "shared-payloads")
    return headers.join(small(shared, 500_000), by).where(F.coalesce(F.col("page_id") < F.col("original"), F.col("original").isNotNull()))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write a record for every row of pages (page_id, url, html) into gzipped archives under path.

    Of rows with equal payloads of at least min_revisit bytes, those with the largest page_id are responses and the
    others, those without page_id too, revisit it; where none has a page_id, all are responses. A null html is an empty payload; a null url an
    empty one. Record ids are page ids, so repeated rows repeat them. Each file is one gzip stream, of FILE_BYTES and RECORDS_PER_FILE at most unless
    one payload is larger. Payloads are read twice, to be hashed and to be written; only headers are grouped, and payloads are shuffled (by page, not by
    digest) only where there are too many revisits to send to every task. Other columns are left out.
    """
    rows = _with_digest(pages)
    headers = stage(rows.drop("html"), "headers")
    again = stage(revisited(headers, min_revisit).withColumn("html", F.lit("")), "revisits")
    same = F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.payload_digest") == F.col("v.payload_digest"))
    keys = stage(again.select("page_id", "payload_digest").distinct(), "revisit-keys")
    first = rows.alias("r").join(small(keys, 500_000).alias("v"), same, "left_anti").withColumn("original", F.lit(None).cast("long"))
    numbers = _archive_numbers(FILE_BYTES, RECORDS_PER_FILE)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    for kind, part in (("responses", first), ("revisits", again)):
        out = part.withColumn("archive", numbers(F.octet_length("html").cast("long"))).select(_record(F.col("original"), date).alias("value"), "archive")
        out.write.partitionBy("archive").option("lineSep", _END).option("compression", "gzip").text(f"{path}/{kind}")


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a gzipped archive, which is unpacked as far as one record goes."""
    with gzip.open(io.BytesIO(content)) as archive:
        while first := archive.readline():
            if not first.strip():
                continue
            lines = [x.decode() for x in iter(archive.readline, b"\r\n")]
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            yield fields, archive.read(int(fields["content-length"]))


def _page(field: str | None) -> int | None:
    number = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in _records(content.as_py()):
                _, _, payload = block.partition(b"\r\n\r\n")
                full = fields["warc-type"] == "response"
                rows.append((_page(fields["warc-record-id"]), fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), _page(fields.get("warc-refers-to")), len(payload) if full else None, hashlib.sha1(payload).hexdigest() if full else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "record_type", "digest", "refers_to", "bytes", "found"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, digest, refers_to, bytes, found) of every record: digest as its header has it, bytes and found (the digest) as its payload has them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(_parse, "page_id long, record_type string, digest string, refers_to long, bytes long, found string")


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; revisits have the payload of the response that they refer to.

    A revisit whose response is missing, or has another digest, keeps null in payload_bytes and payload_digest. Repeated records
    are resolved as often as they come.
    """
    own = records.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("found").alias("digest"), F.col("bytes").alias("payload_bytes")).dropDuplicates(["refers_to", "digest"])
    originals = stage(originals, "originals")
    again = records.where("record_type = 'revisit'").select("page_id", "digest", "refers_to").join(originals, ["digest", "refers_to"], "left")
    again = again.select("page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("digest")).alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return own.unionByName(again)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages into archives and resolve what is read back; an empty table gives an empty one."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path)
    return resolve(stage(read_archives(spark, path), "records"))


ROUND_TRIP_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM (SELECT page_id, payload_bytes, payload_digest, max(page_id) OVER (PARTITION BY payload_digest) AS top
      FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages))
"""
