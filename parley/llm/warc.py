"""WARC archives of page captures: written as records, read back and assembled per capture.

Each page becomes three records: a request, a response or revisit, and metadata. The request and the metadata name the
response in WARC-Concurrent-To. Pages of equal payload of at least ``REVISIT_BYTES`` bytes are stored once: the one with
the largest page_id is the response, the others are revisits that refer to it.

Files are written by Spark's text writer, so that they may lie in any store Spark reaches: a record ends with a line feed,
which is the writer's line separator. Each file holds a bounded number of records. Reading parses whole files by the
content lengths.

A null html counts as empty, a null url has no target header, a null page_id no field in the metadata; white space in a url
is dropped. Rows that repeat are captures of their own; of equal payloads with equal largest page_id, one is the response.
An empty table writes no record and reads none. Columns besides the three are not archived.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.skew import lookup_join, salted_join
from ..session import cut_lineage
from .common import bounded_batches

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 600
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"  # fixed by the format
DATE = "2024-01-01T00:00:00Z"  # captures carry no time of their own


def record_id(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), row.cast("string")))
    parts = [F.substring(h, *x) for x in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(kind: Column | str, rid: Column, block: Column, *headers: tuple[str, Column]) -> Column:
    """A record without its last line feed, which the writer adds."""
    lines = [F.lit("WARC/1.0\r\n"), F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), rid,
             F.lit(f"\r\nWARC-Date: {DATE}\r\n")]
    lines += [F.coalesce(F.concat(F.lit(f"{n}: "), v, F.lit("\r\n")), F.lit("")) for n, v in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write(pages: DataFrame, folder: str) -> None:
    """Write the archives of ``pages`` (page_id, url, html) to ``folder``.

    Rows are told apart by their place in the table, so ``pages`` must be a stored table, which reads the same twice.
    """
    pages = pages.select("page_id", F.regexp_replace("url", r"\s", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"row": F.monotonically_increasing_id(), "digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    known = pages.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max(F.struct("page_id", "row"))["row"].alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = cut_lineage(known.select(F.col("digest").alias("key"), "first"))
    # payloads that are no copies get a key of their own, so that none of them meet
    pages = pages.withColumn("key", F.when(F.col("size") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("row "), F.col("row").cast("string"))))
    # a row of `known` is a digest and a number, so the counted bound of the broadcast bounds its bytes, too
    p = lookup_join(pages, known, ["key"], "left", by=["row"]).withColumn("again", F.coalesce(F.col("first") != F.col("row"), F.lit(False)))
    mine, uri = record_id("response", F.col("row")), ("WARC-Target-URI", F.col("url"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    site = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    place = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*(/[^#]*)", 1), F.lit(""))
    place = F.when(place == "", F.lit("/")).otherwise(place)
    answer = record(F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")), mine,
                    F.when(F.col("again"), head).otherwise(F.concat(head, F.col("html"))), uri,
                    ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                    ("WARC-Refers-To", F.when(F.col("again"), record_id("response", F.col("first")))),
                    ("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE))))
    request = record("request", record_id("request", F.col("row")), F.concat(F.lit("GET "), place, F.lit(" HTTP/1.1\r\nHost: "), site, F.lit("\r\n\r\n")),
                     uri, ("Content-Type", F.lit("application/http; msgtype=request")), ("WARC-Concurrent-To", mine))
    about = record("metadata", record_id("metadata", F.col("row")), F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
                   uri, ("Content-Type", F.lit("application/warc-fields")), ("WARC-Concurrent-To", mine))
    (p.select(F.explode(F.array(answer, request, about)).alias("value"))
     .write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def parse(data: bytes):
    """The records of an archive: (headers, block) with the header names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, n = end + 4, int(headers["content-length"])
        if len(data) < start + n + 4 or data[start + n:start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[start:start + n]
        at = start + n + 4


RECORD = ("type string, record_id string, concurrent_to string, refers_to string, uri string, digest string,"
          " http_head string, payload binary")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder``; of HTTP blocks, the head and the payload apart."""
    import pyarrow as pa

    fields = ["warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-payload-digest"]
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.binary()]
    bounded_batches(spark)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for headers, block in parse(zlib.decompress(content.as_py(), 31)):
                    head = None
                    if headers.get("content-type", "").startswith("application/http"):
                        top, _, block = block.partition(b"\r\n\r\n")
                        head = top.decode()
                    rows.append([*map(headers.get, fields), head, block])
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt.gz").load(folder).select("content")
    return files.mapInArrow(run, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, type, request, response, metadata, refers_to (the record id of a revisit).

    Requests and metadata are joined through their concurrent-to ids; a capture that lacks one has null there. ``found`` may
    carry any columns besides the ids and the type; they go into the nested rows. It is read once per kind of record, so
    what is needed of the records is best stored first: else each read parses the archives anew.
    """
    rest = [c for c in found.columns if c not in ("type", "record_id", "concurrent_to", "refers_to")]
    main = found.filter(F.col("type").isin("response", "revisit")).select("record_id", "type", "refers_to", F.struct(*rest).alias("response"))
    out = main
    for kind in ("request", "metadata"):
        side = found.filter(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", *rest).alias(kind))
        out = out.join(side, "record_id", "left")
    return out


def resolved(found: DataFrame) -> DataFrame:
    """Captures with the response record that a revisit refers to, as ``original`` (null for responses)."""
    c = captures(found)
    targets = c.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.struct("response", "metadata").alias("original"))
    revisits = salted_join(c.filter("refers_to IS NOT NULL"), targets, ["refers_to"], "left")
    plain = c.filter("refers_to IS NULL").withColumn("original", F.lit(None).cast(targets.schema["original"].dataType))
    return plain.unionByName(revisits)


SQL = """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to FROM p LEFT JOIN g ON g.h = p.h AND n >= 1000
"""
