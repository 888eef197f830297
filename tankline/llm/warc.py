"""WARC archives: writing captures, reading them back, assembling transactions.

``write`` gives every page a request, a response or revisit, and a metadata record.
Request and metadata name the response in ``WARC-Concurrent-To``. Of equal payloads of
at least ``min_bytes`` the page with the largest id keeps the body, the others become
revisits that refer to it. Records are built and written by Spark (text sink, records
ended by two CRLFs) into a shared folder; ``read`` parses whole archive files by
``Content-Length``, so payloads may hold anything; ``assemble`` joins the records by
their concurrent-to identifiers, whichever side names the other, into one nested row
per capture.

Defined cases: a null payload is empty; a null page id or URL stays null; repeated
rows are written and come back one by one, rows that tie for the response are all
responses; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tankline.operators.joins import checked_broadcast

MIN_BYTES = 1000
RECORDS_PER_FILE = 15_000
CRLF = "\r\n"
RECORD = ("type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
          "digest string, content_type string, payload binary")


def _header(name: str, value: Column) -> Column:
    """A header line; nothing for a null value. Line ends in values are percent-encoded."""
    v = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), v, F.lit(CRLF)), F.lit(""))


def _record(kind: Column, rid: Column, block: Column, content_type: str, extra: list[Column], date: str) -> Column:
    """Without the two line ends behind it, which the sink adds."""
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", kind), _header("WARC-Record-ID", rid), *extra,
                    _header("WARC-Date", F.lit(date)), _header("Content-Type", F.lit(content_type)),
                    _header("Content-Length", F.octet_length(block)), F.lit(CRLF), block)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(id, url, body, digest, bytes, refers): ``refers`` is (id, url) of the response that a
    revisit refers to, else null."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"))
    p = p.select("id", "url", "body", F.sha1("body").alias("digest"), F.octet_length("body").cast("long").alias("bytes"))
    # per repeated payload the response; only digests that occur twice go on, so this side is narrow
    first = (p.where(F.col("bytes") >= min_bytes).groupBy("digest")
             .agg(F.max(F.struct("id", "url")).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    p = p.join(checked_broadcast(first), "digest", "left")
    same = F.col("id").eqNullSafe(F.col("r.id")) & F.col("url").eqNullSafe(F.col("r.url"))
    return p.withColumn("refers", F.when((F.col("bytes") >= min_bytes) & F.col("r").isNotNull() & ~same, F.col("r"))).drop("r")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = MIN_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archive files of ``pages`` under ``path`` (a folder that all executors share)."""
    p = with_revisits(pages, id_col, url_col, payload_col, min_bytes)

    def urn(i: Column, url: Column, kind: str) -> Column:
        return F.concat(F.lit("<urn:capture:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"),
                        F.hex(F.xxhash64(url)), F.lit(":"), F.col("digest"), F.lit(f":{kind}>"))

    rid = urn(F.col("id"), F.col("url"), "response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(F.col("refers").isNull(), F.col("body").cast("string")).otherwise(F.lit("")))
    uri, digest = _header("WARC-Target-URI", F.col("url")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    to = _header("WARC-Concurrent-To", rid)
    refers = F.when(F.col("refers").isNotNull(), urn(F.col("refers.id"), F.col("refers.url"), "response"))
    kind = F.when(F.col("refers").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    profile = F.when(F.col("refers").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields = F.concat(_header("page-id", F.col("id")), _header("payload-bytes", F.col("bytes")),
                      _header("refers-to-page", F.col("refers.id")))
    get = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    records = F.array(
        _record(F.lit("request"), urn(F.col("id"), F.col("url"), "request"), get, "application/http; msgtype=request", [uri, to], date),
        _record(kind, rid, block, "application/http; msgtype=response",
                [uri, digest, _header("WARC-Refers-To", refers), _header("WARC-Profile", profile)], date),
        _record(F.lit("metadata"), urn(F.col("id"), F.col("url"), "metadata"), fields, "application/warc-fields", [uri, to], date))
    (p.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF)
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse_file(data: bytes) -> Iterator[dict]:
    """The records of one archive file (plain, or gzip members), in order."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        pairs = [x.split(b":", 1) for x in data[at:end].split(b"\r\n")[1:] if b":" in x]
        head = {}
        for k, v in pairs:
            head.setdefault(k.strip().lower(), []).append(v.strip().decode("utf-8", "replace"))
        start = end + 4
        at = start + int(head.get(b"content-length", ["0"])[0])
        block, kind = data[start:at], head.get(b"warc-type", [""])[0]
        content = head.get(b"content-type", [""])[0]
        if content.startswith("application/http") and (cut := block.find(b"\r\n\r\n")) >= 0:
            block = block[cut + 4 :]
        one = lambda k: head.get(k, [None])[0]
        yield {"type": kind, "record_id": one(b"warc-record-id"), "concurrent_to": head.get(b"warc-concurrent-to", []),
               "refers_to": one(b"warc-refers-to"), "target_uri": one(b"warc-target-uri"), "date": one(b"warc-date"),
               "digest": one(b"warc-payload-digest"), "content_type": content, "payload": block}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files under ``path``. A task holds one file at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                out, size = [], 0
                for r in parse_file(bytes(data)):
                    out.append(r)
                    size += len(r["payload"])
                    if size > 4_000_000 or len(out) >= 5000:
                        yield pd.DataFrame(out)
                        out, size = [], 0
                if out:
                    yield pd.DataFrame(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit record: ``capture_id`` and the structs ``response``,
    ``request``, ``metadata`` (null if absent; of several the one with the largest id)."""
    whole = F.struct(*[F.col(c) for c in records.columns])
    main = records.where(F.col("type").isin("response", "revisit", "resource")).select(
        F.col("record_id").alias("capture_id"), whole.alias("response"), F.col("concurrent_to").alias("_named"))
    side = records.where(F.col("type").isin("request", "metadata")).select("type", "record_id", "concurrent_to", whole.alias("r"))
    # a side record names its capture, or the capture names it
    by_side = side.select("type", "r", F.explode("concurrent_to").alias("capture_id"))
    named = main.select("capture_id", F.explode("_named").alias("record_id")).distinct()
    by_main = side.join(named, "record_id").select("type", "r", "capture_id")
    both = by_side.unionByName(by_main)
    parts = both.groupBy("capture_id").agg(
        F.max_by("r", F.when(F.col("type") == "request", F.col("r.record_id"))).alias("request"),
        F.max_by("r", F.when(F.col("type") == "metadata", F.col("r.record_id"))).alias("metadata"))
    return main.drop("_named").join(parts, "capture_id", "left")


def scratch(spark: SparkSession, root: str) -> str:
    return f"{root.rstrip('/')}/warc-{uuid.uuid4().hex}"
