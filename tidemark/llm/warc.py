"""WARC archives: written by Spark, indexed first, then read by coalesced byte ranges.

Spark's text writer lays the records down (a record ends in two line breaks,
which is its line separator), on whatever file system the folder is. An index
pass jumps from header to header and stores offset, length, URL and digest of
each record. Reads take rows of the index, sort them by archive and offset,
join neighbouring ranges and fetch each joined range at once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, shared_dir, table

CRLF = "\r\n"
END = CRLF + CRLF
#: Payloads below this size are never written as revisits.
LEAST_REVISIT = 100
#: A duplicate table of at most so many rows (100 bytes each) is broadcast, a larger one joined by shuffle.
BROADCAST_ROWS = 200_000
#: Ranges at most so far apart are read at once, up to so many bytes.
GAP, MOST = 64 << 10, 8 << 20
#: Bytes of an archive whose records go to one reading task.
BLOCK = 64 << 20
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, record_id string, refers_to string"
RECORD_ID = "urn:tidemark:page:"


def plan_records(pages: DataFrame, base: str) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest, record_type and refers_to.

    Of equal payloads of at least 100 bytes the smallest page_id is the
    response (all rows of that id, if rows repeat), the others revisit it. A
    null html is an empty payload. A null page_id is larger than any; where
    all of a group are null, all are responses.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    twice = p.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    twice = materialise(twice.select("digest", "first"), base, "twice")
    small = twice.count() <= BROADCAST_ROWS
    out = p.join(F.broadcast(twice) if small else twice, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, path: str) -> None:
    """One archive for each partition of ``records``. Line breaks in URLs are escaped."""
    ident = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(END))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", ident("page_id")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), ident("refers_to"))),
        line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")), F.lit(CRLF),
    )
    records.select(F.concat(head, http, body).alias("value")).write.option("lineSep", END).text(path)


def _open(archive: str):
    """A seekable file on any file system that Arrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    uri = archive if "://" in archive else archive.replace("file:/", "file:///", 1)
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split(CRLF)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def index_archives(spark, path: str) -> DataFrame:
    """One row of ``INDEX`` for each record; only headers are read, payloads are jumped over."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")

    def scan(batches):
        for batch in batches:
            for archive, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                with _open(archive) as f:
                    while at < total:
                        want = 2048
                        while (cut := (block := f.read_at(min(want, total - at), at)).find(END.encode())) < 0:
                            if want >= total - at:
                                raise ValueError(f"{archive}: no record at {at}")
                            want *= 4
                        h = _headers(block[:cut])
                        length = cut + 4 + int(h["content-length"])
                        rows.append((archive, at, length, h.get("warc-target-uri"), h["warc-payload-digest"], h["warc-type"], h["warc-record-id"], h.get("warc-refers-to")))
                        at += length + 4
                        if len(rows) >= 5000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return files.mapInArrow(scan, INDEX)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in INDEX.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_records(selected: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the selected index rows: ids, sizes, digests computed anew and payloads.

    ``payload_bytes`` is the size of the full payload (a revisit states it in
    its HTTP header); a response's digest is computed from the bytes read.
    """
    blocks = selected.repartition("archive", F.floor(F.col("offset") / BLOCK)).sortWithinPartitions("archive", "offset")
    schema = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payload

    def ranges(rows):
        held: list[tuple] = []
        for r in rows:
            if held and (r[0] != held[0][0] or r[1] > held[-1][1] + held[-1][2] + GAP or r[1] + r[2] - held[0][1] > MOST):
                yield held
                held = []
            held.append(r)
        if held:
            yield held

    def read(batches):
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        opened: dict = {}
        for held in ranges(rows):
            archive, start = held[0][0], held[0][1]
            if archive not in opened:
                for f in opened.values():
                    f.close()
                opened = {archive: _open(archive)}
            data = opened[archive].read_at(held[-1][1] + held[-1][2] - start, start)
            out = []
            for _, offset, length, url, digest, kind, ident, refers in held:
                record = data[offset - start : offset - start + length]
                http = record.find(END.encode()) + 4
                body = record.find(END.encode(), http) + 4
                size = int(_headers(record[http : body - 4])["content-length"])
                content = record[body:]
                found = hashlib.sha256(content).hexdigest() if kind == "response" else digest.removeprefix("sha256:")
                if kind == "response" and (f"sha256:{found}" != digest or len(content) != size):
                    raise ValueError(f"{archive}: the record at {offset} doesn't match its digest")
                out.append((ident, url, kind, refers, size, found, *([content] if payload else [])))
            cols = list(zip(*out, strict=True))
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

    return blocks.select("archive", "offset", "length", "url", "digest", "record_type", "record_id", "refers_to").mapInArrow(read, schema)


def page_of(c):
    return F.regexp_extract(c, r"(-?[0-9]+)>$", 1).try_cast("long")


def archive_pages(pages: DataFrame, base: str) -> DataFrame:
    """Write ``pages`` as archives below ``base`` and return their stored index."""
    write_archives(plan_records(pages, base), f"{base}/archives")
    return materialise(index_archives(pages.sparkSession, f"{base}/archives"), base, "index")


def op2(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` through archives and back."""
    index = archive_pages(table(spark, sf_dir, "pages"), shared_dir(spark))
    out = read_records(index, payload=False)
    return out.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""
