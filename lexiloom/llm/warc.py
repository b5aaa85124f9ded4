"""WARC archives: written from page rows, and read back with segments reassembled.

Writing: a page becomes a response record (an HTTP message in chunked framing), or, if an equal payload
of at least ``minimum`` bytes has a smaller page_id, a revisit record that refers to the response. A block
longer than ``segment_bytes`` is cut into a first record and continuation records. Spark's own text writer
commits the files, with the record terminator as line separator, so any file system that Spark reaches
will do and a lost executor's files are written anew; the cuts keep characters whole for that.

Reading: archives are parsed record by record in the tasks that hold them. Unsegmented records are decoded
at once and cross no shuffle. Segments are grouped by their origin's identifier, ordered by segment
number, checked for gaps and against the total length, joined, and then the chunked framing is decoded.

Defined results: null html is an empty payload; a null url gives no target URI; a null page_id is last
among equal payloads, and refers_to is null if no page of a group has an id. Rows with one page_id and one
payload are copies of a record, each returned: all responses or all revisits. Records whose segments have
gaps or the wrong total length, or whose framing is broken, have a null payload. Very long pages are
written in as many segments as they need; an empty table gives an empty folder and no rows. Other columns
of the pages are not archived.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import cut, shared_path, table

NAME = "op7_warc"
SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_ARCHIVE = 32_768, 8_192, 4_000
#: A table of (page_id, digest, first page) is sent to all executors only up to so many rows (under 10 MB).
BROADCAST_REVISITS = 50_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits in eight groups of 20 bits, four letters each."""
    digits = F.sha1(payload)
    groups = [F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*(F.substring(F.lit(LETTERS), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)))


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most size bytes (4 at least), none of which ends inside a character."""
    begin = 0
    while begin < len(data):
        end = min(begin + size, len(data))
        while end < len(data) and end > begin + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[begin:end]
        begin = end


def chunked(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in _cuts(payload, size)) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes | None:
    """What stands in the chunks; None if the framing is broken or cut off."""
    parts, at = [], 0
    while (line := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        part = data[line + 2 : line + 2 + size]
        if len(part) < size or data[line + 2 + size : line + 4 + size] != b"\r\n":
            return None
        parts.append(part)
        at = line + 4 + size
    return None


def payload_of(block: bytes) -> bytes | None:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _record(fields: dict[str, str | None], block: bytes) -> bytes:
    told = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{told}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records_of(page_id, url, html, digest, refers_to, revisit, segment_bytes=SEGMENT_BYTES, chunk_bytes=CHUNK_BYTES) -> Iterator[bytes]:
    """All records of a page, without the terminator."""
    name = "null" if page_id is None else page_id
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    base = {"WARC-Record-ID": f"<urn:page:{name}:{digest}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}"}
    kind = {"Content-Type": "application/http; msgtype=response"}
    if revisit:
        yield _record({"WARC-Type": "revisit"} | base | kind | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{'null' if refers_to is None else refers_to}:{digest}>"}, HTTP)
        return
    block = HTTP + chunked((html or "").encode(), chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record({"WARC-Type": "response"} | base | kind, block)
        return
    parts = list(_cuts(block, segment_bytes))
    for number, part in enumerate(parts, 1):
        if number == 1:
            yield _record({"WARC-Type": "response"} | base | kind | {"WARC-Segment-Number": "1"}, part)
        else:
            more = {"WARC-Record-ID": base["WARC-Record-ID"][:-1] + f":{number}>", "WARC-Segment-Origin-ID": base["WARC-Record-ID"], "WARC-Segment-Number": str(number)}
            last = {"WARC-Segment-Total-Length": str(len(block))} if number == len(parts) else {}
            yield _record({"WARC-Type": "continuation"} | base | more | last, part)


def marked(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """page_id, url, html, digest, first (the response's page_id), revisit."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    slim = cut(rows.where(F.octet_length("html") >= minimum).select("page_id", "digest"))
    first = slim.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    revisits = slim.join(first, F.col("digest") == F.col("d")).where("page_id IS NULL OR page_id > first")
    revisits = cut(revisits.select(F.col("page_id").alias("p"), "d", "first").distinct())
    if revisits.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    found = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return found.select("page_id", "url", "html", "digest", "first", F.col("d").isNotNull().alias("revisit"))


def write_warc(pages: DataFrame, path: str, minimum: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_archive: int = RECORDS_PER_ARCHIVE, compression: str = "none") -> None:
    """Archives of pages (page_id, url, html) in the folder path; compression: none or gzip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                rows = zip(*(x.to_pylist() for x in batch.slice(begin, 200).columns), strict=True)
                found = [r.decode() for row in rows for r in records_of(*row, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    records = marked(pages, minimum).mapInArrow(run, "value string")
    records.write.option("lineSep", END).option("maxRecordsPerFile", records_per_archive).option("compression", compression).text(path)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive, gzipped or not."""
    data = archive
    if data[:2] == b"\x1f\x8b":
        members = []
        while data:
            unpack = zlib.decompressobj(31)
            members.append(unpack.decompress(data) + unpack.flush())
            data = unpack.unused_data
        data = b"".join(members)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", errors="replace").split("\r\n") if end >= 0 else [""]
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _told(fields: dict[str, str]) -> list:
    uri = lambda x: x.strip("<>") if x else None
    digest = fields.get("warc-payload-digest")
    return [uri(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), uri(fields.get("warc-refers-to"))]


NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: record_id, record_type, target_uri, payload_digest (as told), refers_to, payload."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["content"]:
                found = []
                for fields, block in parsed(archive):
                    if "warc-segment-number" not in fields:
                        found.append([*_told(fields), None if fields.get("warc-type") == "revisit" else payload_of(block)])
                    if len(found) == 500:
                        yield pd.DataFrame(found, columns=[*NAMES, "payload"])
                        found = []
                yield pd.DataFrame(found, columns=[*NAMES, "payload"])

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["content"]:
                found = []
                for fields, block in parsed(archive):
                    if "warc-segment-number" in fields:
                        total = fields.get("warc-segment-total-length")
                        origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
                        found.append([*_told(fields), origin, int(fields["warc-segment-number"]), int(total) if total else None, block])
                yield pd.DataFrame(found, columns=[*NAMES, "origin", "number", "total", "block"]).astype({"total": "Int64"})

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for origin, parts in zip(frame["origin"], frame["parts"], strict=True):
                numbers = [x["number"] for x in parts]
                copies = max(1, numbers.count(1))
                parts = parts[::copies]
                block = b"".join(x["block"] for x in parts)
                good = numbers == sorted([*range(1, len(parts) + 1)] * copies) and parts[-1]["total"] == len(block)
                head = next((x for x in parts if x["number"] == 1), parts[0])
                told = [head[x] for x in NAMES]
                found += [[origin.strip("<>"), *told[1:], payload_of(block) if good else None]] * copies
            yield pd.DataFrame(found, columns=[*NAMES, "payload"])

    apart = archives.mapInPandas(segments, f"{FIELDS}, origin string, number int, total long, block binary")
    fields = F.struct("number", "total", *NAMES, "block")
    grouped = apart.groupBy("origin").agg(F.sort_array(F.collect_list(fields)).alias("parts"))
    return archives.mapInPandas(whole, f"{FIELDS}, payload binary").unionByName(grouped.mapInPandas(joined, f"{FIELDS}, payload binary"))


def listed(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's size is its response's."""
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    slim = cut(records.select("record_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest")))
    sizes = slim.where("record_type = 'response'").groupBy(F.col("record_id").alias("r")).agg(F.max("bytes").alias("size"))
    revisits = slim.where("record_type = 'revisit'").join(sizes, F.col("refers_to") == F.col("r"), "left")
    responses = slim.where("record_type = 'response'")
    return responses.select(
        number(F.col("record_id")).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(revisits.select(
        number(F.col("record_id")).alias("page_id"), F.col("size").alias("payload_bytes"), "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to")
    ))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return listed(read_warc(spark, path))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, x, min(page_id) OVER (PARTITION BY x) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, (5 * i + 1)::INT, 5))::BIGINT) AS v FROM g)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM b
"""
