"""ARC to WARC: version-specific ARC headers and declared lengths in, equivalent WARC records out.

Archives are tables of segments: (name, data), data being a whole archive of a few MB whose records are gzip members, so
that writing and reading them is spread over executors and works on any store that Spark writes. ``write_files`` and
``read_files`` exchange them with plain files in a folder that all executors share.

ARC version 1 has URL, IP, date, type and length in a record's line, version 2 also result code, checksum, location,
offset and file name; the version block's second line says which. Synthesised for WARC: the record id (a UUID of the
record's place in its archive and its content), the date in ISO form, the type (response, revisit, or resource where there is
no HTTP head, which then has the ARC's media type), SHA-256 digests, the IP address where one is known, and what a revisit
refers to: record, URI and date.

Edge cases: null payloads are empty; null URLs are ``-``; line feeds in URLs are percent-encoded; rows with a null id
are responses and take no part in finding equal payloads; rows with equal id and payload are each a response or each a
revisit of the smaller id's first record, and each has a record id of its own.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, drop_staged, sliced, staged

#: Bytes of records after which a segment is closed; payloads from this size on are compared; places that equal payloads
#: are dealt out to when they are joined.
SEGMENT, LEAST, DEALT = 2 << 20, 100, 16
#: Bytes of pages for a bucket of segments, about, and the most buckets.
BUCKET, MOST_BUCKETS = 256 << 20, 100_000
DATE, NO_IP = "20260101000000", "0.0.0.0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive; an archive that isn't compressed is one member."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        data = d.unused_data


def clean_url(url: str | None) -> str:
    return (url or "-").replace("\r", "%0D").replace("\n", "%0A")


# --- ARC


def arc_version_block(name: str, version: int = 1) -> bytes:
    fields = "URL IP-address Archive-date Content-type " + ("Archive-length" if version == 1 else "Result-code Checksum Location Offset Filename Archive-length")
    body = f"{version} 0 -\n{fields}\n".encode()
    middle = f"{len(body)}" if version == 1 else f"200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} {NO_IP} {DATE} text/plain {middle}\n".encode() + body + b"\n"


def arc_record(url: str, content: bytes, version: int = 1, date: str = DATE, ip: str = NO_IP, kind: str = "text/html", code: int = 200, name: str = "-", offset: int = 0) -> bytes:
    middle = f"{len(content)}" if version == 1 else f"{code} {hashlib.md5(content).hexdigest()} - {offset} {name} {len(content)}"
    return f"{url} {ip} {date} {kind} {middle}\n".encode() + content + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC archive after its version block: url, ip, date, kind, code, content."""
    version = None
    for member in members(data):
        at = 0
        while at < len(member):
            if member[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = member.index(b"\n", at)
            line = member[at:end].decode("utf-8", "replace").rstrip("\r")
            first = version is None
            # a URL may hold spaces, so fields are counted from the right
            fields = line.rsplit(" ", 9 if version == 2 or first and not _is_v1(line) else 4)
            size = int(fields[-1])
            content = member[end + 1 : end + 1 + size]
            if len(content) < size:
                raise ValueError(f"ARC record of {size} declared bytes ends after {len(content)}")
            at = end + 1 + size
            if first:
                version = int(content.split(b" ", 1)[0])
                if version not in (1, 2):
                    raise ValueError(f"ARC version {version}")
                continue
            yield {"url": fields[0], "ip": fields[1], "date": fields[2], "kind": fields[3], "code": int(fields[4]) if version == 2 and fields[4].isdigit() else None, "content": content}


def _is_v1(line: str) -> bool:
    return line.startswith("filedesc://") and line.count(" ") < 9


def http_split(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers by lower-case name, the header block with its blank line, and the payload."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or end < 0:
        return {}, b"", content
    head = content[: end + 4]
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if ":" in line:
            k, v = line.split(":", 1)
            found[k.strip().lower()] = v.strip()
    return found, head, content[end + 4 :]


def id_header(key) -> str:
    return "" if key is None else f"X-Page-Id: {quote(str(key), safe='')}\r\n"


def id_of(headers: dict[str, str]) -> str | None:
    found = headers.get("x-page-id")
    return None if found is None else unquote(found)


def arc_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int | None = None) -> DataFrame:
    """Pages as ARC segments (name, data, part, seq): seq counts the segments of a part of the pages, and odd ones are of
    version 2 where none is asked for. The id travels as an HTTP header, as crawlers' own fields do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def name_of() -> str:
            return f"part-{part:06d}-{n:06d}.arc.gz"

        def close() -> pa.RecordBatch:
            data = gz(arc_version_block(name_of(), version or 1 + n % 2)) + b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([name_of()]), pa.array([data], pa.binary()), pa.array([part], pa.int32()), pa.array([n], pa.int32())], ["name", "data", "part", "seq"])

        for batch in sliced(batches, 500):
            for key, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (text or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{id_header(key)}\r\n".encode()
                held.append(gz(arc_record(clean_url(url), head + payload, version or 1 + n % 2, name=name_of(), offset=size)))
                size += len(head) + len(payload)
                if size >= SEGMENT:
                    yield close()
                    n, held, size = n + 1, [], 0
        if held:
            yield close()

    return pages.select(col(id_col), col(url_col), col(payload_col)).mapInArrow(run, "name string, data binary, part int, seq int")


def placed(arcs: DataFrame) -> DataFrame:
    """Segments with part and seq, which together tell them apart; of segments without these the name does."""
    if {"part", "seq"} <= set(arcs.columns):
        return arcs.select("name", "data", "part", "seq")
    return arcs.select("name", "data", F.col("name").alias("part"), F.lit(0).alias("seq"))


def arc_records(arcs: DataFrame, id_type: str = "long") -> DataFrame:
    """(part, seq, at, page_id, payload_bytes, digest, url, date) of every ARC record; ``at`` counts a segment's records."""
    arcs = placed(arcs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            rows = []
            for at, r in enumerate(parse_arc(batch.column(3)[0].as_py())):
                headers, _, payload = http_split(r["content"])
                rows.append((at, id_of(headers), len(payload), hashlib.sha256(payload).hexdigest(), r["url"], r["date"]))
            c = list(zip(*rows, strict=True)) if rows else [()] * 6
            where = pa.array(np.zeros(len(rows), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(c[0], pa.int32()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), *(pa.array(x, pa.string()) for x in c[3:])], ["part", "seq", "at", "page_id", "payload_bytes", "digest", "url", "date"])

    kind = dict(arcs.dtypes)["part"]
    out = arcs.select("part", "seq", "name", "data").mapInArrow(run, f"part {kind}, seq int, at int, page_id string, payload_bytes long, digest string, url string, date string")
    return out.withColumn("page_id", F.col("page_id").cast(id_type))


# --- WARC


def iso(date: str) -> str:
    """An ARC's date of 14 digits in ISO form."""
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(kind: str, url: str, date: str, head: bytes, payload: bytes, digest: str, page_id=None, origin: str = "", ip: str = NO_IP, media: str = "-", refers: dict | None = None) -> bytes:
    """A response with HTTP head and payload, a resource without a head, or a revisit with the head alone.

    refers: what a revisit refers to, as page_id, origin, url and date; its payload is the same.
    """
    block = head + (b"" if kind == "revisit" else payload)
    content = "application/http; msgtype=response" if head else media if "/" in media else "application/octet-stream"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id(origin, page_id, url, digest)}>", f"WARC-Date: {iso(date)}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    if ip != NO_IP:
        lines.append(f"WARC-IP-Address: {ip}")
    if refers is not None:
        first = record_id(refers["origin"], refers["page_id"], refers["url"], digest)
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{first}>", f"WARC-Refers-To-Target-URI: {refers['url']}", f"WARC-Refers-To-Date: {iso(refers['date'])}", f"X-Refers-To-Page-Id: {quote(str(refers['page_id']), safe='')}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(origin: str, page_id, url: str, digest: str) -> uuid.UUID:
    """origin: the record's place, which tells equal records apart."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{origin}\n{page_id}\n{url}\n{digest}")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record."""
    for member in members(data):
        at = 0
        while at < len(member):
            if member[at : at + 2] == b"\r\n":
                at += 2
                continue
            if not member.startswith(b"WARC/", at):
                raise ValueError("not a WARC record")
            end = member.index(b"\r\n\r\n", at)
            headers = {}
            for line in member[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                k, v = line.split(":", 1)
                headers[k.strip().lower()] = v.strip()
            size = int(headers["content-length"])
            block = member[end + 4 : end + 4 + size]
            if len(block) < size:
                raise ValueError("WARC record ends early")
            at = end + 4 + size
            yield headers, block


def revisits(records: DataFrame) -> DataFrame:
    """(part, seq, again): the records of each segment whose payload a smaller id has, as (at, page_id, origin, url, date),
    the last four being the first record's of the smallest id.

    Equal payloads may be a large part of all rows: their ids are dealt out to DEALT places, and the smallest id to those
    of the places that hold any.
    """
    ids = records.where((F.col("payload_bytes") >= LEAST) & F.col("page_id").isNotNull()).withColumn("place", F.pmod(F.xxhash64("page_id"), F.lit(DEALT)).cast("int"))
    held = ids.groupBy("digest", "place").agg(F.min(F.struct("page_id", "part", "seq", "at", "url", "date")).alias("low"), F.max("page_id").alias("top"))
    firsts = held.groupBy("digest").agg(F.min("low").alias("first"), F.max("top").alias("top"), F.collect_set("place").alias("places")).where("top > first.page_id")
    firsts = firsts.select("digest", "first", F.explode("places").alias("place"))
    again = ids.join(firsts, ["digest", "place"]).where("page_id > first.page_id")
    origin = F.concat_ws("/", "first.part", "first.seq", "first.at")
    told = F.struct("at", F.col("first.page_id").cast("string").alias("page_id"), origin.alias("origin"), "first.url", "first.date")
    return again.groupBy("part", "seq").agg(F.collect_list(told).alias("again"))


def convert(arcs: DataFrame, id_type: str = "long") -> DataFrame:
    """ARC segments to WARC segments (name, data).

    Payloads stay where they are: what is shuffled are ids and digests, and the list of each segment's revisits comes to
    the segment. Segments that are bucketed by ``part`` aren't shuffled either.
    """
    arcs = placed(arcs)
    again = revisits(arc_records(arcs, id_type)).withColumnsRenamed({"part": "of_part", "seq": "of_seq"})
    # not an equality of two columns: the join must go by part alone, as the buckets do
    same = (F.col("part") == F.col("of_part")) & (F.col("seq").bitwiseXOR(F.col("of_seq")) == 0)
    joined = arcs.join(again.hint("shuffle_hash"), same, "left").select("data", "again", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:06d}.warc.gz"
            info = b"software: ARC converter\r\nformat: WARC File Format 1.1\r\n"
            top = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            data = gz(top.encode() + info + b"\r\n\r\n") + b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["name", "data"])

        for batch in sliced(batches, 1):
            again = {r["at"]: r for r in batch.column(1)[0].as_py() or ()}
            segment = f"{batch.column(2)[0].as_py()}/{batch.column(3)[0].as_py()}"
            for at, r in enumerate(parse_arc(batch.column(0)[0].as_py())):
                headers, head, payload = http_split(r["content"])
                kind = "revisit" if at in again else "response" if head else "resource"
                digest = hashlib.sha256(payload).hexdigest()
                record = gz(warc_record(kind, r["url"], r["date"], head, payload, digest, id_of(headers), f"{segment}/{at}", r["ip"], r["kind"], again.get(at)))
                held.append(record)
                size += len(record)
                if size >= SEGMENT:
                    yield close()
                    n, held, size = n + 1, [], 0
        if held:
            yield close()

    return joined.mapInArrow(run, "name string, data binary")


def warc_records(warcs: DataFrame, id_type: str = "long") -> DataFrame:
    """What the archives say of each page; a response's digest is that of the payload read, and must equal the stated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for data in batch.column(0).to_pylist():
                rows = []
                for headers, block in parse_warc(data):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    http, _, payload = ({}, b"", block) if kind == "resource" else http_split(block)
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    size = len(payload)
                    if kind == "revisit":
                        size = int(http["content-length"])
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} has another digest")
                    refers = headers.get("x-refers-to-page-id")
                    rows.append((id_of(http), size, digest, kind, None if refers is None else unquote(refers), headers["warc-record-id"]))
                c = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i == 1 else pa.string()) for i, x in enumerate(c)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])

    out = warcs.select("data").mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string")
    return out.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def write_files(segments: DataFrame, folder: str) -> None:
    """Segments as files in a folder that all executors share; each is renamed into place when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = os.path.join(folder, name)
                part = f"{whole}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, whole)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    os.makedirs(folder, exist_ok=True)
    segments.select("name", "data").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files as segments."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))


def archive_query(pages: DataFrame) -> DataFrame:
    """Pages to ARC archives, these to WARC archives, and these read back; both archives are in the shared folder."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    stated = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = 0 if stated >> 60 else stated  # Spark takes what it doesn't know for endless
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), known // BUCKET))
    arcs = staged(arc_table(pages), "arc", "none", 500, (buckets, "part"))
    warcs = staged(convert(arcs, kind), "warc", "none", 1)
    drop_staged(arcs)
    return warc_records(warcs, kind).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


#: DuckDB SQL for the contract's columns.
ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
