"""WARC records in ZIP packages, read by range.

A package is a ZIP file whose members are stored, not compressed: WARC files in
archive/ and an index of their records in indexes/. Within a WARC file every record
is a gzip member of its own, so that a range of it can be read alone; plain files are
read as well. The reader fetches the end of
a package, parses the end-of-directory records (ZIP64 included) and the central
directory, reads the index member, and then fetches ranges of whole records; no
member is extracted. Packages without an index are scanned record by record.

Null html is an empty payload, null url an empty one. Of records with equal
payloads those with the largest page_id (rows that repeat it included) are
responses, the others revisit it and carry no payload. Null ids come before all
numbers. Extra columns are ignored; an empty table writes and returns nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import runtime as R

MEMBER_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
#: Repeated payloads that are broadcast at most: about 10 MB.
FEW = 250_000
DATE = "2024-01-01T00:00:00Z"


# --- records ---------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def _key(url: str) -> str:
    """The URL in an index line: no blanks, braces, control signs or non-ASCII."""
    return "".join(c if "!" <= c <= "~" and c not in "{}" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url: str, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """A response or revisit record; both name the whole payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = http if revisit else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines[1:]) if k}


def parse_record(data: bytes, at: int = 0) -> tuple[dict, dict, bytes, int]:
    """(WARC headers, HTTP headers, payload, end) of the record at an offset."""
    if data[at : at + 5] != b"WARC/":
        raise ValueError("no WARC record here")
    cut = data.index(b"\r\n\r\n", at)
    head = _headers(data[at:cut])
    start, n = cut + 4, int(head["content-length"])
    body = data[start : start + n]
    if len(body) < n:
        raise ValueError("record is cut short")
    end = start + n + 4
    k = body.find(b"\r\n\r\n") if body.startswith(b"HTTP/") else -1
    return (head, _headers(body[:k]), body[k + 4 :], end) if k >= 0 else (head, {}, body, end)


def _page(uri: str | None):
    tail = (uri or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


# --- ZIP directories -------------------------------------------------------


def members(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name: (offset of the local header, stored bytes, plain bytes, method).

    read(offset, n) fetches bytes of the package.
    """
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(b"PK\5\6")
    if k < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, k + 10)
    end = tail_at + k
    if (count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and end >= 20:
        locator = read(end - 20, 20)
        if locator[:4] == b"PK\6\7":
            at64 = struct.unpack_from("<Q", locator, 8)[0]
            e64 = read(at64, 56)
            if e64[:4] != b"PK\6\6":
                raise ValueError("ZIP64 end record is missing")
            count, length, offset = struct.unpack_from("<QQQ", e64, 32)
    directory, at, out = read(offset, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("central directory is broken")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # only fields that are all ones in the entry are present
                body, p = extra[4 : 4 + n], 0
                if plain == 0xFFFFFFFF:
                    plain, p = struct.unpack_from("<Q", body, p)[0], p + 8
                if packed == 0xFFFFFFFF:
                    packed, p = struct.unpack_from("<Q", body, p)[0], p + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", body, p)[0]
            extra = extra[4 + n :]
        out[name] = (local, packed, plain, method)
        at += 46 + n_name + n_extra + n_note
    return out


def data_offset(read, local: int) -> int:
    head = read(local, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header")
    return local + 30 + sum(struct.unpack_from("<HH", head, 26))


class _Package(zipfile.ZipFile):
    """Stored members, written one after the other to a stream."""

    def store(self, name: str, data: bytes):
        info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
        info.compress_type = zipfile.ZIP_STORED
        with self.open(info, "w", force_zip64=True) as f:
            f.write(data)


def write_package(path: str, records) -> int:
    """records: (key, bytes). Members are closed at MEMBER_BYTES, so that memory
    holds one member and the index lines."""
    fs, target = R.local_fs(path)
    fs.create_dir(os.path.dirname(target), recursive=True)
    n, index = 0, []
    with fs.open_output_stream(target) as out, _Package(out, "w") as z:
        buf, size, member = [], 0, 0

        def close():
            nonlocal buf, size, member
            if buf:
                z.store(f"archive/data-{member:05d}.warc.gz", b"".join(buf))
                buf, size, member = [], 0, member + 1

        for key, data in records:
            data = gzip.compress(data, 6, mtime=0)
            index.append(f"{key} {json.dumps({'filename': f'data-{member:05d}.warc.gz', 'offset': size, 'length': len(data)})}\n")
            buf.append(data)
            size += len(data)
            n += 1
            if size >= MEMBER_BYTES:
                close()
        close()
        z.store("indexes/index.cdxj", "".join(index).encode())
        z.store("datapackage.json", json.dumps({"profile": "data-package", "records": n}).encode())
    return n


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one package per partition; returns path and n_records. A package is named
    by its attempt, so that a task that runs twice leaves two whole files, of which the
    returned list holds one.

    Only digests are moved to find equal payloads, counted before they move. What is found,
    one row per payload that occurs twice or more, is sent to the pages if it is of a
    checked size, so that html stays where it is; a larger table meets them in a
    shuffle, whose large partitions Spark splits."""
    R.prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = R.spread(rows).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    again = rows.groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    again = R.stored(again.select("sha", "first_id", F.lit(True).alias("again")), "repeated-payloads")
    rows = rows.join(F.broadcast(again) if again.count() <= FEW else again, "sha", "left")
    rows = rows.select("page_id", "url", "html", F.when(F.col("again"), F.col("first_id")).otherwise(F.col("page_id")).alias("first_id"))

    def run(batches):
        name = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.wacz"

        def records():
            for b in batches:
                for page, url, html, first in zip(*(c.to_pylist() for c in b.columns)):
                    payload = html.encode()
                    yield _key(url) or "-", record(page, url, payload, digest_of(payload), first, page != first)

        it = records()
        head = next(it, None)
        if head is None:
            return
        n = write_package(name, chain([head], it))
        yield pa.RecordBatch.from_pydict({"path": [name], "n_records": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "path string, n_records long")


def _open(path: str):
    fs, p = R.local_fs(path)
    f = fs.open_input_file(p)
    return f, (lambda at, n: f.read_at(n, at))


def _gzip_length(read, at: int, end: int) -> int:
    """Bytes of the gzip member at an offset."""
    d, n = zlib.decompressobj(31), 0
    while not d.eof:
        piece = read(at + n, min(1 << 16, end - at - n))
        if not piece:
            raise ValueError("gzip member is cut short")
        d.decompress(piece)
        n += len(piece)
    return n - len(d.unused_data)


def _entry(line: str) -> dict:
    """The JSON that ends an index line, whatever its key holds."""
    at = line.find("{")
    while at >= 0:
        try:
            return json.loads(line[at:])
        except ValueError:
            at = line.find("{", at + 1)
    raise ValueError(f"no JSON in index line {line!r}")


def record_ranges(packages: DataFrame) -> DataFrame:
    """path, start, offsets: runs of neighbouring records of a package, from its
    index or, without one, from a walk over the record headers."""

    def located(path):
        f, read = _open(path)
        found = members(read, f.size())
        warcs = {k: v for k, v in found.items() if k.startswith("archive/") and v[3] == 0 and k.endswith((".warc", ".warc.gz"))}
        begins = {k: data_offset(read, v[0]) for k, v in warcs.items()}
        index = [k for k in found if k.startswith("indexes/") and found[k][3] == 0]
        places = []
        for k in index:
            text = read(data_offset(read, found[k][0]), found[k][2]).decode()
            for line in filter(str.strip, text.split("\n")):
                entry = _entry(line)
                places.append((begins[f"archive/{entry['filename']}"] + int(entry["offset"]), int(entry["length"])))
        if not index:
            for k, (_, _, plain, _) in warcs.items():
                at, end = begins[k], begins[k] + plain
                while at < end and k.endswith(".gz"):
                    n = _gzip_length(read, at, end)
                    places.append((at, n))
                    at += n
                while at < end:
                    head = read(at, min(65536, end - at))
                    cut = head.index(b"\r\n\r\n")
                    n = cut + 4 + int(_headers(head[:cut])["content-length"]) + 4
                    places.append((at, n))
                    at += n
        f.close()
        return sorted(places)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                group, size = [], 0
                for at, n in [*located(path), (None, 0)]:
                    if group and (at is None or size + n > RANGE_BYTES or at != group[-1][0] + group[-1][1]):
                        yield pa.RecordBatch.from_pydict({"path": [path], "start": pa.array([group[0][0]], pa.int64()), "lengths": pa.array([[x for _, x in group]], pa.list_(pa.int64()))})
                        group, size = [], 0
                    if at is not None:
                        group.append((at, n))
                        size += n

    return packages.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


def read_packages(packages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    spark = packages.sparkSession
    R.prepare(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = record_ranges(packages.repartition(n)).repartition(n)

    def run(batches):
        for b in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in b.columns)):
                f, read = _open(path)
                data, at, rows = read(start, sum(lengths)), 0, []
                f.close()
                for n in lengths:
                    one = data[at : at + n]
                    head, http, payload, _ = parse_record(zlib.decompress(one, 31) if one[:2] == b"\x1f\x8b" else one)
                    at += n
                    kind = head["warc-type"]
                    digest = head["warc-payload-digest"].partition(":")[2]
                    if kind == "response":
                        if digest_of(payload) != digest:
                            raise ValueError(f"{path}: payload differs from its digest")
                        rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], len(payload), digest, kind, None, payload))
                    else:
                        rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], int(http["content-length"]), digest, kind, _page(head["warc-refers-to"]), None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return ranges.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = R.shared_dir(spark, "warc")
    packages = R.stored(write_packages(R.table(spark, sf_dir, "pages"), folder), "warc-list")
    return read_packages(packages).drop("payload", "url")


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS first_id,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(concat('0x', substr(h, CAST(10 * (i // 8) + 1 AS BIGINT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM d
"""
