"""WARC archives: writing with segmentation and revisits, and reading back with segment reassembly.

Writer: each page becomes an HTTP response with chunked transfer framing, in one gzip member per record. A block longer
than ``segment_bytes`` is split: the first segment keeps the record's own id, continuation records name it in
``WARC-Segment-Origin-ID`` and carry their number, the last one the total length. Among equal payloads of at least
``min_bytes`` the largest page_id is the response, the others are revisits that refer to it. A record's id follows from
its page_id and payload, so ``WARC-Refers-To`` names a record that exists; the page_id itself is a field of its own.
Archives appear under their final name only when complete, and only names that a finished task reported are read, so
lost or repeated attempts leave nothing behind that counts.

Reader: whole records are decoded where they are read; segments are grouped by origin identifier, ordered by number,
checked for gaps and against the total length, and then the chunked framing is removed. A damaged record raises
``ValueError``. Archives of other writers are read too: their records have no page_id, and a revisit whose record lies
elsewhere has no length.

Defined cases: a null html or url is empty; empty payloads count as equal payloads of 0 bytes; of rows with one payload
and one page_id that is the largest, all are responses (a repeated row is the same record once more); a null page_id is
never the largest, is returned as null, and is a response where no row of its payload has an id; an empty table gives no
archive and an empty result; other columns aren't archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.session import materialise, shared_path, spread

PARTS = "record_id string, page_id long, record_type string, refers_to_id string, origin string, seg int, total long, payload_digest string, payload_bytes long, block binary"
PAGE_FIELD = "X-Page-ID"


def _fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def encode_chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(body), size) for c in (body[i : i + size],)]
    return b"".join([*parts, b"0\r\n\r\n"])


def decode_chunked(data: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked framing: no size line")
        n = int(data[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if at + n + 2 > len(data) or data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunked framing: a chunk is cut off")
        out.append(data[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP block without an end of headers")
    return decode_chunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """One block from ``(number, total length or None, bytes)`` in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError(f"segments {[s[0] for s in segments]} have gaps")
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] != len(block):
        raise ValueError(f"segments of {len(block)} bytes; the total length is {segments[-1][1]}")
    return block


def _record(kind: str, rid: str, extra: list[str], block: bytes) -> bytes:
    clean = [x.replace("\r", " ").replace("\n", " ") for x in extra]
    head = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", "WARC-Date: 2024-01-01T00:00:00Z", *clean, f"Content-Length: {len(block)}"])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def record_id(page_id: int | None, digest: str) -> str:
    """The id of the record of a page with a payload of that digest."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page {page_id} {digest}").urn


def page_records(page_id: int | None, url: str, payload: bytes, response_id: int | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The gzip members of one page."""
    sha = sha1_base32(payload)
    rid = record_id(page_id, sha)
    fields = [f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha}", *([f"{PAGE_FIELD}: {page_id}"] if page_id is not None else [])]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if response_id != page_id:
        yield _record("revisit", rid, [*fields, f"WARC-Refers-To: <{record_id(response_id, sha)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"], http)
        return
    block = http + encode_chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record("response", rid, fields, block)
        return
    cuts = range(0, len(block), segment_bytes)
    for n, at in enumerate(cuts, 1):
        piece = block[at : at + segment_bytes]
        total = [f"WARC-Segment-Total-Length: {len(block)}"] if n == len(cuts) else []
        if n == 1:
            yield _record("response", rid, [*fields, "WARC-Segment-Number: 1"], piece)
        else:
            yield _record("continuation", uuid.uuid5(uuid.NAMESPACE_URL, f"{rid} {n}").urn, [fields[0], f"WARC-Segment-Origin-ID: <{rid}>", f"WARC-Segment-Number: {n}", *total], piece)


def choose_responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, response_id``. Payloads are counted by digest first; only repeated ones meet in a join.

    Payloads that hold over a 512th of all rows, of which there are fewer than 512, come by broadcast, so no hot
    payload gathers in one task.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("_sha"))
    counted = base.where(F.octet_length("html") >= min_bytes).groupBy("_sha").agg(F.max("page_id").alias("_max"), F.count(F.lit(1)).alias("_n"))
    counted = materialise(counted.where("_n > 1"), "warc-digests")
    rows = pages.count()
    hot = counted.where(F.col("_n") * 512 > rows).select("_sha", F.col("_max").alias("_hot"))
    cold = counted.where(F.col("_n") * 512 <= rows).select(F.col("_sha").alias("_key"), F.col("_max").alias("_cold"))
    joined = base.join(F.broadcast(hot), "_sha", "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_sha")).otherwise(F.concat(F.lit("hot"), F.coalesce(F.col("page_id"), F.lit(0)))))
    small = F.octet_length("html") < min_bytes
    return joined.join(cold, "_key", "left").select("page_id", "url", "html", F.when(small, F.col("page_id")).otherwise(F.coalesce("_hot", "_cold", "page_id")).alias("response_id"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, archive_bytes: int = 64 << 20, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` under ``path``; returns the finished archives: ``path, records, bytes``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        out, name, size, count, seq, done = None, "", 0, 0, 0, []

        def close() -> None:
            nonlocal out
            out.close()
            fs.move(f"{root}/_{name}", f"{root}/{name}")
            done.append((f"{path}/{name}", count, size))
            out = None

        for b in batches:
            for page_id, url, html, response in zip(*(b.column(i).to_pylist() for i in range(4))):
                for member in page_records(page_id, url, html.encode(), response, segment_bytes, chunk_bytes):
                    if out is None:
                        name, size, count = f"part-{part:05d}-{attempt}-{seq:04d}.warc.gz", 0, 0
                        seq += 1
                        out = fs.open_output_stream(f"{root}/_{name}", compression=None)
                    out.write(member)
                    size, count = size + len(member), count + 1
                    if size >= archive_bytes:
                        close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    return materialise(choose_responses(pages, min_bytes).mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def records_of(uri: str, read_bytes: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each gzip member of an archive, streamed."""
    fs, path = _fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        z, held = zlib.decompressobj(31), []
        data = f.read(read_bytes)
        while data:
            held.append(z.decompress(data))
            if not z.eof:
                data = f.read(read_bytes)
                continue
            head, _, rest = b"".join(held).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(headers["content-length"])
            if not lines[0].startswith("WARC/") or len(rest) != n + 4:
                raise ValueError(f"{uri}: a record of {len(rest)} bytes says {n}")
            yield headers, rest[:n]
            data, z, held = z.unused_data or f.read(read_bytes), zlib.decompressobj(31), []
        if any(held):
            raise ValueError(f"{uri}: the last record is cut off")


def reassemble_all(segments: list[tuple[int, int | None, bytes]]) -> list[bytes]:
    """The blocks of an origin whose record was written more than once: every copy has each of its segments."""
    segments = sorted(segments, key=lambda s: s[0])
    copies = sum(s[0] == 1 for s in segments) or 1
    return [reassemble(segments[c::copies]) for c in range(copies)]


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, record_id`` of every record in ``archives.path``."""
    spark = archives.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in PARTS.split(", ")]
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split(" ")[1]]) for n, x in zip(names, PARTS.split(", "))])
        rows, size = [], 0
        for b in batches:
            for uri in b.column(0).to_pylist():
                for h, block in records_of(uri):
                    kind, rid, seg, page = h["warc-type"], h["warc-record-id"], h.get("warc-segment-number"), h.get(PAGE_FIELD.lower())
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    page = int(page) if page else None
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "revisit":
                        rows.append((rid, page, kind, h.get("warc-refers-to"), None, None, None, digest, None, None))
                    elif seg is None:
                        body = payload_of(block)
                        if digest is not None and sha1_base32(body) != digest:
                            raise ValueError(f"{uri}: payload digest of {rid}")
                        rows.append((rid, page, kind, None, None, None, None, digest or sha1_base32(body), len(body), None))
                    else:
                        total = h.get("warc-segment-total-length")
                        rows.append((rid, page, kind, None, h.get("warc-segment-origin-id", rid), int(seg), int(total) if total else None, digest, None, block))
                        size += len(block)
                    if len(rows) >= 8192 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    n = max(1, archives.count())  # one task per archive: rows here are file names
    parts = materialise(archives.select("path").repartitionByRange(n, "path").mapInArrow(read, PARTS), "warc-records")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for origin, page_id, digest, segments in zip(*(b.column(i).to_pylist() for i in range(4))):
                for block in reassemble_all([(s["seg"], s["total"], s["block"]) for s in segments]):
                    body = payload_of(block)
                    if digest is not None and sha1_base32(body) != digest:
                        raise ValueError(f"payload digest of {origin}")
                    out.append((origin, page_id, len(body), digest or sha1_base32(body)))
            if out:
                types = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["record_id", "page_id", "payload_bytes", "payload_digest"])

    whole = parts.where("seg is null and record_type = 'response'").select("record_id", "page_id", "payload_bytes", "payload_digest")
    grouped = parts.where("seg is not null").groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("payload_digest").alias("payload_digest"), F.collect_list(F.struct("seg", "total", "block")).alias("s"))
    joined = grouped.select("origin", "page_id", "payload_digest", "s").mapInArrow(join, "record_id string, page_id long, payload_bytes long, payload_digest string")
    responses = materialise(whole.unionByName(joined), "warc-responses")
    revisits = parts.where("record_type = 'revisit'").select("record_id", "page_id", "payload_digest", "refers_to_id")
    known = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    asked = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("_n")).join(known, "refers_to_id")
    total = revisits.count()
    hot = asked.where(F.col("_n") * 512 > total).select("refers_to_id", F.col("refers_to").alias("_hot_id"), F.col("payload_bytes").alias("_hot"))  # fewer than 512
    cold = asked.where(F.col("_n") * 512 <= total).select(F.col("refers_to_id").alias("_key"), F.col("refers_to").alias("_cold_id"), F.col("payload_bytes").alias("_cold"))
    sized = revisits.join(F.broadcast(hot), "refers_to_id", "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("refers_to_id")).otherwise(F.col("record_id"))).join(cold, "_key", "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "record_id").unionByName(
        sized.select("page_id", F.coalesce("_hot", "_cold").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), F.coalesce("_hot_id", "_cold_id").alias("refers_to"), "record_id")
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every page archived, then everything read back from the archives."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read_archives(write_archives(pages, shared_path(spark, "warc"))).drop("record_id")


#: SHA-1 comes as 40 hexadecimal digits; each base32 letter takes five bits out of two neighbouring digits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), x AS (SELECT page_id, h, sha1(h) AS s FROM p),
d AS (SELECT page_id, h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((
  (strpos('0123456789abcdef', substr(s, CAST((5 * i) // 4 + 1 AS INTEGER), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(s, CAST((5 * i) // 4 + 2 AS INTEGER), 1)) - 1)
  >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest FROM x),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, strlen(h) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""
