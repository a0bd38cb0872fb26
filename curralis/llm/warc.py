"""WARC archives: a writer with revisit records, and a splittable reader.

The writer's tasks put one gzip member per record into archives of the shared folder and return a manifest row per
closed archive; only archives in the manifest count, so a lost executor's half-written or repeated ones are never read.
The reader deals byte ranges of the archives to tasks. A task looks for the gzip magic in its range, takes a candidate
for a record only if it decodes to a WARC header, inflates to its end with a right checksum and is followed by another member or the
end of the file, and owns the records that start inside its range, reading past the range's end where the last needs it.

Defined cases: a null html is an empty payload; a null url is an empty target; rows that repeat a page_id and a payload
are written as they are, each as the response or revisit its page_id is; a page_id of null is never the response that
others refer to and always a response itself; records of any length are read whole, over as many blocks as they take; ties and equal
payloads refer to the smallest page_id; a member that is damaged raises ValueError, by its digest or by the manifest's count; an empty
table gives no archive and no record. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curralis.llm.common import shared_path, written

MAGIC = b"\x1f\x8b\x08"
#: Payloads under so many bytes are always stored in full.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_BLOCK = 1 << 20


def plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_digest and refers_to: the page whose equal payload is stored, or null.

    Digests are counted with map-side combination, so a payload that a third of all pages share is a row per task. The
    bodies are shuffled once, by page and digest, and the slim join by digest may be split by adaptive execution.
    """
    digests = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    slim = digests.filter(F.length("payload") >= least).select("page_id", "payload_digest")
    heads = slim.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = slim.join(heads, "payload_digest").filter("page_id <> refers_to").dropDuplicates(["page_id", "payload_digest"])
    return digests.join(revisits, ["page_id", "payload_digest"], "left")


def _member(page_id, url: str, payload: bytes, digest: str, refers_to, level: int) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme and authority that Spark would use for it, so that tasks open the same store as Spark does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified URI. Hadoop writes file:/x, and s3a where pyarrow says s3."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def write(planned: DataFrame, folder: str, level: int = 4, roll_bytes: int = 1 << 30) -> DataFrame:
    """Archives in folder, from rows of plan(); returns their manifest (path, bytes, records), itself kept in the shared folder.

    path is the whole URI of an archive, with its scheme.
    """
    base = _qualified(planned.sparkSession, folder).rstrip("/")

    def task(batches):
        store, root = _store(base)
        store.create_dir(root, recursive=True)
        out, made = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                member = _member(row["page_id"], row["url"] or "", row["payload"], row["payload_digest"], row["refers_to"], level)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll_bytes:
                    out.close()
                    made.append((f"{base}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{base}/{name}", size, n))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made) if made else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    manifest = planned.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(task, "path string, bytes long, records long")
    spark, at = planned.sparkSession, f"{folder}-manifest"
    manifest.write.parquet(at)
    return spark.read.schema(manifest.schema).parquet(at)


class _Window:
    """Bytes of an open file from a moving place on."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(_BLOCK)
        self.data += got
        return bool(got)

    def to(self, at: int) -> None:
        """Moves forward to a place inside or just past the data."""
        self.data, self.at = self.data[at - self.at :], at


def _header(data: bytes) -> dict[str, str] | None:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d\.\d", lines[0]):
        return None
    pairs = [x.partition(":") for x in lines[1:]]
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep} if all(p[1] for p in pairs) else None


def _record(window: _Window) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose member starts at the window's place: header, block and the place after; None if it isn't one."""
    unpack, parts, fed, seen = zlib.decompressobj(31), [], 0, b""
    header = None
    while True:
        if fed == len(window.data) and not window.more():
            return None
        chunk = window.data[fed:] if fed else window.data[: 1 << 14]
        fed += len(chunk)
        try:
            got = unpack.decompress(chunk)
        except zlib.error:
            return None
        parts.append(got)
        if header is None:
            seen += got
            if seen[:5] != b"WARC/"[: len(seen)]:
                return None
            if (cut := seen.find(b"\r\n\r\n")) >= 0:
                header = _header(seen[:cut])
                if header is None or "warc-type" not in header or not header.get("content-length", "").isdigit():
                    return None
        if unpack.eof:
            break
    after = fed - len(unpack.unused_data)
    while len(window.data) < after + 2 and window.more():
        pass
    if header is None or window.data[after : after + 2] not in (b"", MAGIC[:2]):
        return None
    whole = b"".join(parts)
    block = whole[cut + 4 : cut + 4 + int(header["content-length"])]
    return header, block, window.at + after


def records_of(file, start: int, end: int):
    """(header, block) of the records whose members start in [start, end) of an open archive."""
    window = _Window(file, start)
    while window.at < end:
        if len(window.data) < 3 and not window.more() and len(window.data) < 3:
            return
        hit = window.data.find(MAGIC)
        if hit < 0:
            window.to(window.at + len(window.data) - 2)
            if not window.more():
                return
            continue
        window.to(window.at + hit)
        if window.at >= end:
            return
        found = _record(window)
        if found is None:
            window.to(window.at + 1)
            continue
        yield found[:2]
        window.to(found[2])


def _row(header: dict[str, str], block: bytes) -> tuple:
    page = lambda key: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", header.get(key, ""))) else None
    http, _, body = block.partition(b"\r\n\r\n")
    length, digest = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), header["warc-payload-digest"].removeprefix("sha256:")
    if header["warc-type"] == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"record {header.get('warc-record-id')} doesn't hold the payload that it names")
    return page("warc-record-id"), header.get("warc-target-uri"), length, digest, header["warc-type"], page("warc-refers-to"), body if header["warc-type"] == "response" else None


def read(archives: DataFrame, split_bytes: int = 64 << 20, payload: bool = True) -> DataFrame:
    """Records (RECORD) of the archives (path, bytes), each byte range of split_bytes read by a task of its own."""
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))

    def task(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = (pafs.LocalFileSystem(), path) if path.startswith("/") else _store(path)
                rows, size = [], 0
                with store.open_input_file(at) as file:
                    for header, block in records_of(file, start, start + split_bytes):
                        if header["warc-type"] not in ("response", "revisit"):
                            continue
                        row = _row(header, block)
                        rows.append(row if payload else (*row[:6], None))
                        size += len(block) if payload else 0
                        if size > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in rows], schema=_OUT)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in rows], schema=_OUT)

    # a row is a whole range of work, so they are dealt out evenly, not by a key
    return ranges.repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(task, RECORD)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives in a folder that other programs wrote; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("bytes"))


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written to archives in the shared folder and read back, without the payloads; raises ValueError if a record is missing."""
    manifest = write(plan(pages), shared_path(pages.sparkSession, "warc"))
    return complete(read(manifest, payload=False), manifest).drop("payload")


def complete(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """records, settled and counted against the manifest they were read by: a damaged member is no silently shorter result."""
    records = written(records, "warc-records")
    found, stored = records.count(), manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if found != stored:
        raise ValueError(f"{found} records read, {stored} written: an archive is damaged")
    return records
