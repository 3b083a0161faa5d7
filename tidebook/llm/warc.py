"""WARC archives: a deterministic writer in shards, and a reader.

Records are range-sorted by page id and payload digest. Each task writes its range to files of its own, one gzip
member for each record, and begins a new file once the compressed size reaches a limit. Headers, record ids and
digests are made anew from the page, and no clock or random number is used, so equal rows and shards give equal
bytes.

A task writes below ``_temporary`` under a name of its attempt and returns the file's line of the manifest. Once
all are written, the lines of the attempts that counted are stored, each named file is moved to its final place,
and the manifest is published last. A reader only takes files that the manifest lists, so files of lost or
repeated attempts are never read, and a commit that broke off can be run again.

The manifest also has the places at which a file can be entered, so a large file is read by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Fixed value: all records bear this date, as pages have none.
WARC_DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("00000000-0000-0000-0000-000000000000")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def digest_label(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_id(page: str, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page} {sha1.hex()}')}>"


def quoted(value) -> str:
    """A value as header text: control characters, blanks and ``%`` in hexadecimal, so it stays on its line."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), str(value))


_UNSAFE = re.compile("[\x00-\x20%\x7f-\xa0\u2028\u2029]")


def unquoted(text: str) -> str:
    return unquote_to_bytes(text.encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass")


def record(page_id, url: str | None, payload: bytes, revisit: bool, refers_to) -> bytes:
    """An uncompressed record: the page's response, or a revisit of the response of another page of equal payload.

    Ids are written quoted; a null id or url has no header, so an empty one is told apart. A url of which quoting
    changes anything is given in a header of its own besides.
    """
    sha1, page = hashlib.sha1(payload).digest(), "" if page_id is None else str(page_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, sha1)}", f"WARC-Date: {WARC_DATE}"]
    if url is not None:
        target = "".join(c if c > " " else "%{:02X}".format(ord(c)) for c in url)
        lines += [f"WARC-Target-URI: {target}", *([f"X-Target-Quoted: {quoted(url)}"] if quoted(url) != url else [])]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {digest_label(hashlib.sha1(block).digest())}", f"WARC-Payload-Digest: {digest_label(sha1)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {quoted(page)}")
    if revisit:
        other = "" if refers_to is None else str(refers_to)
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(other, sha1)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {quoted(other)}")
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: ``starts``: places in the file at which a record begins, the first at 0 and the others about a part apart.
MANIFEST = "shard int, number int, temporary string, file string, n_records bigint, n_bytes bigint, sha1 string, starts array<bigint>"


def _writer(root: str, roll_bytes: int, part_bytes: int):
    kind = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("temporary", pa.string()), ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha1", pa.string()), ("starts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        out = name = None
        number, lines, page, first, more = 0, [], object(), None, False

        def close() -> None:
            nonlocal out, number
            if out is not None:
                out.close()
                lines.append((shard, number, name, f"part-{shard:06d}-{number:04d}.warc.gz", records, size, sha1.hexdigest(), starts))
                out, number = None, number + 1

        for batch in batches:
            for row in batch.to_pylist():
                if page != (row["page_id"], row["digest"]):
                    page, first, more = (row["page_id"], row["digest"]), None, False
                if row["is_note"]:  # the payload occurs more than once: the page that has the response
                    first = (row["refers_to"],)
                    continue
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                # of repeated rows of the response's page the first is the response
                revisit = first is not None and (more or first[0] != row["page_id"])
                refers_to, more = first[0] if revisit else None, True
                data = member(record(row["page_id"], row["url"], payload, revisit, refers_to))
                if out is not None and size + len(data) > roll_bytes:
                    close()
                if out is None:
                    name, records, size, sha1, starts = f"_temporary/part-{shard:06d}-{number:04d}-{attempt}.warc.gz", 0, 0, hashlib.sha1(), []
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                if not starts or size - starts[-1] >= part_bytes:
                    starts.append(size)
                out.write(data)
                sha1.update(data)
                records, size = records + 1, size + len(data)
        close()
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), kind)], schema=kind)

    return run


def _mover(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{base}/{row['temporary']}", f"{base}/{row['file']}"
                # a repeated task finds the file moved
                if fs.get_file_info(source).type != pafs.FileType.NotFound:
                    fs.move(source, target)
                elif fs.get_file_info(target).size != row["n_bytes"]:
                    raise FileNotFoundError(source)
            yield batch

    return run


def first_pages(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload, of at least so many bytes, occurs more than once."""
    html = F.coalesce(F.col("html"), F.lit(""))
    large = pages.where(F.octet_length(html) >= least_bytes).select("page_id", F.sha1(html).alias("digest"))
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "refers_to")
    # a payload may be that of a third of all pages; its side is split by the join, the other has one row for it
    return large.join(first, F.col("digest") == F.col("_digest")).select("page_id", "digest", "refers_to").distinct()


#: Files that a task moves, and tasks that read or move at most.
MOVES, MOST_TASKS = 8, 20_000


def write_warc(pages: DataFrame, root: str, roll_bytes: int = 256 << 20, least_revisit_bytes: int = 1000, shards: int | None = None, part_bytes: int = 4 << 20) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) below ``root`` and returns the manifest.

    ``root`` is a folder that all executors share. A null html is an empty payload; a null url or page_id has no
    header and is read back as null, an empty one as empty. Null ids come first. Of pages with equal payloads of
    at least ``least_revisit_bytes`` the one with the largest page_id is written as response and the others as
    revisits of it; of repeated rows of that page the first is the response. An empty table gives an empty
    manifest. Other columns are not read. ``part_bytes`` is about what a reader's task takes of a file.

    Rows of one id are dealt out by the digest of their payload, so only equal rows have to share a task.
    """
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, base = file_system(root)
    fs.create_dir(f"{base}/_temporary", recursive=True)
    kind = pages.schema["page_id"].dataType
    rows = pages.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit(""))).alias("digest"), F.lit(False).alias("is_note"), F.lit(None).cast(kind).alias("refers_to"), "url", "html")
    notes = first_pages(pages, least_revisit_bytes).select("page_id", "digest", F.lit(True).alias("is_note"), "refers_to")
    # a note comes before the rows of its page and payload, and equal pages in a fixed order
    both = rows.unionByName(notes, allowMissingColumns=True).repartitionByRange(shards, "page_id", "digest")
    ordered = both.sortWithinPartitions("page_id", "digest", F.desc("is_note"), "url", "html")
    lines = materialise(ordered.mapInArrow(_writer(root, roll_bytes, part_bytes), MANIFEST), "warc-lines")
    moved = dealt(lines, lines.count() / MOVES, "file").mapInArrow(_mover(root), MANIFEST)
    moved.write.parquet(f"{root}/manifest")  # published when all files are in place: Spark renames it at the end
    fs.delete_dir(f"{base}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def dealt(lines: DataFrame, tasks: float, *columns: str) -> DataFrame:
    """Lines of the manifest in so many partitions: they are small, but what they name is not."""
    return lines.repartitionByRange(max(1, min(math.ceil(tasks), MOST_TASKS)), *columns)


# --- reading ----------------------------------------------------------------------------------------------------


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, by lower-case name, and the block of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v.strip(" ") for k, v in (line.split(":", 1) for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def members(stream, size: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of the next ``size`` bytes of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while size > 0 and (data := stream.read(min(chunk, size))):
        size -= len(data)
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
            else:
                data = b""
    if parts:
        raise EOFError("the archive ends within a record")


RECORDS = "page_id string, url string, record_type string, payload binary, payload_bytes bigint, payload_sha1 string, refers_to string"


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The records of the archives that the manifest lists: page_id, url, record_type (response or revisit),
    payload (null for revisits), payload_bytes, payload_sha1 (lower-case hex) and refers_to (a page_id).

    Ids are texts. A response's payload is held against its digest and a mismatch fails the read. Files are
    entered at the places that the manifest names, a task for each, and read as streams, record by record.
    """
    lines = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("n_bytes"))
    parts = lines.select("file", F.explode(F.arrays_zip(F.col("starts").alias("start"), ends.alias("end"))).alias("p")).select("file", "p.start", "p.end")
    n_parts = lines.agg(F.sum(F.size("starts"))).first()[0]
    kind = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("refers_to", pa.string())])

    def parsed(data: bytes) -> tuple:
        headers, block = parse_record(data)
        sha1 = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
        payload = None
        if headers["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if hashlib.sha1(payload).digest() != sha1:
                raise ValueError(f"the payload of {headers['warc-record-id']} does not have its digest")
        size = int(headers["x-payload-length"])
        exact = lambda name: unquoted(headers[name]) if name in headers else None
        url = exact("x-target-quoted") if "x-target-quoted" in headers else headers.get("warc-target-uri")
        return exact("x-page-id"), url, headers["warc-type"], payload, size, sha1.hex(), exact("x-refers-to-page-id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for batch in batches:
            for file, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                with fs.open_input_file(f"{base}/{file}") as whole:
                    whole.seek(start)
                    for data in members(whole, end - start):
                        rows.append(parsed(data))
                        size += len(data)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return dealt(parts, n_parts or 1, "file", "start").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, root: str) -> DataFrame:
    """Writes the archives below ``root``, reads them back, and returns for each page: page_id, payload_bytes,
    payload_digest, record_type and refers_to (null for responses)."""
    write_warc(pages, root)
    kind = pages.schema["page_id"].dataType
    found = read_warc(pages.sparkSession, root)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
