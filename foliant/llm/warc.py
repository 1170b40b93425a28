"""WARC archives: write them as whole-file gzip streams, normalise to a member per record with an offset index, read back.

The archives live in a folder that driver and executors share. Every task writes files of its own name; a table of the
files that finished tasks wrote is the only way to them, so what a lost task left is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bound_batches, only, open_store, scratch_path, stored

#: Equal payloads of at least so many bytes are written once; the others revisit it.
REVISIT_BYTES = 1000
#: Records that are read back by an index at once.
INDEX_ROWS = 10_000


def record_plan(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of every row.

    Of equal payloads of at least `least` bytes the largest page_id is the response, the others revisit it. A null html
    is an empty payload. A null page_id is smaller than any other; rows that repeat the largest page_id are all
    responses. Digests are counted before the rows are joined with the few that repeat.
    """
    rows = only(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.encode("html", "UTF-8"))})
    large = rows.filter(F.col("payload_bytes") >= least)
    again = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(again, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("last_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last_id")))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last_id")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id, url, html: bytes, n_bytes: int, digest: str, kind: str, refers_to) -> bytes:
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (html if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page_id is None else page_id)]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", refers_to)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(stream: BinaryIO) -> tuple[dict[str, str], bytes, bytes] | None:
    """The fields, the block and the whole bytes of the next record of an inflated stream; None at its end."""
    raw, fields = [stream.readline()], {}
    if not raw[0]:
        return None
    if not raw[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {raw[0][:40]!r}")
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the file ends inside a record's head")
        raw.append(line)
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    raw.append(line)
    block, end = stream.read(int(fields["content-length"])), stream.read(4)
    if len(block) < int(fields["content-length"]) or end != b"\r\n\r\n":
        raise ValueError("the file ends inside a record")
    return fields, block, b"".join([*raw, block, end])


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO) -> int:
    """Inflate source once as a stream, write each record as a gzip member of its own to target and a line with its
    offset, length and id to index. Holds one record at a time. Members of any number in source do; returns the records."""
    offset = n = 0
    with gzip.GzipFile(fileobj=source, mode="rb") as stream:
        while (found := read_record(stream)) is not None:
            member = gzip.compress(found[2], mtime=0)
            target.write(member)
            index.write(f"{offset}\t{len(member)}\t{found[0]['warc-record-id']}\n".encode())
            offset, n = offset + len(member), n + 1
    return n


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Write the records of record_plan(), each task one whole-file gzip stream; the table of files (path, n)."""
    bound_batches(plan.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            narrow = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
            for page_id, url, *rest, html in zip(*narrow, batch.column(2)):
                if out is None:
                    raw = store.open_output_stream(f"{top}/{name}", compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="")
                out.write(make_record(page_id, url, html.as_buffer().to_pybytes(), *rest))
                n += 1
        if out is not None:
            out.close()
            raw.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "n"])

    return stored(plan.mapInArrow(write, "path string, n long"), "warc-files")


def each_file(files: DataFrame) -> DataFrame:
    """The table of files with a partition for each."""
    return files.repartition(max(1, files.count()))


def normalise_archives(files: DataFrame, folder: str) -> DataFrame:
    """Normalise every file into folder, its index beside it; the table of the new files (path, n)."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                source_store, source = open_store(path)
                with source_store.open_input_stream(source, compression=None) as raw, store.open_output_stream(f"{top}/{name}", compression=None) as target, store.open_output_stream(f"{top}/{name}.idx", compression=None) as index:
                    n = normalise(raw, target, index)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "n"])

    return stored(each_file(files).mapInArrow(rewrite, "path string, n long"), "warc-normal")


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of normalised files, found by the index: page_id, payload_bytes, payload_digest, record_type, refers_to,
    path, offset. A response's digest is worked out anew from its payload and must equal the one that its head states."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_store(path)
                with store.open_input_file(at) as raw, store.open_input_stream(f"{at}.idx", compression=None) as index:
                    lines = index.read().decode().splitlines()
                    for first in range(0, len(lines), INDEX_ROWS):
                        places = [(int(offset), int(size)) for offset, size, _ in (line.split("\t") for line in lines[first : first + INDEX_ROWS])]
                        rows = [(*read_member(raw, offset, size), path, offset) for offset, size in places]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset"])

    return each_file(files).mapInArrow(read, schema)


def read_member(raw: BinaryIO, offset: int, length: int) -> tuple:
    import io

    raw.seek(offset)
    fields, block, _ = read_record(io.BytesIO(gzip.decompress(raw.read(length))))
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    n_bytes = int(http.rpartition(b"Content-Length: ")[2])
    if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n_bytes):
        raise ValueError(f"the payload at {offset} does not have its digest")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return number("x-page-id"), n_bytes, digest, fields["warc-type"], number("x-refers-to-page")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder, normalise these and read every record back."""
    top = scratch_path(pages.sparkSession, "warc")
    whole = write_archives(record_plan(pages), f"{top}/whole")
    return read_archives(normalise_archives(whole, f"{top}/members"))
