"""WARC archives: write captures as request, response (or revisit) and metadata records, read archives back, and join
the three through their WARC-Concurrent-To identifiers into one nested row per capture.

Archives lie in a folder that driver and executors share and are written by pyarrow's file systems (file, hdfs, s3, gs).
Every attempt of a task writes files of its own names, and the rows it returns name them: attempts that run at the same time
or fail cannot touch each other's files, and the stored rows (the index) say which archives count. A file that no row names
belongs to a lost attempt and is never read. Reading streams each archive record by record; no archive is held in memory.

Defined results: null html is an empty payload; payloads shorter than MIN_REVISIT are always responses; equal rows (same
page_id and payload) are captures of their own; an empty table gives no archive and no rows; extra columns are ignored."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Payloads of at least so many bytes are stored once; later equal ones revisit the first.
MIN_REVISIT = 100
#: A task starts another archive beyond so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 2
RECORDS = "record_id string, concurrent_to string, warc_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, capture_id long"


def _store(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("file:///", "/") if uri.startswith("file:///") else uri)


def record(kind: str, record_id: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *headers, ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + z.flush()


def _clean(value: str | None) -> str | None:
    """A header's value is one line."""
    return None if value is None else " ".join(value.split())


def capture(page_id: int | None, salt: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The three records of a capture. Ids are derived, so a repeated task writes the same bytes."""

    def uid(part: str, of) -> str:
        return str(uuid.UUID(bytes=hashlib.blake2b(f"{part}:{of}".encode(), digest_size=16).digest()))

    own = f"{page_id}:{salt}"
    response, uri = uid("response", own), _clean(url)
    main = [("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        kind, body = "response", status + payload
    else:
        kind, body = "revisit", status
        main += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:capture:{refers_to}>")]
    along = [("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Concurrent-To", f"<urn:uuid:{response}>")]
    fields = f"capture-id: {'' if page_id is None else page_id}\r\npayload-length: {len(payload)}\r\n".encode()
    return b"".join(
        (
            record("request", uid("request", own), [*along, ("Content-Type", "application/http; msgtype=request")], f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode("utf-8", "surrogatepass")),
            record(kind, response, main, body),
            record("metadata", uid("metadata", own), [*along, ("Content-Type", "application/warc-fields")], fields),
        )
    )


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a capture for each row of pages; one row for each archive: path, captures, bytes.

    The smallest page_id of a payload is found by a pre-aggregated count over digests. Only digests that occur twice are
    joined back, and a hot digest's rows stay on the side that adaptive execution can split."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    firsts = written(rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    linked = rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        made: list[tuple[str, int, int]] = []
        out, written, captures, serial = None, 0, 0, 0
        name = lambda: f"capture-{part:05d}-{len(made):04d}-{own}.warc.gz"

        def close() -> None:
            nonlocal out, written, captures
            if out is not None:
                out.close()
                made.append((f"{folder.rstrip('/')}/{name()}", captures, written))  # with the folder's scheme, for readers
            out, written, captures = None, 0, 0

        for batch in batches:
            for page, uri, text, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{base.rstrip('/')}/{name()}", compression=None)
                data = capture(page, (part << 40) + serial, uri, text.encode("utf-8", "surrogatepass"), digest, refers)
                serial += 1
                out.write(data)
                written += len(data)
                captures += 1
                if written > ARCHIVE_BYTES:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_pydict({"path": [x[0] for x in made], "captures": pa.array([x[1] for x in made], pa.int64()), "bytes": pa.array([x[2] for x in made], pa.int64())})

    return linked.mapInArrow(run, "path string, captures long, bytes long")


def _members(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The gzip members of a stream, one after another."""
    z, parts = zlib.decompressobj(31), []
    data = stream.read(chunk)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data or stream.read(chunk), zlib.decompressobj(31), []
        else:
            data = stream.read(chunk)
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse(member: bytes, payload: bool = True) -> dict:
    """A record's fields; the payload of a response is what follows the HTTP header."""
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    out = {"record_id": headers["WARC-Record-ID"], "concurrent_to": headers.get("WARC-Concurrent-To"), "warc_type": headers["WARC-Type"], "target_uri": headers.get("WARC-Target-URI"), "refers_to": headers.get("WARC-Refers-To")}
    out |= {"payload_digest": None, "payload_bytes": None, "payload": None, "capture_id": None}
    if out["warc_type"] == "response":
        content = body.partition(b"\r\n\r\n")[2]
        out |= {"payload_digest": hashlib.sha256(content).hexdigest(), "payload_bytes": len(content), "payload": content if payload else None}
        if headers.get("WARC-Payload-Digest") not in (None, f"sha256:{out['payload_digest']}"):
            raise ValueError(f"the payload of {out['record_id']} does not have its digest")
    elif out["warc_type"] == "revisit":
        out["payload_digest"] = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    elif out["warc_type"] == "metadata":
        fields = dict(x.split(": ", 1) for x in body.decode().split("\r\n") if ": " in x)
        out |= {"payload_bytes": int(fields["payload-length"]) if "payload-length" in fields else None, "capture_id": int(fields["capture-id"]) if fields.get("capture-id") else None}
    return out


def read_records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row for each record of the archives (a column path). Payloads are checked against their digests."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, RECORDS.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _store(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for member in _members(stream):
                        rows.append(parse(member, payload))
                        held += len(rows[-1]["payload"] or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spread = archives.select("path")
    return spread.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit with the request and the metadata that name it.

    Every key is a record's own id, so no key is hot."""
    key = F.coalesce("concurrent_to", "record_id")
    body = F.struct("record_id", "warc_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response")
    main = records.where(F.col("warc_type").isin("response", "revisit")).select(key.alias("k"), body)
    request = records.where("warc_type = 'request'").select(key.alias("k"), F.struct("record_id", "target_uri").alias("request"))
    metadata = records.where("warc_type = 'metadata'").select(key.alias("k"), F.struct("record_id", "capture_id", "payload_bytes").alias("metadata"))
    return main.join(request, "k", "left").join(metadata, "k", "left").select(F.col("metadata.capture_id").alias("capture_id"), "request", "response", "metadata")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back and assembles the captures (without payloads)."""
    folder = shared_dir(spark)
    archives = write_archives(pages, f"{folder}/archives")
    archives.write.parquet(f"{folder}/index")
    index = spark.read.schema("path string, captures long, bytes long").parquet(f"{folder}/index")
    records = read_records(index.repartition(max(1, spark.sparkContext.defaultParallelism)), payload=False)
    records.write.parquet(f"{folder}/records")  # each archive is read once, not once for each side of the joins
    return assemble(spark.read.schema(records.schema).parquet(f"{folder}/records"))


def digests(captures: DataFrame) -> DataFrame:
    """The columns of the query over assembled captures."""
    return captures.select(
        F.col("capture_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        F.regexp_extract("response.refers_to", "capture:(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
    )


