"""WARC archives: a writer, and a sequential reader.

One gzip member per record. The reader takes a stream in chunks, inflates one member at a time, frames the record
by its Content-Length, and verifies the payload's length and SHA-256 against what the record declares.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.staging import new_path, stage

#: Compressed bytes after which a writer begins another archive.
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 18
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Record(NamedTuple):
    kind: str
    page_id: int | None
    refers_to: int | None
    url: str | None
    payload: bytes | None  # None: a revisit, which has no payload of its own
    payload_bytes: int
    digest: str


class Corrupt(ValueError):
    """An archive that breaks its framing or whose payload differs from its digest."""


# ------------------------------------------------------------------------------------------------- records


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _from_urn(urn: str | None) -> int | None:
    name = (urn or "null>").rpartition(":")[2].rstrip(">")
    return None if name == "null" else int(name)


def encode(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """A record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._')}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The contents of each gzip member, inflated chunk by chunk."""
    inflate, parts, left = zlib.decompressobj(31), [], b""
    while True:
        chunk = left or stream.read(CHUNK)
        left = b""
        if not chunk:
            break
        try:
            parts.append(inflate.decompress(chunk))
        except zlib.error as e:
            raise Corrupt(f"not a gzip member: {e}") from e
        if inflate.eof:
            left = inflate.unused_data
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
    if parts:
        raise Corrupt("the last gzip member is cut short")


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    fields = (line.partition(":") for line in rest)
    return first, {k.strip().lower(): v.strip() for k, _, v in fields}


def decode(member: bytes) -> Record | None:
    """The record in a member; None for types other than response and revisit."""
    at = member.find(b"\r\n\r\n")
    version, fields = _headers(member[:at]) if at >= 0 else ("", {})
    if not version.startswith("WARC/"):
        raise Corrupt("a member doesn't begin with a WARC header")
    kind = fields.get("warc-type", "")
    start, length = at + 4, int(fields["content-length"])
    if len(member) != start + length + 4 or member[start + length :] != b"\r\n\r\n":
        raise Corrupt(f"a record's Content-Length is {length}; its member holds {len(member) - start - 4} bytes")
    if kind not in ("response", "revisit"):
        return None
    cut = member.find(b"\r\n\r\n", start, start + length)
    if cut < 0:
        raise Corrupt("a record has no HTTP header")
    _, http = _headers(member[start:cut])
    declared, payload = int(http["content-length"]), member[cut + 4 : start + length]
    digest = fields["warc-payload-digest"].partition(":")[2]
    if kind == "response" and len(payload) != declared:
        raise Corrupt(f"a payload has {len(payload)} bytes; {declared} are declared")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise Corrupt("a payload doesn't have the digest that its record declares")
    refers = _from_urn(fields.get("warc-refers-to")) if kind == "revisit" else None
    return Record(kind, _from_urn(fields.get("warc-record-id")), refers, fields.get("warc-target-uri"), payload if kind == "response" else None, declared, digest)


def read_records(stream: BinaryIO) -> Iterator[Record]:
    for member in members(stream):
        record = decode(member)
        if record:
            yield record


# --------------------------------------------------------------------------------------------------- files


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a Python process on an executor reaches ``uri`` by."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives below ``folder``; returns their ``(path, records, bytes)``.

    Of rows with equal payloads of at least ``min_revisit`` bytes, those with the smallest page_id are responses
    and the rest revisits that refer to it. Each task writes to names of its own and moves an archive into place
    when it is whole; only archives in the returned table count, so a repeated task leaves none counted twice.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = stage(same.where("n > 1").drop("n"), "first-pages")  # staged, so that AQE can split the payloads of one digest
    rows = rows.join(same, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        done, out = [], None

        def close():
            out.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            done.append((f"{folder}/{name}", count, size))

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c for c in b.columns)):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/.{name}", compression=None)
                to = refers_to.as_py()
                data = encode(page_id.as_py(), url.as_py(), payload.as_py(), to, to is not None, digest.as_py())
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    return stage(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def _batch(records: list[Record], texts: bool) -> pa.RecordBatch:
    cols = [pa.array([r.page_id for r in records], pa.int64()), pa.array([r.payload_bytes for r in records], pa.int64()), pa.array([r.digest for r in records], pa.string()), pa.array([r.kind for r in records], pa.string()), pa.array([r.refers_to for r in records], pa.int64())]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if texts:
        cols += [pa.array([r.url for r in records], pa.string()), pa.array([r.payload for r in records], pa.binary())]
        names += ["url", "payload"]
    return pa.RecordBatch.from_arrays(cols, names)


def _batches(records: Iterator[Record], texts: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r if texts else r._replace(payload=None))
        size += len(r.payload or b"") * texts + 200
        if size >= 8 << 20:
            yield _batch(held, texts)
            held, size = [], 0
    if held:
        yield _batch(held, texts)


def read_archives(archives: DataFrame, texts: bool = False) -> DataFrame:
    """Records of the archives in column ``path``, each read from its stream; ``texts`` adds url and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = _open(path)
                with fs.open_input_stream(name, compression=None) as stream:
                    yield from _batches(read_records(stream), texts)

    tasks = min(max(archives.count(), 1), 10_000)
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, FIELDS + ", url string, payload binary" * texts)


def read_files(spark: SparkSession, glob: str, texts: bool = False) -> DataFrame:
    """The same for archives that only Spark's readers reach; each is one value, so of 2 GB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from _batches(read_records(io.BytesIO(content.as_py())), texts)

    return spark.read.format("binaryFile").load(glob).select("content").mapInArrow(run, FIELDS + ", url string, payload binary" * texts)


def verified(records: DataFrame) -> DataFrame:
    """The records, each revisit held against the response that it names: another digest there, or none, raises.

    What is compared are ids and digests; a page with very many revisits is split by AQE, as both sides are staged.
    """
    records = stage(records, "records")
    known = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    known = stage(known.withColumn("held", F.lit(True)), "responses")
    found = records.join(known, ["refers_to", "payload_digest"], "left")
    wrong = F.raise_error(F.concat(F.lit("Corrupt: a revisit's digest isn't that of response "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))
    kind = F.when((F.col("record_type") == "response") | F.col("held"), F.col("record_type")).otherwise(wrong)
    return found.select(*[kind.alias(c) if c == "record_type" else F.col(c) for c in records.columns])


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages and read the archives back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Null html: an empty payload. Null url: no target URI. Null page_id: read back as null; it never is the page
    referred to. Rows that share the smallest page_id of a payload are all responses; other repeated rows are
    revisits. Empty table: no archives and no rows. A damaged archive raises ``Corrupt``, a revisit whose response has
    another digest fails likewise.
    """
    return verified(read_archives(write_archives(pages, folder or new_path(pages.sparkSession, "warc"))))
