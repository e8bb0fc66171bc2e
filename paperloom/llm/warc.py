"""WARC archives: writing, a normaliser for monolithic gzip, and reading by index.

write_archives writes archives as one gzip stream each. normalise inflates such
a stream once, front to back, rewrites every record as a gzip member of its own
and writes a sidecar index of offset, length and record id. read_archives then
seeks each record by that index. Files lie in the shared folder; a try of a
task has file names of its own, and only those of the try that counts are
listed in the manifest, so lost executors leave nothing half written in use.

Payloads of equal digest and at least ``least`` bytes are stored once, with the
largest page id; the others are revisit records that refer to it.

Cases: a null html is an empty payload; a null or odd url is left out or
percent-escaped; null page ids are written as such and never chosen while
another id has the payload; rows that repeat the chosen id are all responses;
payloads of any size are stored whole; an empty table gives no archives and an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, new_path, slices

#: Payloads of fewer bytes are never revisits. Bytes of records in an archive before the next begins. Level of gzip.
LEAST, ARCHIVE, LEVEL = 1000, 32 << 20, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
BLOCK = 1 << 16


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record: an HTTP response, or a revisit with its HTTP header only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    return f"WARC/1.1\r\n{'\r\n'.join(head)}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """Named fields of a record's header, and where its block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) for x in lines[1:]), end + 4


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream of inflated bytes, each whole."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while held:
            if not need:
                if (end := held.find(b"\r\n\r\n")) < 0:
                    break
                need = end + 8 + int(re.search(rb"(?im)^Content-Length: *(\d+)", held[:end])[1])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip(b"\r\n"):
        raise ValueError("the stream ends inside a record")


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, as Python workers reach it, and the folder's path there. Names that only Hadoop has for S3 are mapped."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, block by block; each input byte is inflated once. A member without its end is an error."""
    z, begun = zlib.decompressobj(31), False
    while block := stream.read(BLOCK):
        while block:
            yield z.decompress(block)
            block, begun = z.unused_data, not z.eof
            if z.eof:
                z = zlib.decompressobj(31)
    if begun:
        raise ValueError("the gzip stream ends before its trailer")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise_file(fs: pafs.FileSystem, source: str, target: str) -> int:
    """Rewrite one gzip stream as a member for each record, with target.idx beside it; the number of records."""
    at = n = 0
    with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(target, compression=None) as out, fs.open_output_stream(f"{target}.idx", compression=None) as index:
        for data in records(inflated(raw)):
            packed = member(data)
            out.write(packed)
            index.write((json.dumps([at, len(packed), headers(data)[0]["WARC-Record-ID"]]) + "\n").encode())
            at += len(packed)
            n += 1
    return n


def read_index(fs: pafs.FileSystem, path: str) -> list[list]:
    with fs.open_input_stream(f"{path}.idx", compression=None) as f:
        return [json.loads(x) for x in f.read().splitlines()]


def choose(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages as columns page_id, url, html, digest, refers_to; refers_to is the response's id for revisits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1(F.encode("html", "utf-8")).alias("digest"))
    long = F.octet_length("html") >= least
    chosen = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n")).where("n > 1 and chosen is not null").select("digest", "chosen")
    chosen = as_table(chosen, "chosen")
    revisit = F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen"))
    # Small payloads have no response to look for; a key of its own each keeps the empty ones out of one task.
    key = F.when(long, F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.xxhash64("page_id", "url").cast("string"), F.lit(""))))
    keyed = rows.withColumn("key", key)
    return keyed.join(chosen.withColumnRenamed("digest", "key"), "key", "left").select("page_id", "url", "html", "digest", F.when(revisit, F.col("chosen")).alias("refers_to"))


def write_archives(chosen: DataFrame, folder: str) -> DataFrame:
    """Write monolithic archives; the manifest: column path."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out = z = path = None
        size = 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path]})

        for row in (row for whole in batches for b in slices(whole, "html") for row in b.to_pylist()):
            if out is None:
                path, size, z = f"{base}/{uuid.uuid4().hex}.mono.warc.gz", 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out = fs.open_output_stream(path, compression=None)
            kind = "response" if row["refers_to"] is None else "revisit"
            data = record(row["page_id"], row["url"], row["html"].encode(), row["digest"], kind, row["refers_to"])
            out.write(z.compress(data))
            size += len(data)
            if size >= ARCHIVE:
                yield close()
                out = None
        if out is not None:
            yield close()

    return as_table(chosen.mapInArrow(write, "path string"), "written")


def normalise(manifest: DataFrame, folder: str, keep: bool = False) -> DataFrame:
    """Normalise each archive of a manifest; the new manifest: columns path, n_records. The old archives go, unless kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for b in batches:
            for source in b.column("path").to_pylist():
                target = f"{base}/{uuid.uuid4().hex}.warc.gz"
                yield pa.RecordBatch.from_pydict({"source": [source], "path": [target], "n_records": [normalise_file(fs, source, target)]})

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for b in batches:
            for source in b.column("source").to_pylist():
                if fs.get_file_info(source).type == pafs.FileType.File:
                    fs.delete_file(source)
            yield b

    done = as_table(_spread(manifest).mapInArrow(run, "source string, path string, n_records long"), "normalised")
    if not keep:
        _spread(done).mapInArrow(drop, done.schema).count()
    return done.select("path", "n_records")


def _spread(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, min(manifest.count(), 10_000)), "path")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of normalised archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                index, size, rows = read_index(fs, path), 0, []
                with fs.open_input_file(path) as f:
                    for at, length, name in index:
                        f.seek(at)
                        data = zlib.decompress(f.read(length), 31)
                        rows.append(parse(data, name))
                        size += len(data)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            size, rows = 0, []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    def parse(data: bytes, name: str) -> dict:
        head, at = headers(data)
        if head["WARC-Record-ID"] != name:
            raise ValueError(f"the index names {name}, the archive has {head['WARC-Record-ID']}")
        block = data[at : at + int(head["Content-Length"])]
        http, _, body = block.partition(b"\r\n\r\n")
        n = int(re.search(rb"(?im)^Content-Length: *(\d+)", http)[1])
        kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (hashlib.sha1(body).hexdigest() != stated or len(body) != n):
            raise ValueError(f"payload of {name} does not match its header")
        return {"page_id": number(name), "url": head.get("WARC-Target-URI"), "record_type": kind, "refers_to": number(head.get("WARC-Refers-To")), "payload_bytes": n, "payload_digest": stated, "payload": body if kind == "response" else None}

    kinds = {"page_id": "long", "url": "string", "record_type": "string", "refers_to": "long", "payload_bytes": "long", "payload_digest": "string", "payload": "binary"}
    schema = pa.schema([(k, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[v]) for k, v in kinds.items()])
    return _spread(manifest).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = normalise(write_archives(choose(pages), folder), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
c AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS chosen FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> chosen THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> chosen THEN chosen END AS refers_to
FROM c
"""
