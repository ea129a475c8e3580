"""Deterministic sharded WARC archives: written, committed and read back.

Records are sorted by range of their key into shards. The bounds of the shards come from
the table alone (a histogram of payload bytes over key ranges of equal width, at most
``CELLS`` cells), so equal tables give equal files however tasks are laid out. The task
of a shard streams its records into gzip members and starts a new file once the current
one exceeds ``ROLL`` compressed bytes. Headers, digests and record ids are made anew from
the rows. A file is written under a temporary name of the task attempt and renamed to its
final name when complete: a task that is run again, or twice at once, leaves the same
bytes under the same name. The manifest of all files is written last; readers take the
files it lists and nothing else.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.tables import Batches, sliced, staged

ROLL = 32 << 20  # compressed bytes after which a file is closed
SHARD = 64 << 20  # payload bytes of a shard, about
CELLS = 1 << 14
SMALLEST = 100  # bytes of a payload that may be written as a revisit
DATE = "2000-01-01T00:00:00Z"  # written to all records, so that files are reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest"


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``id, url, payload, digest, first``: ``first`` is the least id with that payload."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    repeated = F.octet_length("payload") >= SMALLEST
    firsts = (
        rows.where(repeated)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    # Written, so that its size is known: payloads are only shuffled to a large table of them.
    return rows.join(staged(firsts, "firsts"), "digest", "left").select("id", "url", "payload", "digest", "first")


def _shards(pages: DataFrame, id_col: str, payload_col: str) -> tuple[Column, int]:
    """The shard of ``id``, and their number: ranges of near-equal payload bytes."""
    key = F.col(id_col).cast("long")
    low, high = pages.agg(F.min(key), F.max(key)).first()
    if low is None:
        return F.lit(0), 1
    width = (high - low) // CELLS + 1

    def cell(key: Column) -> Column:
        return F.floor((F.coalesce(key, F.lit(low)) - low) / width).cast("int")

    size = F.coalesce(F.octet_length(payload_col), F.lit(0)) + 512
    # At most CELLS rows come to the driver, whatever the size of the table.
    sums = pages.groupBy(cell(key).alias("cell")).agg(F.sum(size).alias("bytes")).collect()
    bounds, filled = [], 0
    for row in sorted(sums):
        if filled >= SHARD:
            bounds.append(row["cell"])
            filled = 0
        filled += row["bytes"]
    if not bounds:
        return F.lit(0), 1
    own = cell(F.col("id"))
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= own)), len(bounds) + 1


def record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key}:{digest}:{kind}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if key is not None:
        head.append(f"X-Key: {key}")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body += b"Content-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        body += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {refers_to}"]
    head += [
        "WARC-Block-Digest: sha256:" + hashlib.sha256(body).hexdigest(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class _Writer:
    """Files of one shard; one is open at a time, and records are not held back."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, roll: int):
        self.fs, self.folder, self.shard, self.roll = fs, folder, shard, roll
        self.number, self.out = 0, None

    def write(self, key: int | None, data: bytes) -> Iterator[dict]:
        if self.out is None:
            self.name = f"{self.shard:06d}-{self.number:06d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary/{uuid.uuid4().hex}-{self.name}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size = self.count = 0
            self.digest = hashlib.sha256()
            self.first = key
        data = member(data)
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.count += 1
        self.last = key
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> dict:
        self.out.close()
        self.out = None
        self.number += 1
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        return {
            "file": self.name, "shard": self.shard, "records": self.count, "bytes": self.size,
            "sha256": self.digest.hexdigest(), "first": self.first, "last": self.last,
        }


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", roll: int = ROLL,
) -> DataFrame:
    """Writes the archives of ``pages`` below ``folder``; returns the manifest as a table.

    Of rows with equal payloads of ``SMALLEST`` bytes or more that with the least id is a
    response and the others revisit it; of rows equal in id and payload the first is the
    response. A null payload is empty; a null url is left out; a row with a null id is
    never referred to, and responds itself if no equal payload has an id. An empty table
    gives an empty manifest. Other columns are not read. ``folder`` must be one that all
    executors share.
    """
    shard, shards = _shards(pages, id_col, payload_col)
    rows = records(pages, id_col, url_col, payload_col).withColumn("shard", shard)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(f"{base}/_temporary", recursive=True)
        writer, before, done = None, None, []
        for batch in sliced(batches, 64):
            for row in batch.to_pylist():
                if writer is None or writer.shard != row["shard"]:
                    if writer and writer.out:
                        done.append(writer.close())
                    writer, before = _Writer(fs, base, row["shard"], roll), None
                key, first, same = row["id"], row["first"], (row["id"], row["digest"])
                revisit = first is not None and (key != first or same == before)
                before = same
                data = record(
                    "revisit" if revisit else "response", key, row["url"], row["payload"], row["digest"],
                    first if revisit else None,
                )
                done += writer.write(key, data)
        if writer and writer.out:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([
                ("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()),
                ("sha256", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
            ]))

    # A shard goes to the task of its number; there rows are in the order of the archive.
    manifest = (
        rows.repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "id", "digest", "url")
        .mapInArrow(run, "file string, shard int, records long, bytes long, sha256 string, first long, last long")
    )
    path = f"{folder}/{MANIFEST}"
    manifest.write.parquet(path)
    return pages.sparkSession.read.schema(manifest.schema).parquet(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of an archive."""
    at, view = 0, memoryview(content)
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            piece = view[at : at + 65536]
            parts.append(inflate.decompress(piece))
            at += len(piece)
        at -= len(inflate.unused_data)
        data = b"".join(parts)
        head, _, after = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        body = after[:size]
        if lines[0] != "WARC/1.1" or after[size:] != b"\r\n\r\n" or len(body) != size:
            raise ValueError("not a WARC record")
        yield headers, body


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``id, url, type, refers_to, payload, payload_bytes, payload_digest`` of the records.

    Files are read by Spark, those of the manifest only, and digests are checked. A
    revisit's payload is null; its length and digest are those of the full payload.
    """
    manifest = spark.read.parquet(f"{folder}/{MANIFEST}").select("file", "sha256", "records")
    # An empty table has no files for a pattern to match.
    if manifest.isEmpty():
        return spark.createDataFrame([], _READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    wanted = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest, "file")

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            content = batch.column("content")[0].as_py()
            if hashlib.sha256(content).hexdigest() != batch.column("sha256")[0].as_py():
                raise ValueError(f"{batch.column('file')[0]} is not the file of the manifest")
            rows = []
            held = 0
            for headers, body in parse(content):
                rows.append(_row(headers, body))
                held += len(body)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return wanted.select("file", "content", "sha256").mapInArrow(run, _READ)


_READ = (
    "id long, url string, type string, refers_to long, payload binary, payload_bytes long, "
    "payload_digest string"
)
_ARROW = pa.schema([
    ("id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])


def _row(headers: dict[str, str], body: bytes) -> dict:
    if headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(body).hexdigest():
        raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
    http, _, payload = body.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']} has another payload than its digest")
    number = lambda name: int(headers[name]) if name in headers and headers[name] != "None" else None
    return {
        "id": number("X-Key"), "url": headers.get("WARC-Target-URI"), "type": headers["WARC-Type"],
        "refers_to": number("X-Refers-To-Key"), "payload": None if revisit else payload,
        "payload_bytes": size, "payload_digest": digest,
    }
