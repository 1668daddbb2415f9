"""WARC archives: a monolithic-gzip normaliser with a sidecar offset index.

Three steps, each with its results in the shared folder:

1. every task writes its pages as one WARC file that is a single gzip stream;
2. the normaliser inflates each such stream once, front to back, writes every
   record as a gzip member of its own (repeated payloads as revisit records)
   and a sidecar file with the offset and length of each member;
3. readers use the sidecar: each member is read and inflated by itself.

Payloads never pass through a shuffle: what decides between response and
revisit is digests and ids only.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from .common import materialise, scratch

CRLF = b"\r\n"
CHUNK = 1 << 20
GZIP = 16 + zlib.MAX_WBITS
LEVEL = 3
DATE = datetime(2020, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
#: Payloads below this many bytes are always stored.
MIN_REVISIT = 100


def record_id(page_id: int | None, part: int, place: int) -> str:
    """The page's id, and the place of the record among those written, which no other record has."""
    return f"<urn:page:{'' if page_id is None else page_id}:{part}:{place}>"


def record(kind: str, name: str, url: str | None, digest: str, size: int, payload: bytes, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP head, with the length of the full payload, and no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8") + CRLF + CRLF + block + CRLF + CRLF


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").partition(":")[0]
    return int(digits) if digits else None


def parse(data: bytes | bytearray | memoryview) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one whole record."""
    data = bytes(data)
    end = data.index(b"\r\n\r\n")
    headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[:end].decode("utf-8").split("\r\n")[1:]))
    return headers, data[end + 4 : end + 4 + int(headers["content-length"])]


def payload_of(block: bytes) -> tuple[int, bytes]:
    """Length that the HTTP head tells, and the payload that follows it."""
    end = block.index(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in block[:end].split(CRLF) if x.lower().startswith(b"content-length:"))
    return size, block[end + 4 :]


def _put(store: fs.FileSystem, path: str, write) -> None:
    """Write under a name of this attempt, then rename: a lost task leaves no half file under the final name."""
    attempt = f"{path}.{TaskContext.get().taskAttemptId()}.part"
    with store.open_output_stream(attempt, compression=None) as out:
        write(out)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(attempt, path)


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One single-stream .warc.gz per non-empty task; rows: path, page_id, size, digest, record (its id)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    schema = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("record", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"{root}/pages-{number:06d}.warc.gz"
        seen: list[tuple[int | None, int, str, str]] = []

        def write(out) -> None:
            z = zlib.compressobj(1, zlib.DEFLATED, GZIP)
            for batch in batches:
                for page, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                    digest = hashlib.sha256(body).hexdigest()
                    own = record_id(page, number, len(seen))
                    out.write(z.compress(record("response", own, url, digest, len(body), body)))
                    seen.append((page, len(body), digest, own))
            out.write(z.flush())

        first = next(iter(batches), None)
        if first is None:
            return
        batches = _chain(first, batches)
        _put(store, name, write)
        for i in range(0, len(seen), 10_000):
            part = seen[i : i + 10_000]
            yield pa.record_batch([pa.array([name] * len(part)), *map(pa.array, map(list, zip(*part)), schema.types[1:])], schema=schema)

    return rows.mapInArrow(task, "path string, page_id long, size long, digest string, record string")


def _chain(first, rest):
    yield first
    yield from rest


def _records(stream) -> Iterator[bytes]:
    """Whole records from one gzip stream, inflated once in chunks."""
    z = zlib.decompressobj(GZIP)
    held = bytearray()
    need = None
    while True:
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x.partition(b":")[2]) for x in bytes(held[:end]).split(CRLF) if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
        chunk = stream.read(CHUNK)
        if not chunk:
            held += z.flush()
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        held += z.decompress(chunk)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """files: path, revisits (array of record, refers_to).  One row per file: path of the archive and of its sidecar."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for frame in frames:
            for path, revisits in zip(frame["path"], frame["revisits"]):
                to = {x["record"]: x["refers_to"] for x in revisits}
                name = f"{root}/{os.path.basename(path)}"
                lines = []

                def write(out, path=path, to=to, lines=lines) -> None:
                    at = 0
                    with store.open_input_stream(path, compression=None) as stream:
                        for raw in _records(stream):
                            headers, block = parse(raw)
                            own = headers["warc-record-id"]
                            if own in to:
                                raw = record("revisit", own, headers.get("warc-target-uri"), headers["warc-payload-digest"].removeprefix("sha256:"), payload_of(block)[0], b"", to[own])
                            z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                            member = z.compress(raw) + z.flush()
                            out.write(member)
                            lines.append(f"{at} {len(member)} {own}\n")
                            at += len(member)

                _put(store, name, write)
                _put(store, name + ".idx", lambda out, lines=lines: out.write("".join(lines).encode()))
                yield pd.DataFrame({"path": [name], "index": [name + ".idx"], "records": [len(lines)]})

    return files.mapInPandas(task, "path string, index string, records long")


def read_back(archives: DataFrame, folder: str) -> DataFrame:
    """Every record by its sidecar entry; stored payloads are hashed again and held against their digest."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for path, index in zip(frame["path"], frame["index"]):
                with store.open_input_stream(index, compression=None) as f:
                    entries = [x.split(" ") for x in f.read().decode().splitlines()]
                rows = []
                with store.open_input_file(path) as f:
                    for offset, length, _ in entries:
                        f.seek(int(offset))
                        headers, block = parse(zlib.decompress(f.read(int(length)), GZIP))
                        size, payload = payload_of(block)
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        kind = headers["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path} at {offset}: the payload differs from its digest")
                        rows.append((_page(headers["warc-record-id"]), size, digest, kind, _page(headers.get("warc-refers-to")), path, int(offset), int(length)))
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    return archives.mapInPandas(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, normalise and read back; one row per page.

    Null html is an empty payload.  Of equal payloads of at least MIN_REVISIT
    bytes the smallest page_id is the response; repeated rows of that page_id
    with that payload are responses too.  A page_id that stands again with another
    payload is judged by that payload.  A null page_id never becomes a revisit.  An empty table
    gives no files and no rows.
    """
    folder = scratch(pages.sparkSession, "warc")
    written = materialise(write_monolithic(pages, f"{folder}/monolithic", id_col, url_col, html_col), "warc-written")
    large = written.where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.min(F.struct("page_id", "record")).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = large.join(first.select("digest", "first"), "digest").where("page_id > first.page_id")
    # a file's revisits are no more than its records, which one task wrote
    revisits = repeats.groupBy("path").agg(F.collect_list(F.struct("record", F.col("first.record").alias("refers_to"))).alias("revisits"))
    files = written.select("path").distinct().join(revisits, "path", "left").withColumn("revisits", F.coalesce("revisits", F.array().cast("array<struct<record:string,refers_to:string>>")))
    parts = max(1, files.count())
    archives = materialise(normalise(files.repartition(parts, "path"), f"{folder}/archives"), "warc-archives")
    return read_back(archives.repartition(parts, "path"), folder)
