"""WARC archives as a chunked record table.

``write`` lays records out in archives below a folder that all executors share, one or more files a
task.  ``read`` streams them back as rows of record and chunk number: a payload of any size passes through
in chunks, each row carrying the bytes and the digest of everything up to it, so no task ever holds a
whole record.  Archives may be compressed, each record a gzip member of its own.

Of equal payloads of at least ``least`` bytes the record with the largest id is the response, the others
are revisits that refer to it; smaller payloads are all responses.

Defined cases: a null payload is empty; a null URL is left out; a null id is smaller than any other and
its record says so by an empty name.  Ids may be of any type that orders, with any characters.  Repeated rows with equal ids are all
responses if they have the largest id.  A long payload is written and read in chunks.  An empty table gives an
empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, identity, lookup, map_arrow, without

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = (
    "record_id string, chunk long, record_type string, target_uri string, refers_to string, data binary, "
    "bytes_so_far long, sha1_so_far string, last boolean, intact boolean"
)


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """``id, url, payload, size, sha1, record_type, refers_to`` per row.

    The verdicts are reached on ids and digests.  A revisit needs no payload, so its row comes from that narrow table; a response
    stays where it is read, and no payload is shuffled but for the few rows that two filters mistake for revisits.
    """
    payload = F.coalesce(payload_col, F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload.cast("binary")).alias("sha1"))
    rows = rows.withColumn("key", F.when(F.col("size") >= least, identity("id", F.col("sha1"))))
    narrow = checkpointed(rows.drop("payload"))
    groups = narrow.where("key is not null").groupBy("sha1").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = checkpointed(groups)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = lookup(narrow.where("key is not null"), groups, "sha1", "n", total, F.col("id")).where("n is not null")
    revisits = checkpointed(found.where(~F.col("id").eqNullSafe(F.col("first"))))
    responses = without(rows, revisits, "key", narrow)
    nothing = F.lit(None)
    return responses.select("id", "url", "payload", "size", "sha1", F.lit("response").alias("record_type"), nothing.cast(pages.schema[id_col].dataType).alias("refers_to")).unionByName(
        revisits.select("id", "url", nothing.cast("string").alias("payload"), "size", "sha1", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    )


#: The name of a record whose id is a string without characters; a missing id leaves the name after the prefix empty.
EMPTY = "<urn:x-empty-record>"


def _name(value) -> str:
    """A record's name: its id percent-encoded, so that no id ends a header line."""
    return EMPTY if value == "" else f"<urn:x-record:{'' if value is None else quote(str(value), safe='')}>"


def id_of(name: Column) -> Column:
    """The id, as text, that a record's name stands for; null for a missing one."""
    return F.when(name == EMPTY, "").otherwise(F.nullif(F.url_decode(F.regexp_extract(name, "^<urn:x-record:(.*)>$", 1)), F.lit("")))


def _header(kind: str, name: str, length: int, payload: int, sha1: str, url: str | None, refers: str | None, date: str) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers is not None:
        lines += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


class _Out:
    """An archive being written; ``record`` takes its parts one after another."""

    def __init__(self, fs: pafs.FileSystem, path: str, compress: bool):
        self.fs, self.path, self.compress, self.bytes, self.records = fs, path, compress, 0, 0
        self.stream = fs.open_output_stream(path + ".tmp")

    def record(self, parts: Iterator[bytes]) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31) if self.compress else None
        for p in parts:
            self._put(z.compress(p) if z else p)
        self._put(z.flush() if z else b"")
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.stream.close()
        self.fs.move(self.path + ".tmp", self.path)
        return self.path, self.records, self.bytes


def write(records: DataFrame, folder: str, chunk: int = 1 << 18, roll: int = 1 << 28, compress: bool = False, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes ``plan``'s rows as archives below ``folder``; one row per finished file: ``path, records, bytes``.

    A file counts only once its task has reported it, so a task that is run again leaves no double.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done, out = [], None
        for b in batches:
            for row in zip(*b.columns, strict=True):
                number, url, payload, n, sha1, kind, refers = (x.as_buffer() if i == 2 else x.as_py() for i, x in enumerate(row))
                if out is None:
                    out = _Out(fs, f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc{'.gz' * compress}", compress)
                again = kind == "revisit"
                head = _header(kind, _name(number), len(HTTP) + (0 if again else n), n, sha1, url, _name(refers) if again else None, date)

                def parts(head=head, payload=payload, n=n, again=again):
                    yield head
                    yield HTTP
                    for i in range(0, 0 if again else n, chunk):
                        yield payload.slice(i, min(chunk, n - i)).to_pybytes()
                    yield b"\r\n\r\n"

                out.record(parts())
                if out.bytes >= roll:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return map_arrow(records.select("id", "url", "payload", "size", "sha1", "record_type", "refers_to"), run, "path string, records long, bytes long")


def _records(stream: io.BufferedIOBase, chunk: int) -> Iterator[tuple]:
    """Chunk rows of one archive, as they pass by."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            while left:
                line = stream.readline()
                left -= len(line)
                if not line.strip():
                    break
        stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in fields else None
        name, kind = fields.get("warc-record-id"), fields.get("warc-type")
        head = (kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"))
        if kind == "revisit":
            yield name, 0, *head, b"", int(fields.get("x-payload-length", 0)), stated, True, None
            continue
        sha, so_far, k = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise EOFError(f"{name} ends after {so_far + len(data)} bytes")
            sha.update(data)
            so_far, left = so_far + len(data), left - len(data)
            digest = sha.hexdigest()
            yield name, k, *head, data, so_far, digest, not left, (stated in (None, digest)) if not left else None
            k += 1
            if not left:
                break


def read(files: DataFrame, folder: str, chunk: int = 1 << 18, batch: int = 64, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``files`` (column ``path``); see ``CHUNKS``.

    ``sha1_so_far`` covers the payload up to the chunk; in the last chunk it is the record's digest and
    ``intact`` says whether the header states the same.  A revisit is one row with no data and the stated
    digest and length.  ``with_data=False`` leaves the bytes out of the rows.
    """

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("record_id", pa.string()), ("chunk", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()), ("intact", pa.bool_())])

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                    stream = io.BufferedReader(raw, 1 << 18)
                    held = []
                    for row in _records(gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream, chunk):
                        held.append(row if with_data else (*row[:5], None, *row[6:]))
                        if len(held) >= batch:
                            yield out(held)
                            held = []
                    if held:
                        yield out(held)

    return map_arrow(files.select("path"), run, CHUNKS)
