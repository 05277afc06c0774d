"""WARC archives of web pages and their two-level capture index.

Archives: one gzip member per record, a file per task and FILE_BYTES, in the shared folder. Of records with equal
payloads the one with the smallest page_id is a response, the others are revisit records without payload.
Index: captures sorted by key (the URL with its host reversed, then the page id) are cut into compressed blocks of
BLOCK captures; each index file ends with a sparse directory of its blocks (first key, offset, length), and a short list
of files (first key, path) stands above. A lookup searches both by bisection, reads one block by its range, searches it,
and reads the record by its range.

Null html counts as empty; null urls as "". A page without id is the response of its payload only where no page with an
id has it. Rows repeated with their id are a record each, of the same type. Other columns are not read. Lookups of keys
that the index lacks give no row. No pages: no archives, no index, no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import shared_dir, slices, written

FILE_BYTES, BLOCK, MEMBER_LEVEL = 256 << 20, 512, 3
#: Archives and index files that a task holds open at once.
OPEN_FILES = 16
#: Fixed value: the profile that the standard names for revisits of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def reversed_url(url: str | None) -> str:
    """com,example,sub)/path?query for http://www.sub.example.com:80/path?query#part; other texts stay as they are."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    numeric = ":" in host or host.replace(".", "").isdigit()
    port_text = f":{port}" if port and port not in (80, 443) else ""
    return f"{host if numeric else ','.join(reversed(host.split('.')))}{port_text}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    clean = "".join(f"%{ord(c):02X}" if c <= " " else c for c in reversed_url(url))
    return f"{clean} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, revisit: bool, first: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date,
        "WARC-Target-URI": "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url or ""), "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block), "X-Payload-Length": n,
    }
    head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first, digest), "X-Refers-To-Page": first} if revisit else {}
    head |= {} if page_id is None else {"X-Page-ID": page_id}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of RECORD from a record; the payload's digest and length are taken anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    revisit, said = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    digest = said if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != said:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {"page_id": None if page is None else int(page), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload), "refers_to": int(first) if revisit else None, "payload": payload}


@dataclass(frozen=True)
class Index:
    """root: URI of the folder; files: (first key, path) of the index files in key order, one for each task that wrote."""

    root: str
    files: tuple[tuple[bytes, str], ...]


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), n, digest (hex), revisit, first."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    first = full.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = full.join(first.hint("merge"), "digest", "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n", "digest", revisit.alias("revisit"), "first")


def write(pages: DataFrame, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> Index:
    """Writes archives and index of pages (page_id, url, html) into a new folder of the shared one."""
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        out, name, at = None, "", 0
        try:
            for part in slices(batches, 2):
                rows = part.to_pylist()
                captures = []
                for r in rows:
                    if out is None or at >= FILE_BYTES:
                        if out:
                            out.close()
                        fs.create_dir(f"{base}/archive", recursive=True)
                        name, at = f"archive/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                    member = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
                    raw = record(r["page_id"], r["url"], r["payload"], r["n"], base32(r["digest"]), r["revisit"], r["first"], date)
                    packed = member.compress(raw) + member.flush()
                    out.write(packed)
                    captures.append((capture_key(r["url"], r["page_id"]), name, at, len(packed)))
                    at += len(packed)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*captures, strict=True)], ["key", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    captures = written(records(pages, min_bytes).mapInArrow(archive, "key string, file string, offset long, length long"), "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        entries: list[tuple] = []
        directory: list[tuple[bytes, int, int]] = []
        out, name, at = None, f"index/{uuid.uuid4().hex}.idx", 0

        def put() -> None:
            nonlocal out, at
            if out is None:
                fs.create_dir(f"{base}/index", recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            block = zlib.compress("\n".join("\t".join(map(str, e)) for e in entries).encode())
            out.write(block)
            directory.append((entries[0][0].encode(), at, len(block)))
            at += len(block)
            entries.clear()

        for batch in batches:
            for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries.append(e)
                if len(entries) == BLOCK:
                    put()
        if entries:
            put()
        if out:
            footer = zlib.compress(b"\n".join(b"%b\t%d\t%d" % d for d in directory))
            out.write(footer + struct.pack("<Q", len(footer)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]], pa.binary()), pa.array([name])], ["first", "path"])

    files = captures.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(index, "first binary, path string").collect()
    return Index(root, tuple(sorted((bytes(f[0]), f[1]) for f in files)))


class Reader:
    """Lookups in an index: bisection in the file list, in a file's directory and in a block, then range reads."""

    def __init__(self, index: Index):
        self.index, self.first = index, [f for f, _ in index.files]
        self.fs, self.base = pafs.FileSystem.from_uri(index.root)
        self.open: OrderedDict[str, object] = OrderedDict()
        self.directory: tuple[int, list[bytes], list[tuple[int, int]]] = (-1, [], [])
        self.block: tuple[int, int, list[bytes], list[bytes]] = (-1, -1, [], [])

    def close(self) -> None:
        while self.open:
            self.open.popitem()[1].close()

    def handle(self, path: str):
        if path not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)[1].close()
            self.open[path] = self.fs.open_input_file(f"{self.base}/{path}")
        self.open.move_to_end(path)
        return self.open[path]

    def blocks(self, k: int) -> tuple[list[bytes], list[tuple[int, int]]]:
        if self.directory[0] != k:
            f = self.handle(self.index.files[k][1])
            size = f.size()
            (n,) = struct.unpack("<Q", f.read_at(8, size - 8))
            rows = [x.split(b"\t") for x in zlib.decompress(f.read_at(n, size - 8 - n)).split(b"\n")]
            self.directory = (k, [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows])
        return self.directory[1:]

    def entries(self, k: int, b: int) -> tuple[list[bytes], list[bytes]]:
        if self.block[:2] != (k, b):
            offset, length = self.blocks(k)[1][b]
            rows = zlib.decompress(self.handle(self.index.files[k][1]).read_at(length, offset)).split(b"\n")
            self.block = (k, b, [r[: r.index(b"\t")] for r in rows], rows)
        return self.block[2:]

    def find(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of every capture with the key; equal keys may go on in the next block or file."""
        k = max(0, bisect.bisect_left(self.first, key) - 1)
        for k in range(k, len(self.first)):
            if self.first[k] > key:
                return
            firsts = self.blocks(k)[0]
            for b in range(max(0, bisect.bisect_left(firsts, key) - 1), len(firsts)):
                if firsts[b] > key:
                    return
                keys, rows = self.entries(k, b)
                for i in range(bisect.bisect_left(keys, key), len(keys)):
                    if keys[i] != key:
                        return
                    _, name, offset, length = rows[i].split(b"\t")
                    yield name.decode(), int(offset), int(length)

    def read(self, capture: tuple[str, int, int]) -> dict:
        name, offset, length = capture
        return parsed(zlib.decompress(self.handle(name).read_at(length, offset), 31))


def read(wanted: DataFrame, index: Index, payload: bool = False) -> DataFrame:
    """The records (RECORD, payload null unless asked for) of the captures whose url and page_id are wanted."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        with closing(Reader(index)) as reader:
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    for capture in reader.find(key.encode()):
                        r = reader.read(capture)
                        size += len(r["payload"] or b"") if payload else 100
                        rows.append(r if payload else r | {"payload": None})
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    asked = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(keys, "key string").distinct()
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # keys are short, what they lead to is not: left to itself, AQE would put them in one task
    return asked.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, RECORD)
