"""WARC archives and a two-level index of their captures.

Each task writes an archive of its own, every record a gzip member.  The index holds a line per
capture, sorted by the URL's reversed-host key, in compressed blocks of BLOCK lines; an index file
ends with its sparse directory, the first key and the place of each block.  A look-up searches
the list of index files, then a directory, by bisection, reads one block and then the record's range.

Files are written under names of their own and only a task that ends well reports them, so a
repeated task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, pieces, written

BLOCK = 256
DATE = "2024-01-01T00:00:00Z"
_LINE = "\x1f"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def reversed_host_key(url: str | None) -> str:
    """https://blog.a.com:443/x?y#z -> com,a,blog)/x?y; what isn't a URL with a host stays as it is, null is empty.

    The characters that part an index's lines and their fields are percent-encoded, so keys sort and meet as they are written.
    """
    return re.sub(r"[\n\x1f]", lambda m: quote(m[0]), _raw_key(url))


def _raw_key(url: str | None) -> str:
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        host = f"{host}:{port}"
    name, _, number = host.partition(":")
    key = ",".join(reversed(name.split("."))) + (f":{number}" if number else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, page_id, url: str | None, digest: str, payload: bytes, refers_to=None) -> bytes:
    """A WARC/1.1 response, or a revisit that has the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """What a record holds: page_id, kind, refers_to, digest, payload_bytes, payload (None for a revisit)."""
    head, block = raw.split(b"\r\n\r\n", 1)
    named = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(named["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: None if x is None or (n := x[len("<urn:page:") : -1]) == "None" else int(n)
    digest = named["WARC-Payload-Digest"].partition(":")[2]
    if (kind := named["WARC-Type"]) == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {named['WARC-Record-ID']} isn't what was written")
    return {"page_id": number(named["WARC-Record-ID"]), "kind": kind, "refers_to": number(named.get("WARC-Refers-To")), "digest": digest, "payload_bytes": size, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, path: str, least_revisit: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC records; returns the captures: key, page_id, file, offset, length.

    Of records with equal payloads of at least least_revisit bytes the one with the largest page_id is
    the response and the others revisit it.  A null html is an empty payload, a null url has the key "",
    a null page_id revisits if another row has its payload, repeated rows are a record each.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("html"))).withColumn("sha256", F.unhex(F.sha2("html", 256)))  # the first names a payload, the second tells it from others
    same = rows.where(F.length("html") >= least_revisit).groupBy("sha256").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("sha256", "last")
    ready = rows.join(written(same, "payloads"), "sha256", "left")
    fs, top = store(path)
    fs.create_dir(top, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = store(path)
        out, at, file = None, 0, ""
        for batch in pieces(batches, "html"):
            made = []
            for r in batch.to_pylist():
                if out is None or at > 1 << 30:
                    if out:
                        out.close()
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{top}/{file}", compression=None)
                    info = b"software: basalt\r\nformat: WARC File Format 1.1\r\n"
                    at = out.write(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{file}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                revisit = r["last"] is not None and r["last"] != r["page_id"] and len(r["html"]) >= least_revisit
                digest = base64.b32encode(r["sha1"]).decode()
                raw = _member(record("revisit" if revisit else "response", r["page_id"], r["url"], digest, r["html"], r["last"] if revisit else None))
                out.write(raw)
                made.append((reversed_host_key(r["url"]), r["page_id"], file, at, len(raw)))
                at += len(raw)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    return written(ready.mapInArrow(write, "key string, page_id long, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, path: str) -> list[tuple[str, str, str]]:
    """Write the captures' index; the list of its files with their first and last keys comes back, one entry a file."""
    n = partitions(captures.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = store(path)
        lines: list[str] = []
        out, at, directory, last, file = None, 0, [], "", f"{uuid.uuid4().hex}.cdx"

        def flush():
            nonlocal out, at, lines, last
            out = out or fs.open_output_stream(f"{top}/{file}", compression=None)
            raw = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            out.write(raw)
            directory.append((lines[0].split(_LINE)[0], at, len(raw)))
            last = lines[-1].split(_LINE)[0]
            at, lines = at + len(raw), []

        for batch in batches:
            for r in batch.to_pylist():
                lines.append(_LINE.join((r["key"], r["file"], str(r["offset"]), str(r["length"]))))
                if len(lines) == BLOCK:
                    flush()
        if lines:
            flush()
        if out:
            raw = zlib.compress(json.dumps(directory).encode())
            out.write(raw + at.to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "last": [last], "file": [file]})

    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return sorted(tuple(r) for r in ordered.mapInArrow(write, "first string, last string, file string").collect())


class Index:
    """Look-ups by key: at most two bisections, then one block for each BLOCK captures of the key."""

    def __init__(self, path: str, files: list[tuple[str, str, str]]):
        self.fs, self.top = store(path)
        self.files, self.lasts = files, [f[1] for f in files]
        self.kept: OrderedDict = OrderedDict()

    def _once(self, key, make: Callable, most: int = 64):
        if key not in self.kept:
            self.kept[key] = make()
            if len(self.kept) > most:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]

    def _open(self, file: str):
        return self._once(("open", file), lambda: self.fs.open_input_file(f"{self.top}/{file}"))

    def _directory(self, file: str):
        def read():
            f = self._open(file)
            size = f.size()
            at = int.from_bytes(f.read_at(8, size - 8), "little")
            return [tuple(x) for x in json.loads(zlib.decompress(f.read_at(size - 8 - at, at)))]

        return self._once(("directory", file), read)

    def _block(self, file: str, at: int, size: int):
        return self._once((file, at), lambda: [x.split(_LINE) for x in zlib.decompress(self._open(file).read_at(size, at)).decode("utf-8", "surrogatepass").split("\n")])

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Index file, offset and size of each block that may hold captures of a key."""
        k = bisect_left(self.lasts, key)
        while k < len(self.files) and self.files[k][0] <= key:
            directory = self._directory(self.files[k][2])
            b = max(0, bisect_left(directory, (key,)) - 1)
            while b < len(directory) and directory[b][0] <= key:
                yield self.files[k][2], *directory[b][1:]
                b += 1
            k += 1

    def in_block(self, key: str, file: str, at: int, size: int) -> Iterator[tuple[str, int, int]]:
        """file, offset and length of each capture of a key in a block."""
        block = self._block(file, at, size)
        i = bisect_left(block, [key])
        while i < len(block) and block[i][0] == key:
            yield block[i][1], int(block[i][2]), int(block[i][3])
            i += 1

    def captures(self, key: str) -> Iterator[tuple[str, int, int]]:
        """file, offset and length of each capture of a key."""
        for block in self.blocks(key):
            yield from self.in_block(key, *block)

    def read(self, file: str, offset: int, length: int) -> dict:
        return parse_record(zlib.decompress(self._open(file).read_at(length, offset), 31))


def read_pages(spark: SparkSession, urls: DataFrame, path: str, files: list[tuple[str, str, str]], keep_payload: bool = False) -> DataFrame:
    """All captures of the distinct keys of urls (url), each read by its range.

    Keys find their blocks of the index first; it is these that are dealt out, so a key that a third of all pages have is read by many tasks.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([reversed_host_key(u) for u in batch.column("url").to_pylist()], pa.string())})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, made = Index(path, files), []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "at", "size"])
        for batch in batches:
            for key in batch.column("key").to_pylist():
                for block in index.blocks(key):
                    made.append((key, *block))
                    if len(made) == 10_000:
                        yield out()
                        made = []
        if made:
            yield out()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(path, files)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        width = 5 + keep_payload

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=False)], names[:width])

        found, size = [], 0
        for batch in batches:
            for key, *block in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "at", "size")), strict=True):
                for place in index.in_block(key, *block):
                    r = index.read(*place)
                    found.append((r["page_id"], r["payload_bytes"], r["digest"], r["kind"], r["refers_to"], r["payload"])[:width])
                    size += 200 + len(r["payload"] or b"") * keep_payload
                    if size > 4 << 20:
                        yield out(found)
                        found, size = [], 0
        if found:
            yield out(found)

    wanted = written(urls.select(F.col("url").cast("string")).mapInArrow(keys, "key string").distinct(), "keys")
    blocks = wanted.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(find, "key string, file string, at long, size long")
    return blocks.repartition(partitions(spark), "file", "at").sortWithinPartitions("file", "at", "key").mapInArrow(read, schema)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, (i // 8) * 10 + 1, 10))::UBIGINT) >> (35 - 5 * (i % 8))::UBIGINT) & 31::UBIGINT)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
