"""WARC, index first: records are indexed where they are written, or by a scan of existing archives, and read by coalesced
ranges of sorted offsets."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import new_path, pruned, saved

FILE_BYTES = 64 << 20
#: Ranges no further apart than this are read as one, up to MOST_BYTES at a time.
GAP, MOST_BYTES = 64 << 10, 8 << 20
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id bigint, url string, digest string, file string, offset bigint, length bigint"
NAMES = ["page_id", "url", "digest", "file", "offset", "length"]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def record(page_id: int | None, url: str | None, html: bytes, digest: str) -> bytes:
    """One response record as a gzip member of its own."""
    block = HTTP + html
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{page_id}:{digest[:16]}>", f"WARC-Date: {DATE}"]
    if url is not None:  # the index has it exactly; a header can't hold control characters
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; lines that are none are passed over, folded ones belong to the line before."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def _unchunked(body: bytes) -> bytes:
    out, i = [], 0
    while (end := body.find(b"\r\n", i)) >= 0:
        try:
            n = int(body[i:end].split(b";")[0], 16)
        except ValueError:
            return body  # not chunked, whatever the header says
        if n == 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        i = end + 4 + n
    return b"".join(out)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of an uncompressed record: of HTTP messages the body, without chunks and
    content encoding (kept as it is where it can't be undone), of other records the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", len(rest)))]
    if not fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        return fields, block
    message, _, body = block.partition(b"\r\n\r\n")
    http = _fields(message)
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    for kind in reversed([x.strip().lower() for x in http.get("content-encoding", "").split(",") if x.strip()]):
        try:
            body = zlib.decompress(body, {"gzip": 31, "x-gzip": 31, "deflate": 47}[kind])
        except (KeyError, zlib.error):
            break
    return fields, body


def payload(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a stored record, compressed or not."""
    return parsed(zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member)


def members(stream, step: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record of an archive file, compressed record by record or not at all; `stream.read(n)`
    gives its bytes, and one record at a time is held."""
    at, data = 0, stream.read(step)
    while data:
        if data[:2] == b"\x1f\x8b":
            z, parts, size = zlib.decompressobj(31), [], 0
            while True:
                parts.append(z.decompress(data))
                size += len(data)
                if z.eof:
                    break
                data = stream.read(step)
                if not data:
                    raise ValueError(f"a record at {at} is cut off")
            size -= len(z.unused_data)
            data = z.unused_data or stream.read(step)
            raw = b"".join(parts)
        else:
            while b"\r\n\r\n" not in data and (more := stream.read(step)):
                data += more
            if not data.strip():
                return
            end = data.find(b"\r\n\r\n")
            if end < 0:
                raise ValueError(f"no record at {at}")
            size = end + 4 + int(_fields(data[:end]).get("content-length", 0)) + 4
            while len(data) < size and (more := stream.read(max(step, size - len(data)))):
                data += more
            raw, data = data[:size], data[size:] or stream.read(step)
            size = len(raw)
        if raw.strip():
            yield at, size, raw
        at += size


def index_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, digest, file, offset, length, type, date) of every record of existing archives, without a word kept of
    them: page_id is null, digest the SHA-256 of the payload (as `parsed`), url as the record's header has it. A file is one
    task, which holds one record at a time; the index is a written table, and `read_records` reads any selection of it."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for uri in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:/*", "file:///", uri))
                rows = []
                with store.open_input_stream(name, compression=None) as f:
                    for at, size, raw in members(f):
                        fields, body = parsed(raw)
                        uri_ = fields.get("warc-target-uri")
                        rows.append((None, uri_.strip("<>") if uri_ else None, hashlib.sha256(body).hexdigest(), name, at, size, fields.get("warc-type"), fields.get("warc-date")))
                        if len(rows) == 4096:
                            yield _index_rows(rows)
                            rows = []
                if rows:
                    yield _index_rows(rows)

    files = spark.read.format("binaryFile").load(path).select("path")  # no content is read
    count = max(1, files.count())
    return saved(files.repartition(min(count, 100_000)).mapInArrow(scan, INDEX + ", type string, date string"), "warc-index")


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [*KINDS, pa.string(), pa.string()], strict=True)], names=[*NAMES, "type", "date"])


def write_warc(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The index (page_id, url, digest, file, offset, length), as a written table, of WARC files that hold each row of
    pages(page_id, url, html).

    Rows with null html have no payload and become no record; page_id and url may be null. Each task attempt writes files
    under names of its own, which only its own index rows mention: an attempt that is lost or repeated leaves at
    most files that nothing refers to. Empty input gives an empty index.
    """
    base = pruned(pages, "page_id", "url", "html").where("html IS NOT NULL")
    folder = folder or new_path(pages.sparkSession, "warc")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    rows = []
                    part = b.slice(i, 256)
                    for page_id, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if out is None or at >= file_bytes:
                            if out:
                                out.close()
                            name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(name, compression=None)
                        data = html.encode("utf-8", "surrogatepass")
                        digest = hashlib.sha256(data).hexdigest()
                        member = record(page_id, url, data, digest)
                        out.write(member)
                        rows.append((page_id, url, digest, name, at, len(member)))
                        at += len(member)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)
        finally:
            if out:
                out.close()

    index = saved(base.mapInArrow(write, INDEX), "warc-index")
    index._lexweave_folder = folder
    return index


def first_captures(index: DataFrame) -> DataFrame:
    """Of the records with one digest, that of the least page_id (null first), then url: chosen without reading any."""
    w = Window.partitionBy("digest").orderBy(F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "file", "offset")
    return index.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = MOST_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(offset, length, members) of the reads that cover the places, which ascend by offset."""
    start = end = 0
    members: list[int] = []
    for i, (o, n) in enumerate(places):
        if members and (o - end > gap or o + n - start > most):
            yield start, end - start, members
            members = []
        if not members:
            start = end = o
        members.append(i)
        end = max(end, o + n)
    if members:
        yield start, end - start, members


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, digest, html) of the records that index rows (any selection of write_warc's) point at.

    Only index rows move: to their file and, within large files, their part of it; there they are sorted by offset, near
    ranges become one read, and each payload is held against its digest (a mismatch fails the task).
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        name, f = None, None
        try:
            for b in batches:
                page_id, url, digest, file, offset, length = (c.to_pylist() for c in b.columns[:6])
                cuts = [i for i in range(b.num_rows) if i == 0 or file[i] != file[i - 1]] + [b.num_rows]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    if file[x] != name:
                        if f:
                            f.close()
                        name, f = file[x], store.open_input_file(file[x])
                    for o, n, members in ranges(list(zip(offset[x:y], length[x:y], strict=True))):
                        data = f.read_at(n, o)
                        rows = []
                        for k in (x + m for m in members):
                            html = payload(data[offset[k] - o : offset[k] - o + length[k]])[1]
                            if hashlib.sha256(html).hexdigest() != digest[k]:
                                raise ValueError(f"{file[k]}@{offset[k]}: the payload isn't what the index says")
                            rows.append((page_id[k], url[k], digest[k], html.decode("utf-8", "surrogatepass")))
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), [*KINDS[:3], pa.string()], strict=True)], names=[*NAMES[:3], "html"])
        finally:
            if f:
                f.close()

    part = F.floor(F.col("offset") / (16 << 20))
    placed = index.select(*NAMES, part.alias("part")).repartition("file", "part").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, "page_id bigint, url string, digest string, html string")


def archive_and_read(pages: DataFrame, select: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(page_id, url, digest, html): pages written as WARC, then those records read back that `select` picks from the index
    (`first_captures` for one of each payload); by default all. Repeated rows are records of their own in the files.
    """
    index = write_warc(pages)
    return read_records(select(index) if select else index, index._lexweave_folder)


SQL = "SELECT page_id, url, sha256(html) AS digest, html FROM pages WHERE html IS NOT NULL"
