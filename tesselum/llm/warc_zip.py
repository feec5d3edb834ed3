"""WARC records in ZIP packages: written from rows, read back by ranges.

A package holds stored (uncompressed) members: WARC files below archive/, one gzip member per record (or none: plain .warc), and indexes below
indexes/. Those that `write` makes hold archive/data.warc.gz and indexes/index.cdxj. The reader opens a package at its end, parses
the end record, the ZIP64 locator and end record where there are such, and the central directory; finds where stored members begin from their
local headers; reads the indexes, CDXJ or CDX, plain or gzip; and deals ranges of whole records out to tasks, which read just those bytes. Of an archive
member that no index names, the records are found by one pass over it. Nothing is extracted, no
package is read by one task alone where it has indexes, and memory follows RANGE or the largest record. Encrypted members, packages in several parts and
compressed archive members are refused.

Packages lie below the shared folder, through pyarrow's file systems. A task writes under a name of its own attempt
and renames the file when it is whole, so that a lost or doubled task leaves nothing that is read.

Edge cases: a null payload is empty and a null id or target an empty header, read back as null; of rows equal in id and payload
each is a record, and all that bear the largest id of their payload are responses; payloads below MIN_REVISIT bytes are never revisits; an
empty table writes no package and reads no rows; columns other than id, target and payload are not archived. Of records that are neither
response nor revisit the whole block is the payload; a record without a digest gets that of its payload, a revisit without one null.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm.common import cut, remove, shared_dir, ship, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_REVISIT = 1000
#: A package is closed when its records reach so many bytes; a range ends with the record that reaches RANGE.
PACKAGE = 256 << 20
RANGE = 4 << 20
#: Revisits that are broadcast, at most: some 32 MB; more are joined by shuffle.
BROADCAST = 400_000
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


# ------------------------------------------------------------------ the ZIP reader


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int
    encrypted: bool = False


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def directory(f, size: int) -> list[Member]:
    """The members of the ZIP file in f, from its central directory; ZIP64 or not."""
    tail = _read(f, max(0, size - 65_557), min(size, 65_557))
    base = size - len(tail)
    at = tail.rfind(_EOCD)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_EOCD, 0, at)  # the same bytes inside the comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    disk, first = struct.unpack_from("<HH", tail, at + 4)
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start) or tail[max(0, at - 20) : at].startswith(_LOCATOR):
        sign, _, where, _ = struct.unpack("<4sIQI", _read(f, base + at - 20, 20))
        if sign == _LOCATOR:
            end = _read(f, where, 56)
            if end[:4] != _EOCD64:
                raise ValueError("the ZIP64 locator points at no end record")
            disk, first = struct.unpack_from("<II", end, 16)
            count, length, start = struct.unpack_from("<QQQ", end, 32)
    if disk or first:
        raise ValueError("a package in several parts can't be read")
    data, at, out = _read(f, start, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        flags = struct.unpack_from("<H", data, at + 8)[0]
        method, packed, size_ = struct.unpack_from("<H", data, at + 10)[0], *struct.unpack_from("<II", data, at + 20)
        n, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n].decode("utf-8", "replace")
        x, end = at + 46 + n, at + 46 + n + extra
        while x + 4 <= end:
            kind, k = struct.unpack_from("<HH", data, x)
            if kind == 1:  # ZIP64: only those fields that are all ones, in this order
                y = x + 4
                if size_ == 0xFFFFFFFF:
                    (size_,), y = struct.unpack_from("<Q", data, y), y + 8
                if packed == 0xFFFFFFFF:
                    (packed,), y = struct.unpack_from("<Q", data, y), y + 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack_from("<Q", data, y)
            x += 4 + k
        out.append(Member(name, method, size_, packed, header, bool(flags & 0x2041)))
        at = end + comment
    return out


def stored_at(f, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.encrypted:
        raise ValueError(f"{member.name} is encrypted")
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    head = _read(f, member.header, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"{member.name} has no local header where the directory says")
    n, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + extra


# ------------------------------------------------------------------ records


def _line(value) -> str:
    return "" if value is None else str(value).replace("\r", "").replace("\n", "")


def record(rid, target, payload: bytes, digest: bytes, refers_to) -> bytes:
    """One WARC/1.1 record: a response, or a revisit that leaves the payload out but keeps its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_line(rid)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(target)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes, bytes]:
    """The WARC headers, the HTTP headers (names in lower case), the block and the payload (what follows the HTTP headers) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    more = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:]))
    return fields, more, body, payload


def _urn(value: str | None) -> str | None:
    return (value or "").removeprefix("<urn:page:").removesuffix(">") or None


# ------------------------------------------------------------------ writing


class _Package:
    """A ZIP package in the making. The output only grows, as object stores want it."""

    def __init__(self, fs, folder: str):
        self.fs, self.final = fs, f"{folder}/{uuid.uuid4().hex}.zip"
        self.own = self.final + ".part"
        self.out = fs.open_output_stream(self.own)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(DATA, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, rid, data: bytes) -> None:
        made = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = made.compress(data) + made.flush()
        self.member.write(packed)
        self.index.append(f"- 19700101000000 {json.dumps({'offset': str(self.size), 'length': str(len(packed)), 'filename': DATA[8:], 'url': f'urn:page:{_line(rid)}'}, separators=(',', ':'))}\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            for start in range(0, len(self.index), 10_000):
                f.write("".join(self.index[start : start + 10_000]).encode())
        self.zip.close()
        self.out.close()
        self.fs.move(self.own, self.final)
        return self.final, self.size, len(self.index)


def _open(uri: str):
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def revisits(rows: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload a row with a larger id has too. rows: id, digest, size.

    The largest id per digest is found with partial aggregation; the join back is of keys only and its hot digests are split.
    """
    large = rows.where((F.col("size") >= least) & F.col("id").isNotNull()).select("id", "digest")
    top = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("low")).where(F.col("low") < F.col("refers_to")).drop("low")
    return large.join(top, "digest").where(F.col("id") < F.col("refers_to")).select("id", "digest", "refers_to").distinct()


def write(df: DataFrame, folder: str, *, id: str = "page_id", target: str = "url", payload: str = "html", package: int = PACKAGE) -> DataFrame:
    """Archive df in packages below folder (a URI that all executors reach); returns (path, bytes, records) of the packages, written once."""
    ship(df.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(target).cast("string").alias("target"), body.alias("payload"))
    keys = rows.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    again = cut(revisits(keys))
    # payloads stay where they are while the revisits are few; else, ids are distinct or nearly so, and the join deals out evenly whatever payloads are equal
    marked = rows.withColumn("digest", F.sha1("payload")).join(F.broadcast(again) if again.count() <= BROADCAST else again, ["id", "digest"], "left")
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        open_, done = None, []
        for b in batches:
            for rid, digest, target_, data, ref in zip(*(b.column(k) for k in ("id", "digest", "target", "payload", "refers_to")), strict=True):
                open_ = open_ or _Package(fs, root)
                open_.add(rid.as_py(), record(rid.as_py(), target_.as_py(), data.as_py(), bytes.fromhex(digest.as_py()), ref.as_py()))
                if open_.size >= package:
                    done, open_ = [*done, open_.close()], None
        if open_:
            done.append(open_.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return cut(marked.mapInArrow(run, "path string, bytes long, records long"))


# ------------------------------------------------------------------ reading


def ranges(packages: DataFrame, folder: str, size: int = RANGE) -> DataFrame:
    """(path, packed, start, offsets, lengths): runs of whole records of the packages, of about `size` bytes, from their directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for b in batches:
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                yield from _package_ranges(fs, path, size)

    ship(packages.sparkSession)
    return packages.select("path").mapInArrow(run, "path string, packed boolean, start long, offsets array<long>, lengths array<long>")


def _lines(f, at: int, left: int, packed: bool) -> Iterator[bytes]:
    """The lines of `left` bytes of f from `at`, gzip members or plain."""
    rest, unzip = b"", zlib.decompressobj(31)
    while left:
        part = _read(f, at, min(left, 1 << 20))
        if not part:
            raise ValueError("an index is cut short")
        at, left = at + len(part), left - len(part)
        if packed:
            raw, part = part, b""
            while raw:
                part += unzip.decompress(raw)
                raw = unzip.unused_data
                if raw or unzip.eof:
                    unzip = zlib.decompressobj(31)
        *lines, rest = (rest + part).split(b"\n")
        yield from lines
    yield rest


def _entries(f, at: int, size: int, packed: bool) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of each record that an index names: CDXJ lines (key, time, JSON), or CDX with a legend of field letters."""
    legend: list[str] = []
    for line in _lines(f, at, size, packed):
        text = line.decode("utf-8", "replace").strip()
        if text.startswith(("CDX ", "CDX\t")):
            legend = text.split()[1:]
        elif "{" in text:
            found = json.loads(text[text.index("{") :])
            if "offset" in found and "length" in found:
                yield found.get("filename", ""), int(found["offset"]), int(found["length"])
        elif legend and text:
            found = dict(zip(legend, text.split(), strict=False))
            if found.get("V", "-").isdigit() and found.get("S", "-").isdigit():
                yield found.get("g", ""), int(found["V"]), int(found["S"])
        elif text and not text.startswith("!") and len(text.split()) >= 11:  # the usual eleven fields
            parts = text.split()
            yield parts[10], int(parts[9]), int(parts[8])


def _scanned(f, at: int, size: int, packed: bool) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of an archive member that no index names: one pass, a gzip member or a plain record at a time."""
    done = 0
    if packed:
        unzip, start, read = zlib.decompressobj(31), 0, 0
        while read < size:
            raw = _read(f, at + read, min(1 << 20, size - read))
            read += len(raw)
            while raw:
                unzip.decompress(raw)
                raw = unzip.unused_data
                if unzip.eof:
                    done = read - len(raw)
                    yield start, done - start
                    start, unzip = done, zlib.decompressobj(31)
        return
    while done < size:
        head = b""
        while b"\r\n\r\n" not in head:
            part = _read(f, at + done + len(head), min(1 << 16, size - done - len(head)))
            if not part:
                if head.strip():
                    raise ValueError("a record's header is cut short")
                return
            head += part
        before, _, _ = head.partition(b"\r\n\r\n")
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in before.split(b"\r\n")[1:]))
        n = len(before) + 4 + int(fields[b"content-length"]) + 4
        yield done, n
        done += n


def _package_ranges(fs, path: str, size: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["path", "packed", "start", "offsets", "lengths"])

    def dealt(archive: Member, records: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        """Runs of records that follow each other closely; those of an index in another order begin new runs."""
        nonlocal out
        start, end, offsets, lengths = 0, 0, [], []
        base = base_of[archive.name]

        def close() -> None:
            out.append((path, archive.name.endswith(".gz"), base + start, offsets, lengths))

        for offset, n in records:
            if offset < 0 or n <= 0 or offset + n > archive.size:
                raise ValueError(f"{archive.name} has no {n} bytes at {offset}")
            if offsets and (offset < end or offset + n - start > 2 * size or end - start >= size):
                close()
                offsets, lengths = [], []
            start = start if offsets else offset
            offsets.append(offset - start)
            lengths.append(n)
            end = offset + n
            if len(out) >= 256:
                yield batch()
                out = []
        if offsets:
            close()

    with fs.open_input_file(path) as f:
        members = directory(f, f.size())
        archives = {m.name: m for m in members if m.name.endswith((".warc.gz", ".warc"))}
        base_of = {name: stored_at(f, m) for name, m in archives.items()}
        by_file = {name.rpartition("/")[2]: name for name in archives}
        named: set[str] = set()
        indexes = [m for m in members if m.name.lower().startswith("indexes/") and m.name.lower().removesuffix(".gz").endswith((".cdx", ".cdxj"))]
        # where there are both forms, they name the same records
        indexes = [m for m in indexes if ".cdxj" in m.name.lower()] or indexes
        for index in indexes:
            low = index.name.lower()
            now, wait = None, []
            # an index goes by archive or by url; a run ends where the archive changes
            for file, offset, n in _entries(f, stored_at(f, index), index.size, low.endswith(".gz")):
                name = by_file.get(file.rpartition("/")[2]) or (next(iter(archives)) if len(archives) == 1 and not file else None)
                if name is None:
                    raise ValueError(f"{index.name} names {file}, which the package hasn't")
                if name != now or len(wait) >= 10_000:
                    if wait:
                        yield from dealt(archives[now], iter(sorted(wait)))
                    now, wait = name, []
                named.add(name)
                wait.append((offset, n))
            if wait:
                yield from dealt(archives[now], iter(sorted(wait)))
        for name, m in archives.items():
            if name not in named:
                yield from dealt(m, _scanned(f, base_of[name], m.size, name.endswith(".gz")))
    yield batch()


def read(packages: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of packages (a column path): id, target, type, refers_to, payload_bytes, digest (hex SHA-1) and, if asked for, payload."""
    spark = packages.sparkSession
    dealt = ranges(packages, folder)
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for b in batches:
            for path, packed, start, offsets, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(path) as f:
                    yield _records(_read(f, start, offsets[-1] + lengths[-1]), packed, offsets, lengths, payloads)

    schema = "id string, target string, type string, refers_to string, payload_bytes long, digest string" + ", payload binary" * payloads
    return dealt.mapInArrow(run, schema)


def _digest(value: str | None) -> str | None:
    """A digest field's SHA-1 as hexadecimal, whether it is in base 32 or 16; None for another kind."""
    kind, _, said = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return said.lower() if len(said) == 40 else base64.b32decode(said.upper()).hex()


def _records(data: bytes, packed: bool, offsets: list[int], lengths: list[int], payloads: bool) -> pa.RecordBatch:
    rows = []
    for at, n in zip(offsets, lengths, strict=True):
        one = data[at : at + n]
        fields, http, block, payload = parse(zlib.decompress(one, 31) if packed else one)
        kind, said = fields.get("warc-type", ""), _digest(fields.get("warc-payload-digest"))
        if kind == "revisit":
            size, digest, payload = int(http["content-length"]) if "content-length" in http else None, said, None
        else:
            payload = payload if kind == "response" else block
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if said not in (None, digest) and kind == "response":
                raise ValueError(f"{fields.get('warc-record-id')}: the payload is not what its digest says")
        rows.append((_urn(fields.get("warc-record-id")), fields.get("warc-target-uri") or None, kind, _urn(fields.get("warc-refers-to")), size, digest, payload))
    names = ("id", "target", "type", "refers_to", "payload_bytes", "digest", "payload")[: 6 + payloads]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], list(names))


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    packages = write(table(spark, sf_dir, "pages"), folder)
    # kept, as the archives go
    rows = cut(read(packages, folder, payloads=False))
    remove(spark, folder)
    return rows.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"), F.col("target").alias("url"))


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
t AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN top > page_id THEN top END AS refers_to, url
FROM d LEFT JOIN t ON d.payload_digest = t.payload_digest AND payload_bytes >= 1000
"""
