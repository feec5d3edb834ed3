"""Cell files: a tagged text form and a binary form in blocked gzip, read and written through Spark.

Text: header lines that begin with "@", then tab-separated records. Binary: magic, version, layout flags, the same header text, type
codes, records, end marker; little-endian; as blocks of at most 65,280 bytes, each a gzip member that tells its length,
closed by an empty block. A file is one sample's or slide's; folders of files are written and read in parallel, a file per task, record by record:
memory doesn't follow the file.
"""

from __future__ import annotations

import io
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum import model
from tesselum.functions.lineage import cut, ship
from tesselum.sources.csv_cells import schema

# Fixed values of the format.
MAGIC = b"CYF\x01"
END = b"CYF\x01EOF\x00"
VERSION = 1
ROOMY = 1
PAD = 65_536
BLOCK = 65_280
EMPTY_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_STRUCT = {"i": "<i", "I": "<I", "l": "<q", "L": "<Q", "f": "<f", "d": "<d", "A": "<I"}
_WIDE = {"i": "<i4", "I": "<u4", "l": "<i8", "L": "<u8", "f": "<f4", "d": "<f8"}

Record = tuple  # id, x, y, cflag, pflag, then a value per data column


class Truncated(ValueError):
    pass


# ------------------------------------------------------------------ blocked gzip


def blocks(data: bytes, level: int = 6) -> bytes:
    """data as gzip members with their lengths in an extra field; without the empty block."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def block_offsets(data: bytes) -> list[tuple[int, int]]:
    """(start, length) of each block."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04" or at + 18 > len(data):
            raise Truncated("no block begins here")
        (size,) = struct.unpack_from("<H", data, at + 16)
        out.append((at, size + 1))
        at += size + 1
    if at > len(data):
        raise Truncated("the last block is cut short")
    return out


def unblock(data: bytes) -> bytes:
    return b"".join(zlib.decompress(data[a + 18 : a + n - 8], -15) for a, n in block_offsets(data))


# ------------------------------------------------------------------ values


def _u64(v: int) -> int:
    return v & 0xFFFFFFFFFFFFFFFF


def _s64(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _codes(header: model.Header) -> list[str]:
    return [t.fields.get("TY", "f") for t in header.data]


def _pack(code: str, value) -> bytes:
    if code == "Z":
        raw = (value or "").encode()
        return struct.pack("<I", len(raw)) + raw
    if code == "B":
        a = np.asarray(value if value is not None else [], dtype="<i8")
        return b"l" + struct.pack("<I", len(a)) + a.tobytes()
    if code in "fd":
        return struct.pack(_STRUCT[code], math.nan if value is None else value)
    v = int(value or 0)
    return struct.pack(_STRUCT[code], _u64(v) if code == "L" else v & 0xFFFFFFFF if code in "IA" else v)


def _unpack(code: str, data: bytes, at: int):
    if code == "Z":
        (n,) = struct.unpack_from("<I", data, at)
        if at + 4 + n > len(data):
            raise IndexError("the text is cut short")
        return bytes(data[at + 4 : at + 4 + n]).decode(), at + 4 + n
    if code == "B":
        kind, (n,) = chr(data[at]), struct.unpack_from("<I", data, at + 1)
        a = np.frombuffer(data, _WIDE[kind], n, at + 5)
        return [int(v) for v in a], at + 5 + a.nbytes
    (v,) = struct.unpack_from(_STRUCT[code], data, at)
    return (_s64(v) if code == "L" else v), at + struct.calcsize(_STRUCT[code])


def shortest(value: float) -> str:
    """The shortest decimal that gives the same 32-bit float again."""
    return np.format_float_positional(np.float32(value), unique=True, trim="-") if math.isfinite(value) else str(value)


# ------------------------------------------------------------------ whole files


def _text_record(codes: list[str], record: Record) -> bytes:
    id_, x, y, c, p, *data = record
    cells = [str(_u64(id_)), shortest(x), shortest(y), str(_u64(c)), str(_u64(p))]
    for code, v in zip(codes, data, strict=True):
        if code == "f":
            cells.append(shortest(math.nan if v is None else v))
        elif code == "d":
            cells.append(repr(float(math.nan if v is None else v)))
        elif code == "Z":
            cells.append(model.escape(v or ""))
        elif code == "B":
            cells.append("l:" + ",".join(map(str, v)) if v is not None and len(v) else "")
        else:
            cells.append(str(_u64(int(v or 0)) if code == "L" else int(v or 0)))
    return ("\t".join(cells) + "\n").encode()


def to_text(header: model.Header, rows: Iterable[Record]) -> bytes:
    codes = _codes(header)
    return header.text().encode() + b"".join(_text_record(codes, r) for r in rows)


def _parse(code: str, s: str, levels: dict[str, int]):
    if code in "fd":
        return float(s)
    if code == "Z":
        return model.unescape(s)
    if code == "B":
        return [int(float(v)) for v in s.partition(":")[2].split(",")] if s else []
    if code == "A" and s in levels:
        return levels[s]
    return _s64(int(s)) if code == "L" else int(s)


def from_text(data: bytes) -> tuple[model.Header, Iterator[Record]]:
    text = data.decode()
    header = model.Header.parse(text)
    codes = _codes(header)
    levels = [{v: i for i, v in enumerate(t.fields.get("LV", "").split(","))} if t.fields.get("TY") == "A" and not t.fields.get("LV", "0").replace(",", "").isdigit() else {} for t in header.data]

    def rows() -> Iterator[Record]:
        for line in text.split("\n"):
            if line and not line.startswith("@"):
                f = line.split("\t")
                if len(f) != 5 + len(codes):
                    raise ValueError(f"a record has {len(f)} fields, not {5 + len(codes)}")
                yield (_s64(int(f[0])), float(f[1]), float(f[2]), _s64(int(f[3], 0)), _s64(int(f[4], 0)), *(_parse(c, s, lv) for c, s, lv in zip(codes, f[5:], levels, strict=True)))

    return header, rows()


def preamble(header: model.Header, capacity: int = 0) -> bytes:
    text = header.text().encode()
    size = max(-(-len(text) // PAD) * PAD, capacity)
    text += b"#" * (size - len(text)) if size - len(text) else b""
    codes = "".join(_codes(header)).encode()
    return MAGIC + struct.pack("<HHI", VERSION, ROOMY, len(text)) + text + struct.pack("<I", len(codes)) + codes


def _binary_record(codes: list[str], record: Record) -> bytes:
    id_, x, y, c, p, *data = record
    if struct.pack("<Q", _u64(id_)) == END:
        raise ValueError("this id is reserved for the end marker")
    return struct.pack("<QffQQ", _u64(id_), x, y, _u64(c), _u64(p)) + b"".join(map(_pack, codes, data))


def to_binary(header: model.Header, rows: Iterable[Record]) -> bytes:
    """The blocked binary form; records begin in a block of their own, so that the header can be replaced."""
    codes = _codes(header)
    return blocks(preamble(header)) + blocks(b"".join(_binary_record(codes, r) for r in rows) + END) + EMPTY_BLOCK


class Writer:
    """A cell file in the making, under another name until it is whole."""

    def __init__(self, path: str, header: model.Header):
        self.fs, self.path = _opened(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.text, self.codes, self.wait, self.n = form_of(path) == "text", _codes(header), bytearray(), 0
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(header.text().encode() if self.text else blocks(preamble(header)))

    def add(self, record: Record) -> None:
        self.wait += (_text_record if self.text else _binary_record)(self.codes, record)
        self.n += 1
        if len(self.wait) >= 16 * BLOCK:
            whole = len(self.wait) // BLOCK * BLOCK
            self._flush(bytes(self.wait[:whole]))
            del self.wait[:whole]

    def _flush(self, data: bytes) -> None:
        self.out.write(data if self.text else blocks(data))

    def close(self) -> None:
        self._flush(bytes(self.wait) + (b"" if self.text else END))
        if not self.text:
            self.out.write(EMPTY_BLOCK)
        self.out.close()
        self.fs.move(self.part, self.path)


def _opened(path: str):
    """The file system and the path in it, of a URI or a local path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:", "file://", 1)
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _preamble_of(data: bytes) -> tuple[model.Header, int]:
    if data[:4] != MAGIC:
        raise ValueError("not a binary cell file")
    version, _, n = struct.unpack_from("<HHI", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version} isn't supported")
    if len(data) < 16 + n:
        raise Truncated("the header is cut short")
    header = model.Header.parse(data[12 : 12 + n].decode())
    (k,) = struct.unpack_from("<I", data, 12 + n)
    if data[16 + n : 16 + n + k].decode() != "".join(_codes(header)):
        raise ValueError("the type codes differ from the header's")
    return header, 16 + n + k


def from_binary(data: bytes) -> tuple[model.Header, Iterator[Record]]:
    data = unblock(data) if data[:2] == b"\x1f\x8b" else data
    header, at = _preamble_of(data)
    codes = _codes(header)

    def rows(at: int = at) -> Iterator[Record]:
        try:
            while data[at : at + 8] != END:
                id_, x, y, c, p = struct.unpack_from("<QffQQ", data, at)
                at += 32
                values = []
                for code in codes:
                    v, at = _unpack(code, data, at)
                    values.append(v)
                yield (_s64(id_), x, y, _s64(c), _s64(p), *values)
        except (struct.error, IndexError, ValueError) as e:
            raise Truncated("the file ends without its end marker") from e

    return header, rows()


def replace_header(data: bytes, header: model.Header) -> bytes:
    """A blocked binary file with another header of the same columns; the records' blocks are copied as they are."""
    offsets = block_offsets(data)
    first, used = b"", 0
    while used < len(offsets):
        a, n = offsets[used]
        first += zlib.decompress(data[a + 18 : a + n - 8], -15)
        used += 1
        if len(first) >= 12:
            size = struct.unpack_from("<I", first, 8)[0]
            if len(first) >= 16 + size and len(first) >= 16 + size + struct.unpack_from("<I", first, 12 + size)[0]:
                break
    old, end = _preamble_of(first)
    if _codes(old) != _codes(header) or not struct.unpack_from("<H", first, 6)[0] & ROOMY or end != len(first):
        h, rows = from_binary(data)
        if len(_codes(h)) != len(_codes(header)):
            raise ValueError("the new header has other columns")
        return to_binary(header, rows)
    return blocks(preamble(header)) + data[offsets[used][0] if used < len(offsets) else len(data) :]


def form(data: bytes) -> str:
    """text, binary (blocked or bare), or an error."""
    if data[:1] == b"@":
        return "text"
    if data[:2] == b"\x1f\x8b" or data[:4] == MAGIC:
        return "binary"
    raise ValueError("neither a text nor a binary cell file")


def decode(data: bytes) -> tuple[model.Header, Iterator[Record]]:
    return from_text(data) if form(data) == "text" else from_binary(data)


def form_of(path: str) -> str:
    """The form that a name asks for: .cyf text, .byf and others binary; .ocyf can't be written."""
    if path.endswith(".ocyf"):
        raise ValueError("the legacy form can't be written")
    return "text" if path.endswith(".cyf") else "binary"


def _chunks(f) -> Iterator[bytes]:
    """What a file holds, blocked or not, in pieces."""
    first = f.read(2)
    if first != b"\x1f\x8b":
        while first:
            yield first
            first = f.read(1 << 20)
        return
    head, out = first + f.read(16), []
    while head:
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise Truncated("no block begins here")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        body = f.read(size - 18)
        if len(body) < size - 18:
            raise Truncated("the last block is cut short")
        out.append(zlib.decompress(body[:-8], -15))
        if sum(map(len, out)) >= 1 << 20:
            yield b"".join(out)
            out = []
        head = f.read(18)
    yield b"".join(out)


def streamed(f) -> tuple[model.Header, Iterator[Record]]:
    """The header of an open file and its records, of which few are held at once."""
    chunks = _chunks(f)
    data = b""
    for part in chunks:
        data += part
        if form(data) == "text":
            if re.search(rb"\n[^@]", data):  # a record begins
                break
        else:
            try:
                header, at = _preamble_of(data)
                return header, _records(header, data[at:], chunks)
            except (struct.error, Truncated, IndexError):
                continue
            except ValueError:
                if len(data) >= 12 and len(data) < 20 + struct.unpack_from("<I", data, 8)[0]:
                    continue
                raise
    if not data or form(data) != "text":
        raise Truncated("the header is cut short")
    begins = re.search(rb"\n(?!@)", data)
    head = data[: begins.end()] if begins else data
    header = model.Header.parse(head.decode())

    def lines() -> Iterator[Record]:
        rest = data[len(head) :]
        for part in chunks:
            whole, _, last = rest.rpartition(b"\n")
            yield from from_text(head + whole)[1]
            rest = last + part
        yield from from_text(head + rest)[1]

    return header, lines()


def _records(header: model.Header, data: bytes, chunks: Iterator[bytes]) -> Iterator[Record]:
    codes, at = _codes(header), 0
    while True:
        try:
            if data[at : at + 8] == END:
                return
            id_, x, y, c, p = struct.unpack_from("<QffQQ", data, at)
            end, values = at + 32, []
            for code in codes:
                v, end = _unpack(code, data, end)
                values.append(v)
        except (struct.error, IndexError, ValueError) as e:
            part = next(chunks, b"")
            if not part:
                raise Truncated("the file ends without its end marker") from e
            data, at = data[at:] + part, 0
            continue
        at = end
        yield (_s64(id_), x, y, _s64(c), _s64(p), *values)


# ------------------------------------------------------------------ Spark


def read(spark: SparkSession, path: str) -> tuple[DataFrame, model.Header]:
    """The cells of one file, or of a folder or pattern of files with the same columns, and the header of the first.

    A task reads a file's records one after the other from where it lies; where Python can't open it, from its bytes as Spark reads them.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").orderBy("path").first()
    if first is None:
        raise ValueError(f"no file at {path}")
    try:
        fs, where = _opened(first[0])
        with fs.open_input_stream(where) as f:
            header = streamed(f)[0]
        files, column = files.select("path"), "path"
    except (OSError, pyarrow.ArrowInvalid, pyarrow.ArrowNotImplementedError):
        header_of = F.udf(lambda b: streamed(io.BytesIO(bytes(b)))[0].text(), "string")
        header = model.Header.parse(files.where(F.col("path") == first[0]).select(header_of("content")).first()[0])
        files, column = files.select("content"), "content"
    want, names = _codes(header), [*model.FIXED, *[t.id for t in header.data]]

    def opened(value):
        if column == "content":
            return io.BytesIO(bytes(value))
        fs, where = _opened(value)
        return fs.open_input_stream(where)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for value in b[column]:
                with opened(value) as f:
                    h, rows = streamed(f)
                    if _codes(h) != want or [t.id for t in h.data] != names[5:]:
                        raise ValueError("files with different columns can't be read as one table")
                    part: list[Record] = []
                    for r in rows:
                        part.append(r)
                        if len(part) == 20_000:
                            yield pd.DataFrame(part, columns=names)
                            part = []
                    yield pd.DataFrame(part, columns=names)

    df = files.mapInPandas(run, schema(header))
    return df.withColumns({"sample_id": model.sample_of(F.col("id")), "cell_id": model.cell_of(F.col("id"))}), header


def write(df: DataFrame, header: model.Header, path: str) -> None:
    """One file, in the form that its name asks for, in the order of the rows, which pass the driver one by one. For tables of several samples see write_samples."""
    out = Writer(path, header)
    for r in header.select(df).toLocalIterator():
        out.add(tuple(r))
    out.close()


def write_samples(df: DataFrame, header: model.Header, folder: str, ending: str = ".byf") -> DataFrame:
    """A file per sample below the folder, in the order of id, each written by one task; returns (path, cells), written once."""
    ship(df.sparkSession)
    fs, root = _opened(folder)
    fs.create_dir(root, recursive=True)
    names = header.select(df).columns
    rows = df.select("sample_id", *names).repartition("sample_id").sortWithinPartitions("sample_id", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, done = None, None, []
        for b in batches:
            for sample, *record in b.itertuples(index=False, name=None):
                if out is None or sample != now:
                    if out:
                        out.close()
                        done.append((out.path, out.n))
                    now, out = sample, Writer(f"{folder}/{sample}{ending}", header)
                out.add(tuple(record))
        if out:
            out.close()
            done.append((out.path, out.n))
        yield pd.DataFrame(done, columns=["path", "cells"])

    return cut(rows.mapInPandas(run, "path string, cells long"))


def pack(df: DataFrame, header: model.Header, rois: list[tuple[str, str, list[tuple[float, float]]]] = ()) -> bytes:
    """The viewer's column-major pack, version 5, of a table that fits the driver: fixed columns, data columns, regions, flag names."""
    names = [t.id for t in header.of("MA", "CA")]
    rows = df.select("id", "x", "y", "cflag", "pflag", *[F.col(n).cast("float").alias(n) for n in names]).toPandas()
    text = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
    out = bytearray(b"CYFV" + struct.pack("<HHQI", 5, 0, len(rows), len(names)) + b"".join(map(text, names)) + "".join("M" if t.kind == "MA" else "C" for t in header.of("MA", "CA")).encode())
    out += b"\0" * (-len(out) % 8)
    for n, t in (("id", "<i8"), ("x", "<f4"), ("y", "<f4"), ("cflag", "<i8"), ("pflag", "<i8"), *[(n, "<f4") for n in names]):
        out += rows[n].to_numpy().astype(t).tobytes()
    out += struct.pack("<I", len(rois))
    for i, name, pts in rois:
        out += text(i) + text(name) + struct.pack("<I", len(pts)) + np.array(pts, "<f4").tobytes()
    for register in ("pflag", "cflag"):
        found = [t for t in header.of("FL") if t.fields.get("RG") == register]
        out += struct.pack("<I", len(found)) + b"".join(text(t.id) + struct.pack("<B", int(t.fields["BI"])) for t in found)
    return bytes(out)
