"""SentencePiece encoding and decoding that keeps offsets.

Normalisation walks a text by longest prefixes of the model's compiled character map (a double-array trie and its
replacement strings) and notes for each output byte the input byte it came from; white space then becomes the
meta symbol, with the model's dummy prefix and white-space options. The library segments the same text; each piece's bytes
are laid over the normalised text, and the alignment projects them to spans of bytes of the original. Texts are processed
whole, a batch of rows at a time, in one narrow stage: no shuffle, and memory follows the largest text.

Edge cases: a null text counts as empty; an empty text has the end id alone and decodes to the empty string; repeated rows give
equal results; an empty table gives no rows; a clashing column is replaced by the operator's.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm.common import ship, table

MODEL = "piece_bpe_32k.model"
META = "▁".encode()
#: Bytes of text that are encoded at once, unless one text has more.
BATCH = 1 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a serialised protocol message: (number, int or bytes)."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield number, value


class Normaliser:
    """A model's normalisation, with alignment."""

    def __init__(self, model: bytes):
        spec = next((v for k, v in _fields(model) if k == 3), b"")
        found = dict(_fields(spec))
        self.dummy, self.squeeze, self.escape = (bool(found.get(k, 1)) for k in (3, 4, 5))
        self.suffix = any(k == 2 and any(n == 24 and x for n, x in _fields(v)) for k, v in _fields(model))
        blob = found.get(2, b"")
        self.units: list[int] = []
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.strings = blob[4 + size :]
        # characters that the map leaves alone, whichever of them follows: a run of them is copied at once, but for its last
        printable = bytes(range(33, 127))
        same = bytes(c for c in printable if self.units and not self.longest(bytes([c]), 0)[0])
        same = bytes(c for c in same if not any(self.longest(bytes([c, d]), 0)[0] for d in b" " + printable))
        # a space may stand within a run where the map leaves it alone too
        if same and not any(self.longest(bytes([32, d]), 0)[0] for d in b" " + printable):
            same += b" "
        self.plain = re.compile(b"[" + re.escape(same) + b"]+") if same else re.compile(rb"(?!)")

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """Length and replacement of the longest prefix of data[at:] in the map; (0, None) if there is none."""
        units = self.units
        unit = units[0]
        node = ((unit >> 10) << ((unit & 512) >> 6)) if units else 0
        best: tuple[int, bytes | None] = (0, None)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return best

    def mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """data after the character map, and the input byte of each output byte and of the end."""
        if not self.units:
            return data, np.arange(len(data) + 1)
        out, align, at = [], [], 0
        while at < len(data):
            run = self.plain.match(data, at)
            if run and run.end() - at > 1:
                # what follows the last may combine with it
                end = run.end() - (run.end() < len(data))
                out.append(data[at:end])
                align.append(np.arange(at, end))
                at = end
                continue
            n, new = self.longest(data, at)
            if not n:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + n]
            out.append(new)
            align.append(np.full(len(new), at))
            at += n
        return b"".join(out), np.concatenate([*align, [len(data)]]).astype(np.int64)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and the end, where it begins in the text's UTF-8."""
        data, align = self.mapped(text.encode())
        if self.squeeze and data:
            b = np.frombuffer(data, np.uint8)
            space = b == 32
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            if keep.any() and space[np.flatnonzero(keep)[-1]]:
                keep[np.flatnonzero(keep)[-1]] = False
            last = np.flatnonzero(keep)[-1] + 1 if keep.any() else len(b)
            data, align = b[keep].tobytes(), np.concatenate([align[:-1][keep], [align[last]]])
        if not data:
            return b"", align[-1:]
        if self.dummy:
            data, align = (data + b" ", np.concatenate([align, align[-1:]])) if self.suffix else (b" " + data, np.concatenate([align[:1], align]))
        if self.escape:
            b = np.frombuffer(data, np.uint8)
            times = np.where(b == 32, len(META), 1)
            align = np.concatenate([np.repeat(align[:-1], times), align[-1:]])
            data = data.replace(b" ", META)
        return data, align


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        with open(model_file, "rb") as f:
            self.normalise = Normaliser(f.read())
        n = self.library.vocab_size()
        plain = [not (self.library.is_control(i) or self.library.is_unknown(i)) for i in range(n)]
        #: Bytes of the normalised text that a piece covers; -1 for the unknown piece, whose length varies.
        self.covers = np.array([-1 if self.library.is_unknown(i) else (1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).encode())) if plain[i] else 0 for i in range(n)])

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids with the end id, and an n x 2 array of the spans of bytes of the text that they stand for."""
        ids = self.library.encode(text, add_bos=False, add_eos=True)
        return ids, self.spans(text, ids)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        data, align = self.normalise(text)
        n = self.covers[ids]
        if (n < 0).any():  # pieces of unknown characters: their surfaces give the lengths
            n = np.array([len(p.surface.encode()) if k < 0 else k for p, k in zip(self._pieces(text), n, strict=True)])
        end = np.cumsum(n)
        if len(end) and end[-1] != len(data):
            raise ValueError(f"the pieces cover {end[-1]} of {len(data)} normalised bytes")
        return np.stack([align[end - n], align[end]], axis=1)

    def _pieces(self, text: str):
        class End:
            surface = ""

        class Piece:
            def __init__(self, piece):
                self.surface = piece

        return [*map(Piece, self.library.encode(text, out_type=str)), End]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def _find(model: str) -> str:
    import public_tokenizers

    return model if "/" in model else public_tokenizers.path(model)


def _batches(df: DataFrame, make, schema: str) -> DataFrame:
    """make(texts) -> dict of columns, over the texts (last column) of each batch; the other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(whole.num_columns - 1)
            ends = np.cumsum([0, *(n or 0 for n in pc.binary_length(texts).to_pylist())])
            start = 0
            while start < whole.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BATCH, side="right")) - 1)
                b = whole.slice(start, stop - start)
                made = make([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made.values()], [*b.schema.names[:-1], *made])
                start = stop

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _kept(df: DataFrame, text: str, made: tuple[str, ...]) -> tuple[DataFrame, str]:
    keep = [c for c in df.columns if c.lower() not in {m.lower() for m in made}]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("_piece_text"))
    return rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", "


def encode(df: DataFrame, text: str = "text", model: str = MODEL, *, spans: bool = True) -> DataFrame:
    """df with ids array<int> (the end id last) and spans array<struct<start, end>>: bytes of the text. spans: whether to return them."""
    rows, schema = _kept(df, text, ("ids", "spans"))

    def make(texts: list[str]) -> dict:
        c = codec(_find(model))
        done = [c.encode(t) for t in texts]
        out = {"ids": pa.array([i for i, _ in done], pa.list_(pa.int32()))}
        if spans:
            offsets = pa.array(np.cumsum([0, *[len(i) for i, _ in done]]), pa.int32())
            flat = np.concatenate([s for _, s in done]) if done else np.zeros((0, 2), int)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["start", "end"])
            out["spans"] = pa.ListArray.from_arrays(offsets, pairs)
        return out

    return _batches(rows, make, schema + "ids array<int>" + ", spans array<struct<start: bigint, end: bigint>>" * spans)


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """df with the column decoded: the text of its ids."""
    keep = [c for c in df.columns if c.lower() != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codec(_find(model))
            texts = [c.decode(list(x or [])) for x in b.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep).mapInArrow(run, schema + ", decoded string")


def digest(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """df with n_tokens, ids_sha256, decoded_sha256, n_covered (bytes of the text under pieces) and spans_sha256 (of the spans' starts and
    ends, in order, as little-endian 64-bit numbers): encode and decode without moving ids out of Python."""
    rows, schema = _kept(df, text, ("n_tokens", "ids_sha256", "decoded_sha256", "n_covered", "spans_sha256"))

    def make(texts: list[str]) -> dict:
        c = codec(_find(model))
        n, ids_sha, text_sha, covered, spans_sha = [], [], [], [], []
        for t in texts:
            ids, spans = c.encode(t)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            covered.append(int((spans[:, 1] - spans[:, 0]).sum()))
            spans_sha.append(hashlib.sha256(np.ascontiguousarray(spans, "<i8").tobytes()).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string()), "n_covered": pa.array(covered, pa.int64()), "spans_sha256": pa.array(spans_sha, pa.string())}

    return _batches(rows, make, schema + "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_covered bigint, spans_sha256 string")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered", "spans_sha256")
