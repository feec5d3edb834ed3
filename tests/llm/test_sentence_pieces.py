import hashlib
import random
import struct

import pytest
import sentencepiece

from tesselum.llm import sentence_pieces as s

ALPHABET = "ab cd  \n\té\u3000ñ漢字😀0１ﬁÀẞÅ①㍿ｶﾞ\u200b"


def _texts(n, seed=1):
    r = random.Random(seed)
    return ["", " ", "  a  ", *("".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 40))) for _ in range(n))]


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_normalises_as_the_library_does(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = s.Normaliser(library.serialized_model_proto())
    for t in _texts(1500):
        data, align = own(t)
        assert data.decode() == library.normalize(t)
        assert len(align) == len(data) + 1 and (align[1:] >= align[:-1]).all() and align[-1] <= len(t.encode())


def test_spans_are_the_pieces_sources():
    c = s.codec(s._find(s.MODEL))
    for t in _texts(1000):
        ids, spans = c.encode(t)
        raw = t.encode()
        assert ids == c.library.encode(t, add_eos=True) and ids[-1] == 2
        at = 0
        for i, (a, b) in zip(ids[:-1], spans[:-1].tolist(), strict=True):
            piece = c.library.id_to_piece(i)
            assert a == at or not a
            at = b
            if not c.library.is_byte(i):
                assert raw[a:b].decode().replace(" ", "▁") == piece.removeprefix("▁") or raw[a:b].decode().replace(" ", "▁") == piece
        assert at == len(raw)


def test_columns_and_round_trip(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "é😀 " * 20_000), (1, "Hello  world\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS decoded")
    lib = sentencepiece.SentencePieceProcessor(model_file=s._find(s.MODEL))
    out = s.decode(s.encode(df)).collect()
    for r, (i, t) in zip(out, rows, strict=True):
        ids = lib.encode(t or "", add_eos=True)
        assert (r["doc_id"], r["ids"], r["decoded"]) == (i, ids, lib.decode(ids))
        assert len(r["spans"]) == len(ids)
    for r, (_, t) in zip(s.digest(df).collect(), rows, strict=True):
        ids = lib.encode(t or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and r["n_covered"] == len((t or "").encode())
    assert s.digest(df.limit(0)).count() == 0


def test_query(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_file=s._find(s.MODEL))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in s.op9_sentence_pieces(spark, sf).collect():
        text = docs[r["doc_id"]] or ""
        ids = lib.encode(text, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids))) and r["decoded_sha256"] == sha(lib.decode(ids))
        assert r["spans_sha256"] == hashlib.sha256(struct.pack(f"<{2 * len(ids)}q", *(v for p in _library_spans(lib, text) for v in p))).hexdigest()


def _library_spans(lib, text):
    """The library's own offsets; of a character in byte pieces it gives all to the last, here each has its byte."""
    out, start = [], 0
    for p in lib.encode(text, return_type="proto").pieces:
        if lib.is_byte(p.id):
            start = len(out) and out[-1][1]
            out.append((start, start + 1))
        else:
            out.append((p.begin, p.end))
    return [*out, (len(text.encode()), len(text.encode()))]
