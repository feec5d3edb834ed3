import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline", reason="the pipeline isn't here")


def test_stages_follow_each_other(spark, sf):
    import sentencepiece

    from tesselum.llm import decontamination, sentence_pieces

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        seen.append(docs)
        if k < 4:
            assert docs.columns == columns
    quality, distinct, clean, private, tokens = seen
    assert quality.where("size(split(trim(text), '[ \\n\\t]+')) < 10").count() == 0
    assert distinct.count() == distinct.select("text").distinct().count() < quality.count()
    assert decontamination.leaks(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert private.count() == clean.count() and private.where(F.col("n_chars") != F.length("text")).count() == 0
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces._find(sentence_pieces.MODEL))
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    for r in tokens.collect():
        assert r["ids"] == lib.encode(texts[r["doc_id"]], add_eos=True) and r["n_tokens"] == len(r["ids"])
    whole = pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(texts)
    for s in seen:
        s.unpersist()


def test_tokens_keep_their_spans(spark, sf):
    text = "Ａ  tale of ﬁve élèves\n and more"
    docs = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    row = pipeline.tokens(spark, docs, sf).first()
    spans = [(p["start"], p["end"]) for p in row["spans"]]
    assert len(spans) == row["n_tokens"] == len(row["ids"]) and spans == sorted(spans)
    assert spans[0][0] == 0 and spans[-1][1] == len(text.encode())


def _prose(k, n=60):
    """n different words, in sentences."""
    return " ".join(f"wort{chr(97 + (k * 7 + i) % 26)}{chr(97 + i % 26)}{chr(97 + (i // 26 + k) % 26)}" + ("." if i % 12 == 11 else "") for i in range(n))


def test_edge_cases_through_all_stages(spark, sf):
    """Nulls, empty and very long texts, repeats, texts that share an id, and columns that are called as the operators' own."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    long = " ".join(f"wort{letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676 % 26]}{letters[i // 17_576]}" + "." * (i % 12 == 11) for i in range(60_000))
    rows = [
        (1, _prose(1), None, None, 1), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, " \n\t", "en", "s", 3), (5, _prose(5), "en", "s", 1), (5, _prose(9) + " more", "en", "s", 1),
        (6, _prose(1), "en", "s", 1), (6, _prose(1), "en", "s", 1), (None, _prose(11), "en", "s", 1), (None, _prose(5), "en", "s", 1), (7, long, "en", "s", 1), (8, f"{_prose(13)} {item} {_prose(14)}", "en", "s", 1),
        (9, f"{_prose(15)} write to jo.doe@mail.example.org or Dr. Jane Roe; Roe knows", "en", "s", 1),
    ]
    names = ["kept", "n_words", "_s", "_stay", "_mark", "_bad_doc", "n_entities", "_found", "mark", "root"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    for k, (_, stage) in enumerate(pipeline.STAGES[:4]):
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert all(r[n] == n for r in docs.collect() for n in names)
        got = sorted((str(r["doc_id"]), (r["text"] or "")[:12]) for r in docs.collect())
        if k == 0:
            assert {i for i, _ in got} == {"1", "5", "6", "7", "8", "9", "None"} and len(got) == 10
        if k == 1:
            assert [i for i, _ in got] == ["1", "5", "5", "7", "8", "9", "None"]
        if k == 2:
            assert [i for i, _ in got] == ["1", "5", "5", "7", "9", "None"]
    last = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert last[7] == long and "jo.doe" not in last[9] and "Roe" not in last[9] and "Jane" not in last[9]
    tokens = pipeline.STAGES[4][1](spark, docs, sf).collect()
    assert len(tokens) == 6 and all(r["n_tokens"] == len(r["ids"]) == len(r["spans"]) > 0 for r in tokens)


def test_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_near_copies_are_found_by_similarity(spark):
    """Of planted copies with words replaced, inserted, cut off or added: at least nine in ten of each band of similarity from 0.8 go; unlike texts stay."""
    import random

    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    pick = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    rows, bands, alone = [], {}, []
    for k in range(400):
        w = pick(r.randrange(40, 800))
        v, n = list(w), max(1, int(len(w) * r.uniform(0.002, 0.2)))
        kind = k % 4
        if kind == 0:
            for _ in range(max(1, n // 6)):
                v[r.randrange(len(v))] = r.choice(vocabulary)
        elif kind == 1:
            v = v[: len(v) // 2] + pick(n) + v[len(v) // 2 :]
        elif kind == 2:
            v = v[n:]
        else:
            v = v + pick(n)
        s = len(shingles(w) & shingles(v)) / len(shingles(w) | shingles(v))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        if s >= 0.8:
            bands.setdefault(min(9, int(s * 20) / 2 * 1.0) if s < 1 else 10, []).append(2 * k + 1)
        else:
            alone.append(2 * k + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x["doc_id"] for x in pipeline.simhash.distinct(df).collect()}
    assert len(bands) >= 3 and all(sum(i not in kept for i in ids) >= 0.9 * len(ids) for ids in bands.values())
    assert set(alone) <= kept and all(2 * k in kept for k in range(400))
