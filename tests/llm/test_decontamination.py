import random
import re

from tesselum.llm import decontamination as d

_W = [f"w{i}" for i in range(400)]


def _words(t):
    return [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]


def _brute(docs, items, t=0.8):
    out = {}
    for i, text in docs:
        w = _words(text)
        for k, item in items:
            v = _words(item)
            n = min(5, len(v))
            want = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if want and len(want & have) / len(want) >= t:
                out.setdefault(i, set()).add(k)
    return out


def test_finds_exactly_what_contains_the_items(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(_W) for _ in range(n))
    items = [(k, text(r.choice([12, 30, 31, 60, 200]))) for k in range(12)] + [(90, "Hello, World"), (91, None), (92, ""), (93, "...")]
    docs = [(0, None), (1, ""), (2, "so hello -- world!"), (3, "hello big world")]
    for i in range(4, 80):
        body = text(r.randrange(0, 120))
        if i % 2:
            w = r.choice(items[:12])[1].split()
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = "zz"
            body = f"{body} {' '.join(w).upper()}, {text(r.randrange(0, 3000))}"
        docs.append((i, body))
    docs += [(5, docs[5][1]), (5, "another text under the same id")]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS d", "3 AS mark")
    idf = spark.createDataFrame(items, "item_id long, text string")
    want = _brute(docs, items)
    assert sum(map(len, want.values())) > 10
    got = {x["doc_id"]: set(x["item_ids"]) for x in d.leaks(ddf, idf).collect()}
    assert got == want
    kept = sorted(x["doc_id"] for x in d.clean(ddf, idf).collect())
    assert kept == sorted(i for i, t in docs if not _brute([(i, t)], items))


def test_shuffled_path_gives_the_same(spark, monkeypatch, sf):
    want = sorted(map(str, d.op2_decontamination(spark, sf).collect()))
    monkeypatch.setattr(d, "BROADCAST", 0)
    assert sorted(map(str, d.op2_decontamination(spark, sf).collect())) == want


def test_query_matches_sql(spark):
    import duckdb

    sf, c = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(c.execute(d.ORACLE).fetchall())
    assert want and sorted(map(tuple, d.op2_decontamination(spark, sf).collect())) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert d.leaks(docs, items).count() == 0 and d.leaks(one, items).count() == 0 and d.clean(one, items).count() == 1


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, "clean"), (1, "a b c d e f g"), (1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f"), (None, "b c d e f g")], "item_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_items"]) for r in d.leaks(docs, items).collect()) == [(-1, 1), (1, 1)]
    assert [r["text"] for r in d.clean(docs, items).collect()] == ["clean"]


def test_stock_opening_of_many_items(spark):
    """Items that all open alike: the shingle is in no sketch, and a document with it alone meets no item."""
    r = random.Random(3)
    opening = "which of the following statements"
    items = [(k, f"{opening} " + " ".join(r.choice(_W) for _ in range(20))) for k in range(2000)]
    idf = spark.createDataFrame(items, "item_id long, text string")
    most = d.sketches(d.prepare(idf, "item_id", "text")).groupBy("h").count().agg({"count": "max"}).first()[0]
    assert most < 20
    docs = spark.createDataFrame([(1, f"{opening} is it"), (2, f"so {items[7][1]} there"), (3, items[8][1].rsplit(" ", 3)[0])], "doc_id long, text string").selectExpr("*", "1 AS _bad_doc", "2 AS _bad_mark")
    assert {x["doc_id"]: x["item_ids"] for x in d.leaks(docs, idf).collect()} == {2: [7], 3: [8]}
    assert [x["doc_id"] for x in d.clean(docs, idf).collect()] == [1] and d.clean(docs, idf).columns == docs.columns
