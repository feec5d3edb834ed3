import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesselum.llm import simhash as x
from tesselum.operators.components import components


def _brute(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def _roots(keys, budget=4):
    f = x.Forest(len(keys))
    i, j = np.triu_indices(len(keys), 1)
    ok = np.bitwise_count(keys[i] ^ keys[j]) <= budget
    f.link(i[ok], j[ok])
    return f.root


@pytest.fixture(scope="module")
def keys():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 200, dtype=np.uint64)
    out = [*map(int, base), 0, 2**64 - 1]
    for b in base[:50]:
        for _ in range(15):
            v = int(b)
            for p in r.choice(64, r.integers(1, 6), replace=False):
                v ^= 1 << int(p)
            out.append(v)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a B c", "a b c d", "A\u00a0b É é \x0bz  q\n" * 3, "x " * 5000])
def test_fingerprint_by_definition(text):
    assert x.fingerprint(text or "") == _brute(text)


@pytest.mark.parametrize("budget", [0, 1, 4, 7])
def test_trie_join_finds_all_links(keys, budget):
    f = x.Forest(len(keys))
    x.trie_join(keys, 0, budget, f)
    assert (f.root == _roots(keys, budget)).all()


@pytest.mark.parametrize(("equal", "group"), [(1, 20_000), (2, 20_000), (3, 50), (1, 7)])
def test_deals_lose_no_link(spark, keys, monkeypatch, equal, group):
    monkeypatch.setattr(x, "spread", lambda *_: equal)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long").select(F.col("fp").alias("node"), "fp")
    got = {r["node"]: r["root"] for r in components(x.links(df, 4, group=group)).collect()}
    sets = {}
    for k, r in zip(keys.view(np.int64).tolist(), _roots(keys).tolist(), strict=True):
        sets.setdefault(r, []).append(k)
    assert got == {k: min(v) for v in sets.values() for k in v if k != min(v)}


def test_groups_with_nulls_repeats_and_clashes(spark):
    rows = [(5, None), (3, ""), (None, "  "), (9, "a b c d e f g h"), (8, "A B c d e f g h"), (8, "A B c d e f g h"), (None, "zz yy xx"), (1, "q " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS u")
    got = [(r["doc_id"], r["component_id"], r["fingerprint"]) for r in x.group(df).collect()]
    want = [(i, _brute(t)) for i, t in rows]
    assert sorted((a or -1, c) for a, _, c in got) == sorted((i or -1, f"{f:016x}") for i, f in want)
    by = {(a, c): b for a, b, c in got}
    assert by[5, "0" * 16] == by[3, "0" * 16] == by[None, "0" * 16] == 3 and by[8, f"{_brute(rows[3][1]):016x}"] == 8 and by[None, f"{_brute('zz yy xx'):016x}"] is None
    assert x.group(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fp = np.array([_brute(d["text"]) for d in docs], np.uint64)
    ids = [d["doc_id"] for d in docs]
    want = [(i, f"{int(f):016x}", ids[r]) for i, f, r in zip(ids, fp, _roots(fp), strict=True)]
    assert [tuple(r) for r in x.op8_simhash(spark, sf).orderBy("doc_id").collect()] == want


def test_stage_keeps_one_of_each_group(spark):
    import random

    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(400)] for _ in range(30)]
    rows, group = [], {}
    for k, w in enumerate(base):
        for c in range(4):
            v = list(w)
            for _ in range(c * 2):  # up to 6 of 400 words: a similarity of 0.85 and more
                v[r.randrange(400)] = r.choice(words)
            group[len(rows)] = k
            rows.append((len(rows), " ".join(v)))
    rows += [(500, rows[0][1]), (501, rows[5][1]), (None, "only here " * 9), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = sorted(r["doc_id"] for r in x.distinct(df).collect() if r["doc_id"] is not None)
    assert got == [4 * k for k in range(30)] and x.distinct(df).columns == df.columns
    assert x.distinct(df).count() == 31


def _similarity(a, b, k=5):
    s, t = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(s & t) / len(s | t)


def test_stage_finds_copies_with_a_passage_added_or_cut_off(spark):
    """Every pair of a similarity of 0.8 or more is found, whatever the edit, and no other."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    pick = lambda n: [r.choice(words) for _ in range(n)]
    notice = pick(40)  # common to many texts
    rows = []
    for _ in range(60):
        n, share = r.randrange(40, 600), r.uniform(0.02, 0.3)
        w, k = pick(n) + notice, max(1, int(n * share))
        rows += [" ".join(v) for v in (w, w + pick(k), pick(k) + w, w[k:], w[:-k])[:: r.choice((1, 2))]]
    r.shuffle(rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if _similarity(rows[i], rows[j]) >= 0.8]
    f = x.Forest(len(rows))
    f.link(*np.array(links).T)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert len(links) > 100 and sorted(r["doc_id"] for r in x.distinct(df).collect()) == sorted(set(f.root.tolist()))


def test_stage_keeps_unrelated_texts_that_share_an_id(spark, monkeypatch):
    near = " ".join(f"w{i}" for i in range(200))
    rows = [(1, near + " end"), (5, near), (5, "another text that has nothing to do with it"), (6, "other words"), (None, near + " tail"), (6, None), (7, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _stay", "2 AS _mark", "3 AS root", "'k' AS some")
    for broadcast in (x.BROADCAST, 0):
        monkeypatch.setattr(x, "BROADCAST", broadcast)
        got = x.distinct(df)
        assert got.columns == df.columns
        # the null and the empty text are no words, and alike
        assert sorted((str(r["doc_id"]), (r["text"] or "")[:8]) for r in got.collect()) == [("1", "w0 w1 w2"), ("5", "another "), ("6", ""), ("6", "other wo")]
    named = spark.createDataFrame([("a1", near), ("a0", near + " x"), ("b", "quite other")], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in x.distinct(named).collect()) == ["a0", "b"]
    assert x.distinct(df.limit(0)).count() == 0


def test_groups_of_bands_are_split(spark, monkeypatch):
    """Near copies beyond the size of a group still find each other."""
    import random

    r = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(2):
            w[r.randrange(300)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w + [f"t{r.randrange(10**6)}" for _ in range(5)]))
    df = spark.createDataFrame([*enumerate(texts), (99, "something else " * 3)], "doc_id long, text string")
    want = sorted(tuple(v) for v in x.distinct(df).collect())
    monkeypatch.setattr(x, "GROUP", 6)
    monkeypatch.setattr(x, "links", lambda nodes, *_, **__: nodes.limit(0).select("node", "node").toDF("u", "v"))
    assert sorted(tuple(v) for v in x.distinct(df).collect()) == want and [v[0] for v in want] == [0, 99]


def test_comparison_of_many_partners_and_copies(spark, monkeypatch):
    """A hub's partners in several parts, and copies of texts in several tasks."""
    monkeypatch.setattr(x, "LEAVES", 3)
    monkeypatch.setattr(x, "PIECE", 70)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:k]) for k in range(200, 301, 4)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").repartition(5).selectExpr("xxhash64(text) AS mark", "text AS _text")
    marks = {r["_text"]: r["mark"] for r in rows.collect()}
    pairs = [(marks[a], marks[b]) for i, a in enumerate(texts) for b in texts[:i]]
    got = {tuple(r) for r in x.similar(spark.createDataFrame(pairs, "u long, v long"), rows).collect()}
    assert got == {(marks[a], marks[b]) for i, a in enumerate(texts) for b in texts[:i] if _similarity(a, b) >= 0.8}


def test_labels_of_large_components(spark, monkeypatch):
    """With every key hot and with none the labels are the same."""
    from tesselum.llm import common

    rows = [(i, "a b c d e f" if i % 3 else f"t{i % 7} u v w") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, x.group(df).collect()))
    for hot in (1, 10_000_000):
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(map(tuple, x.group(df).collect())) == want


def test_bands_of_many_unlike_texts_lose_no_link(spark, monkeypatch):
    """Pairs of copies in one band with many other texts, whole or in groups."""
    import random

    r = random.Random(6)
    texts = []
    for k in range(25):
        w = [f"a{r.randrange(9000)}" for _ in range(150)]
        texts += [" ".join(w), " ".join(w[: 150 - k % 9] + [f"b{k}"])]
    df = spark.createDataFrame([(t, x.sketch(x.minima(x.shingle_hashes(t))), [7]) for t in texts], "_text string, sketch binary, bands array<long>").selectExpr("xxhash64(_text) AS mark", "*").cache()
    marks = {t["_text"]: t["mark"] for t in df.collect()}
    want = {tuple(sorted((marks[a], marks[b]))) for a, b in zip(texts[::2], texts[1::2], strict=True)}
    for group in (x.GROUP, 12):
        monkeypatch.setattr(x, "GROUP", group)
        got = x.completed(spark.createDataFrame([], "u long, v long"), df, df.select("mark", "_text"))
        assert {tuple(sorted(p)) for p in got.collect()} == want
    df.unpersist()


def test_bands_of_alike_texts_make_no_row_for_each_pair(spark, monkeypatch):
    """Texts of one band that are similar by 0.6 to 0.75, with some pairs of copies: all links are found, and what is handed on grows with the texts, not with their pairs."""
    import random

    r = random.Random(9)
    base, texts = [f"w{i}" for i in range(300)], []
    for k in range(150):
        w = list(base)
        for p in r.sample(range(0, 300, 5), 8):
            w[p] = f"x{r.randrange(10**9)}"
        texts.append(" ".join(w))
        if k % 10 == 0:  # a copy with a few words more
            texts.append(texts[-1] + f" y{k} z{k}")
    low = {t: x.sketch(x.minima(x.shingle_hashes(t))) for t in texts}
    df = spark.createDataFrame([(t, low[t], [7]) for t in texts], "_text string, sketch binary, bands array<long>").selectExpr("xxhash64(_text) AS mark", "*").cache()
    marks = {t["_text"]: t["mark"] for t in df.collect()}
    alike = sum(sum(map(int.__eq__, low[a], low[b])) >= x.ALIKE for i, a in enumerate(texts) for b in texts[:i])
    want = {tuple(sorted((marks[a], marks[b]))) for i, a in enumerate(texts) for b in texts[:i] if _similarity(a, b) >= 0.8}
    assert len(want) == 15 and alike > 20 * len(texts)
    handed = []
    for name in ("similar", "_unlike"):
        real = getattr(x, name)
        monkeypatch.setattr(x, name, lambda pairs, *other, real=real: (handed.append(pairs.count()), real(pairs, *other))[1])
    for group, size in ((x.GROUP, 1 << 24), (12, 1 << 24), (x.GROUP, 60_000)):
        monkeypatch.setattr(x, "GROUP", group)
        monkeypatch.setattr(x, "TEXTS", size, raising=False)
        handed.clear()
        got = [tuple(sorted(p)) for p in x.completed(spark.createDataFrame([], "u long, v long"), df, df.select("mark", "_text")).collect()]
        assert set(got) == want and sum(handed) <= 8 * len(texts)
    df.unpersist()
