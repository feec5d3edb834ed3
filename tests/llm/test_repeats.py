import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tesselum.llm import repeats as x


def _brute(texts, n=200):
    data = [(t or "").encode() for t in texts]
    c = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        m = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - n + 1):
            if c[d[i : i + n]] > 1:
                m[i : i + n] = True
        edge = np.diff(np.concatenate([[0], m.astype(int)]))
        out.append((len(d), int(m.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, r in zip(d, m) if not r)).hexdigest()))  # noqa: B905
    return out


def _texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdé") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    long, short = [text(60) for _ in range(8)], [text(25) for _ in range(4)]
    out = [None, "", "abc", "a" * 500, "ab" * 300, "x" * 199, "y" * 200]
    for _ in range(120):
        parts = [text(r.randrange(0, 40))]
        for _ in range(r.randrange(0, 4)):
            q = r.choice(long + short)
            i, j = r.randrange(0, 30), r.randrange(len(q) // 2, len(q))
            parts += [q[i:j] if r.random() < 0.7 else q, text(r.randrange(0, 20))]
        out.append(" ".join(parts))
    out += out[20:25]
    return [*out, out[30][:100] + "X" + out[30][100:]]


@pytest.mark.parametrize("group", [2000, 3])
def test_removes_exactly_what_repeats(spark, group):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS mark", "2 AS spans")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in x.remove_repeats(df, group=group).collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts)


def test_rows_that_share_an_id_or_have_none(spark):
    texts = ["p" * 10 + "".join(map(str, range(300))), "q" + "".join(map(str, range(300))), "other", "".join(map(str, range(400, 600))), "".join(map(str, range(400, 600)))]
    df = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (1, texts[4])], "doc_id long, text string")
    got = sorted(tuple(r)[1:5] for r in x.remove_repeats(df).collect())
    assert got == sorted(_brute(texts))


def test_empty(spark):
    assert x.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_lie_in_every_window_and_follow_content():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(5000)) + b"z" * 700
    p, _ = x.anchors(data)
    for s in range(0, len(data) - x.MIN + 1, 7):
        assert ((p >= s) & (p <= s + x.MIN - x.K)).any()
    q, _ = x.anchors(data[1000:3000])
    assert set(q + 1000) <= set(p)


def test_chunks_meet_without_a_seam(monkeypatch):
    r = random.Random(4)
    data = bytes(r.randrange(4) for _ in range(6000))
    want = x.anchors(data)[0].tolist()
    monkeypatch.setattr(x, "_CHUNK", 500)
    assert x.anchors(data)[0].tolist() == want


def test_interval_tree_by_definition():
    r = random.Random(7)
    lcp = [r.randrange(0, 6) for _ in range(200)]
    want = set()
    for i in range(200):
        for j in range(i, 200):
            d = min(lcp[i : j + 1])
            if d >= 1 and (i == 0 or lcp[i - 1] < d) and (j == 199 or lcp[j + 1] < d):
                want.add((d, i, j + 1))
    got = list(zip(*x.intervals(lcp, 1), strict=True))
    assert len(got) == len(set(got)) and set(got) == want


def test_maximal_repeats_by_definition():
    """Against all strings of small contexts: each group is the full set of occurrences, and differs on both sides."""
    r = random.Random(11)
    gram = b"GRAM"
    left = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 6))) for _ in range(40)]
    right = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 6))) for _ in range(40)]
    text = [a + gram + b for a, b in zip(left, right, strict=True)]
    rep, member, lo, hi = x.maximal_repeats(np.zeros(40, int), [len(a) for a in left], text, least=10, k=4)
    got = {}
    for k, m, a, b in zip(rep, member, lo, hi, strict=True):
        got.setdefault(k, (text[m][len(left[m]) + a : len(left[m]) + b], -a, set()))[2].add(int(m))
    want = {}
    for a in left:
        for b in right:
            for i in range(len(a) + 1):
                for j in range(len(b) + 1):
                    s, n = a[len(a) - i :] + gram + b[:j], i
                    if 10 <= len(s) and j + 4 <= 10:
                        occ = {k for k in range(40) if left[k].endswith(s[:n]) and right[k].startswith(s[n + 4 :])}
                        ends = {right[k][j : j + 1] for k in occ} if j + 4 < 10 else {0, 1}
                        starts = {left[k][len(left[k]) - n - 1 : len(left[k]) - n] if len(left[k]) > n else b"" for k in occ} if n < 6 else {0, 1}
                        if len(occ) > 1 and (len(ends) > 1 or b"" in ends) and (len(starts) > 1 or b"" in starts):
                            want[s, n] = occ
    assert {(s, n): occ for s, n, occ in got.values()} == want


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = x.op5_repeats(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == _brute([d["text"] for d in docs])
