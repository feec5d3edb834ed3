import re
from collections import Counter

import numpy as np
import pytest

from tesselum.llm import quality_rules as q


def _brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if c[g] > 1:
            covered.update(range(i, i + 5))
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


TEXTS = [None, "", " \n\t\x0b", "one", "a b c d e", "a b c d e a b c d e", "x x x x x x x", "l\nl\n l\nl\n\n\n", "#*$ %&|<> é漢😀 \u00a0w " * 4, "a b c d e f g h i j k l m n o p", "q r s t u " * 3000, "\rz\x0cz\n" * 12]


def test_statistics_by_definition(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS _s")
    got = q.judge(df, []).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS, strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _brute(t), t
        assert r["kept"] == (not r["base_failed"])


def test_learns_the_rules_that_made_the_labels(spark):
    r = np.random.default_rng(0)
    data = {k: r.random(4000) for k in ("a", "b", "c")}
    bad = (data["a"] > 0.8) | ((data["b"] < 0.3) & (data["c"] > 0.6))
    noisy = bad ^ (r.random(4000) < 0.02)
    rules = q.learn(data, noisy, min_precision=0.85)
    said = np.zeros(4000, bool)
    for rule in rules:
        on = np.ones(4000, bool)
        for c in rule:
            on &= c.holds(data)
        said |= on
    assert (said == bad).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, x)) for x in zip(*data.values(), strict=True)], "a double, b double, c double")
    kept = [x[0] for x in df.select(q.expression(rules)).collect()]
    assert kept == (~said).tolist()


@pytest.mark.parametrize("bad", [np.zeros(50, bool), np.ones(50, bool), np.zeros(0, bool)])
def test_one_class_or_nothing_gives_no_rules(bad):
    assert q.learn({"a": np.arange(len(bad), dtype=float)}, bad) == []


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 0), (1, None)], "doc_id long, quality int")
    assert q.fit(docs, labels) == [] and q.fit(docs.limit(0), labels) == []
    assert q.judge(docs, []).first()["kept"] and q.judge(docs.limit(0), []).count() == 0


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = []
    for r in q.op10_quality_rules(spark, sf).collect():
        assert tuple(r)[1:7] == _brute(docs[r["doc_id"]])
        if r["doc_id"] in labels and not r["base_failed"]:
            good.append(r["kept"] == (labels[r["doc_id"]] == 1))
    assert np.mean(good) > 0.95


def test_rules_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    lists = [q.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 3, 8)]
    assert lists[0] and lists[0] == lists[1] == lists[2]


def test_verdict_is_that_of_the_learned_list(spark):
    """kept by an own reading of the list: the first rule that fits rejects."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = q.fit(docs, labels)
    assert rules
    stats = {r["doc_id"]: r.asDict() for r in q.statistics(docs.select("doc_id", "text")).drop("text").collect()}
    for r in q.op10_quality_rules(spark, sf).collect():
        s = stats[r["doc_id"]]
        rejected = any(all((s[c.feature] >= c.threshold) == c.above for c in rule) for rule in rules)
        assert r["kept"] == (not s["base_failed"] and not rejected)


def test_shared_ids_and_clashing_columns(spark):
    good, bad = "a b c d e f g h i j k l m n", "$ # & a b c d e f g * | < >"
    rows = [(i // 2, good if i % 3 else bad, "s") for i in range(60)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _s string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert q.fit(docs.repartition(5), labels) == q.fit(docs.repartition(1), labels)
    out = q.judge(docs, [])
    assert "_s" in out.columns and out.count() == 61 and out.where("doc_id is null").first()["n_words"] == 0
