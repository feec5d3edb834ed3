import zlib

import numpy as np
import pytest

from tesselum.llm import sharding as s


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 1000, 4097, 65_537])
def test_permutation_and_its_inverse(n):
    p = s.permute(np.arange(n), n)
    assert sorted(p) == list(range(n))
    assert (s.unpermute(p, n) == np.arange(n)).all()


def test_permutation_is_far_from_the_order_and_depends_on_the_seed():
    p = s.permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(p, np.arange(10_000))[0, 1]) < 0.05
    assert (p != s.permute(np.arange(10_000), 10_000, seed=1)).mean() > 0.99


def test_large_domains():
    x = np.array([0, 1, (1 << 61) - 1], np.int64)
    assert (s.unpermute(s.permute(x, 1 << 61), 1 << 61) == x).all()


def test_shards_are_even_gapless_and_independent_of_partitions(spark):
    rows = [(None, "n"), (None, "n"), (3, None), (3, "")] + [(i, f"t{i}é") for i in range(200)] + [(7, "same")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS shard", "6 AS slot")
    a, b = (sorted(map(str, s.shard(df.repartition(k), ["doc_id"], 24).collect())) for k in (1, 7))
    assert a == b
    got = s.shard(df, ["doc_id"], 24).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    sizes = [r["count(1)"] for r in got]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and all(r["max(slot)"] == r["count(1)"] - 1 for r in got)


def test_rows_that_differ_in_a_null_only_keep_their_places(spark):
    rows = [(1, None, 5), (1, 5, None), (1, None, None), (1, 5, 5), (None, None, 7), (None, 7, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, a int, b int")
    got = [sorted(map(str, s.shard(df.repartition(k), ["doc_id"], 4).collect())) for k in (1, 5, 7)]
    assert got[0] == got[1] == got[2]


def test_place_is_computed_from_the_number(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    p = s.permute(np.arange(100), 100)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in s.shard(df, ["doc_id"], 24).collect()} == {i: (p[i] % 24, p[i] // 24) for i in range(100)}


def test_empty(spark):
    assert s.shard(spark.createDataFrame([], "doc_id long"), ["doc_id"]).count() == 0


def test_query(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = s.op3_sharding(spark, sf).collect()
    assert len(got) == len(docs)
    by = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(24)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]]) + 8, zlib.crc32(docs[r["doc_id"]]), "rows", None)
