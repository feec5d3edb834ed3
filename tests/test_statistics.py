"""Tests of groups and survival against values computed by hand or by definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesselum.operators import statistics as s


def test_tails_of_known_values():
    for kind, value, dof, p in (("t", 2.0, 10, 0.0733880), ("t", -12.7062047, 1, 0.05), ("t", 0.0, 7, 1.0), ("t", 1.96, 1e6, 0.0499960), ("normal", 1.959964, 0, 0.05), ("chi2", 3.841459, 0, 0.05), ("chi2", 0.0, 0, 1.0)):
        assert s.two_sided(kind, value, dof) == pytest.approx(p, abs=1e-6)
    assert math.isnan(s.two_sided("t", None, 3))


def test_t_and_rank_tests_of_pairs(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (4, 5, 6, 7, 8, 9)] + [("c", None), ("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    (r,) = s.t_tests(df, "g", "v").collect()
    # Welch: means 3 and 6.5, variances 2.5 and 3.5
    assert (r["a"], r["b"]) == ("a", "b") and r["t"] == pytest.approx(-3.5 / math.sqrt(0.5 + 3.5 / 6)) and 0 < r["p"] < 0.02
    w = s.rank_sums(df, "g", "v", "a", "b").first()
    more = sum((x > y) + (x == y) / 2 for x in (1, 2, 3, 4, 5) for y in (4, 5, 6, 7, 8, 9))
    assert w["w"] == more and (w["n_a"], w["n_b"]) == (5, 6)
    # normal approximation with two tied pairs
    var = 30 / 12 * (12 - 2 * 6 / 110)
    assert w["p"] == pytest.approx(math.erfc((abs(more - 15) - 0.5) / math.sqrt(2 * var)))
    many = spark.range(7).select(F.col("id").alias("g"), F.col("id").cast("double").alias("v"))
    assert s.t_tests(many, "g", "v").count() == 0


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(s, "MAX_GROUPS", 3)
    with pytest.raises(ValueError, match="groups"):
        s.t_tests(spark.range(9).select(F.col("id").alias("g"), F.lit(1.0).alias("v")), "g", "v")


@pytest.mark.parametrize("at", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_quantiles_are_exact(spark, at):
    r = random.Random(4)
    values = [round(r.gauss(0, 3), 1) for _ in range(501)] + [7.0] * 300
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    v = sorted(values)
    k = at * (len(v) - 1)
    want = v[math.floor(k)] + (k - math.floor(k)) * (v[math.ceil(k)] - v[math.floor(k)])
    assert s.exact_quantile(df, "v", at) == pytest.approx(want)
    assert s.exact_quantile(df.limit(0), "v", at) is None


def test_log_rank_and_cutpoint(spark):
    rows = [("a", t, e) for t, e in ((1, 1), (2, 1), (3, 0), (4, 1), (4, 1))] + [("b", t, e) for t, e in ((2, 0), (4, 1), (5, 1), (6, 0), (7, 1))]
    df = spark.createDataFrame(rows, "g string, t int, e int")
    o = ex = v = 0.0
    for t in sorted({t for _, t, e in rows if e}):
        n, na = sum(x >= t for _, x, _ in rows), sum(x >= t for g, x, _ in rows if g == "a")
        d, da = sum(x == t and e for _, x, e in rows), sum(x == t and e for g, x, e in rows if g == "a")
        o, ex = o + da, ex + d * na / n
        v += d * na / n * (1 - na / n) * (n - d) / (n - 1) if n > 1 else 0
    got = s.log_rank(df, "t", "e", "g").first()
    assert [got[c] for c in ("observed", "expected", "variance", "chi2")] == pytest.approx([o, ex, v, (o - ex) ** 2 / v])
    assert got["p"] == pytest.approx(math.erfc(math.sqrt(got["chi2"] / 2)))
    # those above 5 live longer
    split = spark.createDataFrame([(float(v), 10 + 20 * (v > 5) + v % 3, 1) for v in range(20)], "v double, t int, e int")
    assert 4 < s.survival_cutpoint(split, "t", "e", "v").first()["cut"] < 7


def test_mantel_p(spark):
    import numpy as np

    r = np.random.default_rng(0)
    a = r.random((9, 9))
    a = a + a.T
    same, noise = s.mantel(a, a + 0.01, 199), s.mantel(a, (b := r.random((9, 9))) + b.T, 199)
    assert same[0] == pytest.approx(1) and same[1] <= 0.01 and noise[1] > 0.05


def test_even_split():
    one, other = s.even_split([5.0, 3.0, 2.0, 4.0, 6.0])
    assert sorted(one + other) == list(range(5)) and sum([5, 3, 2, 4, 6][i] for i in one) == 10
    with pytest.raises(ValueError, match="negative"):
        s.even_split([1.0, -1.0])
