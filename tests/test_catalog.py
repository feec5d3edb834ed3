"""Every query against its SQL, on the smallest tables; the others by rows and by what must hold."""

import math

import duckdb
import pytest

from tesselum.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(([_plain(r[c]) for c in names] for r in df.collect()), key=str)
    assert got == sorted(([_plain(v) for v in r] for r in want.fetchall()), key=str)


def test_only_what_sql_cannot_express_has_none():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"cox_hazards", "delaunay_edges", "lda_topics", "tls_calls"}


def test_edges_of_the_triangulation(spark, sf):
    """Between places, no longer than asked, and none of its circles through both ends that holds another place is needed: some empty circle has both on it."""
    import numpy as np

    from tesselum.plans.adapter import clumps

    places = {}
    for r in clumps(spark, sf).collect():
        places.setdefault(r["sample_id"], {})[r["id"]] = (r["x"], r["y"])
    edges = catalog.queries()["delaunay_edges"](spark, sf).collect()
    assert edges
    for e in edges:
        (ax, ay), (bx, by) = places[e["sample_id"]][e["a"]], places[e["sample_id"]][e["b"]]
        assert e["a"] < e["b"] and e["length"] == pytest.approx(math.hypot(ax - bx, ay - by)) and 0 < e["length"] <= 50
        # centres (a + b) / 2 + t * normal: each other place bounds t from one side
        p = np.unique(np.array([v for v in places[e["sample_id"]].values() if v not in ((ax, ay), (bx, by))]), axis=0)
        if not len(p):
            continue
        d, n = np.array([bx - ax, by - ay]), np.array([ay - by, bx - ax])
        rel = p - [(ax + bx) / 2, (ay + by) / 2]
        side, power = rel @ n, (rel**2).sum(axis=1) - (d @ d) / 4
        low = max([-math.inf, *(power[side < 0] / (2 * side[side < 0]))])
        high = min([math.inf, *(power[side > 0] / (2 * side[side > 0]))])
        assert low <= high + 1e-6 and not (power[side == 0] < -1e-9).any()


def test_lymphoid_structures(spark, sf):
    """TLS cells are those with a structure; structures are of the least size, and hold their clusters."""
    got = catalog.queries()["tls_calls"](spark, sf).collect()
    assert got and all(((r["cflag"] & 32) != 0) == (r["tls_id"] > 0) and (r["cflag"] & 2) == 0 for r in got)
    sizes = {}
    for r in got:
        sizes[r["tls_id"]] = sizes.get(r["tls_id"], 0) + 1
    assert all(n >= 30 for t, n in sizes.items() if t)


def test_topics(spark, sf):
    for r in catalog.queries()["lda_topics"](spark, sf).collect():
        assert math.isclose(sum(r[f"topic{i}"] for i in range(1, 5)), 1, abs_tol=1e-6)


def test_hazards_maximise_the_likelihood(spark, sf):
    import numpy as np

    got = {r["covariate"]: r for r in catalog.queries()["cox_hazards"](spark, sf).collect()}
    rows = catalog._orders(spark, sf).collect()
    t, e = np.array([r["t"] for r in rows]), np.array([r["e"] for r in rows])
    x = np.array([[float(r["g"] == "a"), r["price"] / 100_000] for r in rows])

    def likelihood(b):
        w = np.exp(x @ b)
        order = np.argsort(-t, kind="stable")
        total = np.zeros(len(t))
        at = np.cumsum(w[order])
        last = {v: i for i, v in enumerate(t[order])}
        total = np.array([at[last[v]] for v in t])
        return ((x @ b - np.log(total)) * e).sum()

    best = np.array([got["in_a"]["coef"], got["price"]["coef"]])
    here = likelihood(best)
    for step in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]):
        assert likelihood(best + step) < here
    assert all(r["hazard_ratio"] == pytest.approx(math.exp(r["coef"]), abs=1e-5) and 0 <= r["p"] <= 1 for r in got.values())


def test_entry_without_the_training_data_operators(monkeypatch):
    """Whatever keeps them from being imported, the engine's own queries stay."""
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "tesselum.llm", None)
    monkeypatch.setitem(sys.modules, "tesselum.llm.registry", None)
    assert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
