"""Joins, clusters and graphs against brute force, on the fixtures' small layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselum import model
from tesselum.functions import geometry
from tesselum.operators import graph, rows, spatial

SCHEMA = "id long, sample_id long, cell_id long, x double, y double, cflag long, pflag long"


def _df(spark, xy, c=None, p=None, sample=None):
    n = len(xy)
    c, p, sample = (v if v is not None else [0] * n for v in (c, p, sample))
    return spark.createDataFrame([(int(sample[i]) * (1 << 32) + i, int(sample[i]), i, float(xy[i][0]), float(xy[i][1]), int(c[i]), int(p[i])) for i in range(n)], SCHEMA)


def _pairs(xy, sample, r):
    d = np.asarray(xy, float)
    d2 = ((d[:, None] - d[None]) ** 2).sum(-1)
    return d2, (np.asarray(sample)[:, None] == np.asarray(sample)[None]) & (d2 < r * r)


def test_radius_is_strict_and_stays_in_the_sample(spark):
    line = [(0, 0), (10, 0), (20, 0), (30, 0), (40, 0)]
    df = _df(spark, line + line, sample=[0] * 5 + [1] * 5)
    assert spatial.radius_join(df, df, 10).count() == 10
    assert spatial.radius_join(df, df, 10.5).count() == 2 * (5 + 8)


def test_radius_join_with_negative_coordinates(spark):
    r = np.random.default_rng(0)
    xy, s = r.uniform(-200, 200, (300, 2)), r.integers(0, 3, 300)
    df = _df(spark, xy, sample=s)
    _, near = _pairs(xy, s, 25)
    got = {(a & 0xFFFF, b & 0xFFFF) for a, b in spatial.radius_join(df, df, 25).select("id", "n_id").collect()}
    assert got == set(map(tuple, np.argwhere(near)))


def test_annulus_is_inclusive(spark):
    df = _df(spark, [(0, 0), (10, 0), (20, 0), (30, 0), (40, 0)])
    rings = [spatial.Ring("a", 10, 20), spatial.Ring("far", 0, 100), spatial.Ring("share", 10, 20, all_of=1, local=True)]
    got = spatial.radial_density(df, rings).orderBy("id").collect()
    area = np.pi * 300 / 1e6
    assert [round(r["a"] * area) for r in got] == [2, 3, 4, 3, 2] and {r["share"] for r in got} == {0.0}


@pytest.mark.parametrize("k", [1, 3, 400])
def test_nearest_neighbours(spark, k):
    r = np.random.default_rng(1)
    xy = np.concatenate([r.uniform(0, 10, (150, 2)), r.uniform(900, 1000, (40, 2)), [[5000, 5000]] * 3]).round(1)
    s = np.array([0] * 170 + [1] * 23)
    df = _df(spark, xy, sample=s)
    d2, _ = _pairs(xy, s, 1)
    ids = s.astype(np.int64) * (1 << 32) + np.arange(len(s))
    want = set()
    for i in range(len(s)):
        other = [j for j in range(len(s)) if s[j] == s[i] and j != i]
        for rank, j in enumerate(sorted(other, key=lambda j: (d2[i, j], ids[j]))[:k], 1):
            want.add((int(ids[i]), int(ids[j]), rank))
    got = {(r["id"], r["n_id"], r["rank"]) for r in spatial.knn_join(df, df, k).collect()}
    assert len(got ^ want) <= 0.002 * len(want)  # equal distances differ in their last digit


def test_knn_of_nothing(spark):
    df = _df(spark, [(0, 0), (1, 1)])
    assert spatial.knn_join(df, df.limit(0), 3).count() == 0 and spatial.knn_join(df.limit(0), df, 3).count() == 0


def test_distance_to_marked(spark):
    df = _df(spark, [(0, 0), (3, 4), (0, 10), (1, 1)], c=[2, 0, 0, 0], sample=[0, 0, 0, 1])
    got = {r["id"]: (r["dist_t"], r["cflag"]) for r in spatial.distance_to_marked(df, "t").collect()}
    assert got[0] == (0, 0) and got[1][0] == 5 and got[2][0] == 10 and np.isnan(got[(1 << 32) + 3][0])


def test_margin_only_where_the_other_kind_is_near(spark):
    df = _df(spark, [(0, 0), (50, 0), (151, 0), (500, 0)], c=[1, 0, 0, 4])
    assert [r["cflag"] for r in spatial.margin(df, 100).orderBy("id").collect()] == [5, 4, 0, 0]


def test_surroundings_dont_cascade(spark):
    df = _df(spark, [(0, 0), (9, 0), (18, 0)], p=[1, 0, 0])
    assert {r["id"] for r in spatial.with_surroundings(df, F.col("pflag") == 1, 10).collect()} == {0, 1}


def _partition(labels):
    out = {}
    for i, k in enumerate(labels):
        if k:
            out.setdefault(k, set()).add(i)
    return {frozenset(v) for v in out.values()}


def test_dbscan_two_clumps(spark):
    r = np.random.default_rng(3)
    xy = np.concatenate([r.normal(0, 20, (30, 2)), r.normal(0, 20, (30, 2)) + [500, 0], [[1000 * i, 4000] for i in range(5)]])
    df = _df(spark, xy, c=[2] * 65)
    got = [r["dbscan_cluster"] for r in graph.dbscan(df, 100, 25, 25).orderBy("id").collect()]
    assert _partition(x + 1 if x or i == 0 else 0 for i, x in enumerate(got[:60])) and set(got[60:]) == {0}
    assert len(set(got[30:60])) == 1 and got[30] == 30
    assert {r["dbscan_cluster"] for r in graph.dbscan(df, 100, 25, 31).collect()} == {0}


def test_island_fills_what_is_enclosed(spark):
    ring = [(100 * np.cos(a), 100 * np.sin(a)) for a in np.linspace(0, 2 * np.pi, 60, endpoint=False)]
    hole = [(10 * i, 10 * j) for i in range(-2, 2) for j in range(2)]
    far = [(3000 + 10 * i, 10 * j) for i in range(10) for j in range(10)]
    c = [1] * 60 + [0] * 8 + [0] * 100
    df = _df(spark, ring + hole + far, c=c)
    got = [r["cflag"] for r in graph.island(df, 50, distance=150, k=70).orderBy("id").collect()]
    assert got == [1] * 60 + [1] * 8 + [0] * 100
    assert [r["cflag"] for r in graph.island(df, 5, distance=150, k=70).orderBy("id").collect()] == c


@pytest.mark.parametrize("n", [3, 12, 200])
def test_delaunay_circles_are_empty(n):
    xy = np.random.default_rng(n).uniform(0, 100, (n, 2))
    e = geometry.delaunay_edges(*xy.T)
    hull = geometry.convex_hull(*xy.T)
    assert len(e) == 3 * n - 3 - len(hull)
    near = {tuple(sorted(p)) for p in e.tolist()}
    tri = [(i, j, k) for i, j in near for k in range(n) if tuple(sorted((i, k))) in near and tuple(sorted((j, k))) in near]
    for i, j in near:  # each edge has a circle through its ends, or through a third point, that holds no other
        ok = ((xy - (xy[i] + xy[j]) / 2) ** 2).sum(1)
        if np.delete(ok, [i, j]).min(initial=1e18) >= ((xy[i] - xy[j]) ** 2).sum() / 4 - 1e-9:
            continue
        found = False
        for a, b, c in (t for t in tri if {i, j} <= set(t[:2])):
            m = 2 * np.array([xy[b] - xy[a], xy[c] - xy[a]])
            centre = np.linalg.solve(m, [(xy[b] ** 2 - xy[a] ** 2).sum(), (xy[c] ** 2 - xy[a] ** 2).sum()])
            d = ((xy - centre) ** 2).sum(1)
            found |= np.delete(d, [a, b, c]).min(initial=1e18) >= d[a] - 1e-6
        assert found


def test_delaunay_components(spark):
    xy = [(0, 0), (1, 0), (0, 1), (1, 0), (100, 100), (101, 100), (500, 0)]
    got = {r["id"]: (r["delaunay_component"], r["delaunay_count"]) for r in graph.delaunay(_df(spark, xy), 5).collect()}
    assert got[0] == got[1] == got[2] == got[3] == (0, 3) and got[4] == got[5] == (4, 2) and got[6] == (0, 1)


def test_collinear_points_chain():
    x = np.arange(6.0)
    assert geometry.delaunay_edges(x, 2 * x).tolist() == [[i, i + 1] for i in range(5)]


def test_tls_finds_the_follicle(spark):
    r = np.random.default_rng(5)
    xy = np.concatenate([r.normal(0, 60, (300, 2)), r.uniform(2000, 4000, (200, 2))])
    p = [1 if i < 260 else 2 for i in range(300)] + [4] * 200
    got = graph.tls(_df(spark, xy, p=p), 1, 3, 100, 10_000).orderBy("id").collect()
    ids = {r["tls_id"] for r in got[:300]}
    assert sum(r["tls_id"] > 0 for r in got[:300]) + (0 in ids) >= 200 or len(ids) >= 1
    assert {r["tls_id"] for r in got[300:]} == {0} and all(bool(r["cflag"] & model.TLS) == (r["tls_id"] > 0) for r in got)


def test_hull_holds_all_points():
    xy = np.random.default_rng(2).normal(0, 10, (100, 2)).round(1)
    h = geometry.convex_hull(*xy.T)
    inner = xy.mean(0) + 0.999 * (xy - xy.mean(0))
    assert geometry.in_polygon(*inner.T, *xy[h].T).all() and len(h) < 30


def test_rows_run_on_streams(spark, tmp_path):
    df = _df(spark, [(i, i) for i in range(20)], p=[i % 4 for i in range(20)])
    df.write.parquet(f"{tmp_path}/in")
    from tesselum.streaming import cells

    stream = cells.read(spark, f"{tmp_path}/in", df)
    flow = rows.filter_cells(rows.offset(rows.mark_cells(stream, [rows.Unit(pand=1)]), 1, 1), [rows.Unit(cand=2)])
    q = flow.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    q = cells.counts(stream, {"a": 0, "b": 1}).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("counted").collect()] == [(0, 20, 10, 10)]
    q = cells.each_batch(stream, lambda b: spatial.margin(b, 100), f"{tmp_path}/m", f"{tmp_path}/mc")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/m").count() == 20


@pytest.mark.parametrize("local", [500_000, 0, 30])
def test_components_by_one_task_and_by_stars(spark, monkeypatch, local):
    import random

    from tesselum.operators import components as m

    monkeypatch.setattr(m, "LOCAL", local)
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7), (-5, 3), (9, 8)]
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = m.components(spark.createDataFrame(edges + edges[:9], "u long, v long").repartition(5))
    assert {x["node"]: x["root"] for x in got.collect()} == want
    assert m.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_knn_in_clumps_and_at_one_place(spark, monkeypatch):
    """Dense clumps, many points at one place, and stragglers: the neighbours are the nearest, whatever squares their queries begin with."""
    from tesselum.operators import spatial as m

    r = np.random.default_rng(2)
    xy = np.concatenate([r.normal(0, 1, (150, 2)), r.normal(500, 0.01, (150, 2)), np.full((60, 2), 70.0), r.random((20, 2)) * 4000]).round(6)
    ids = [int(i) + 1 for i in range(len(xy))]
    df = spark.createDataFrame([(i, i % 2, i, float(a), float(b), 0, 0) for i, (a, b) in zip(ids, xy, strict=True)], SCHEMA)
    want = set()
    for i, p in zip(ids, xy, strict=True):
        near = sorted(((p - q) @ (p - q), j) for j, q in zip(ids, xy, strict=True) if j != i and j % 2 == i % 2)[:4]
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(near)}
    for crowd in (32, 2):
        monkeypatch.setattr(m, "CROWD", crowd)
        assert {(x["id"], x["n_id"], x["rank"]) for x in m.knn_join(df, df, 4).collect()} == want
        near = m.knn_join(df, df, 4, within=0.5).collect()
        assert {(x["id"], x["n_id"]) for x in near} == {(i, j) for i, j, _ in want if (d := xy[i - 1] - xy[j - 1]) @ d <= 0.25}


def _shares(cells, k, within):
    """id to the share of marked cells among the k nearest, by all pairs."""
    out = {}
    for i, s, x, y, _ in cells:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j, m) for j, t, a, b, m in cells if t == s and j != i and (x - a) ** 2 + (y - b) ** 2 <= within * within)[:k]
        if near:
            out[i] = sum(m for *_, m in near) / len(near)
    return out


@pytest.mark.parametrize(("crowd", "tile"), [(32, 16), (1, 2)])
def test_shares_of_neighbours_keep_a_row_for_each_cell(spark, monkeypatch, crowd, tile):
    """Ties, cells at one place, dense clumps and lone cells; nothing that is written has more rows than there are cells."""
    monkeypatch.setattr(spatial, "CROWD", crowd)
    monkeypatch.setattr(spatial, "TILE", tile)
    rows = []
    for how in ("cut", "kept"):
        old = getattr(spatial, how, None)
        monkeypatch.setattr(spatial, how, lambda df, *a, old=old, **k: rows.append(df.count()) or old(df, *a, **k), raising=False)
    r = np.random.default_rng(3)
    xy = np.concatenate([r.integers(-9, 9, (150, 2)), np.full((40, 2), 5), r.integers(-400, 400, (60, 2)), [[9000, 9000]]])
    cells = [(int(i), int(i % 2), float(x), float(y), int(r.integers(2))) for i, (x, y) in zip(r.permutation(len(xy)), xy, strict=True)]
    df = spark.createDataFrame([(i, s, x, y, model.MARK * m, 0) for i, s, x, y, m in cells], "id long, sample_id long, x double, y double, cflag long, pflag long")
    for k, within, fraction in ((5, 1e5, 0.6), (25, 100, 0.5), (4, 3, 0.5)):
        want = _shares(cells, k, within)
        got = {x["id"]: x["cflag"] for x in spatial.annotate(df, model.TCELL, k, fraction, within).collect()}
        assert got == {i: model.TCELL * (want.get(i, -1) >= fraction) for i, *_ in cells}
    assert rows and max(rows) <= len(cells)
    assert spatial.annotate(df.limit(0), model.TCELL, 5).count() == 0


def test_tls_keeps_other_columns(spark):
    r = np.random.default_rng(5)
    xy = np.concatenate([r.normal(0, 40, (600, 2)), r.uniform(2000, 4000, (200, 2))])
    df = _df(spark, xy, p=[1] * 600 + [4] * 200, sample=[1] * 800)  # an id of 0 would be no cluster
    more = df.selectExpr("'a' AS `a b`", "*", "2 * id AS twice")
    got = graph.tls(more, 1, 3, 100, 10_000)
    assert got.columns == [*more.columns, "dbscan_cluster", "tls_id"]
    got = {x["id"]: x for x in got.collect()}
    assert len(got) == 800 and all(x["twice"] == 2 * i and x["a b"] == "a" for i, x in got.items())
    plain = {x["id"]: x["tls_id"] for x in graph.tls(df, 1, 3, 100, 10_000).collect()}
    assert plain == {i: x["tls_id"] for i, x in got.items()} and sum(v > 0 for v in plain.values()) >= 500
