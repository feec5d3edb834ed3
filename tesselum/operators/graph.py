"""Clusters and graphs of cells: DBSCAN, islands, Delaunay components, tertiary lymphoid structures.

Clusters by distance link squares, not cells: in a grid so narrow that all cells of a square are near each other, two squares are linked
if any two of their cells are near, which mostly their boxes tell; components are of squares, and no table of pairs of cells is made.
Components of a triangulation's short edges are such clusters too, as its minimum spanning tree lies in it. Only the list of a
triangulation's edges runs in one task per sample, and hulls in one per cluster; both take coordinates only.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselum import model
from tesselum.functions import bits, geometry
from tesselum.functions.lineage import cut, kept, remove, shared_dir, ship
from tesselum.operators.components import components
from tesselum.operators.spatial import annotated, knn_join, marked_shares, radius_join

def _c() -> Column:
    return F.col("cflag")
_XY = ["sample_id", "id", "x", "y"]


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) of all nodes; a node without edges is its own root."""
    roots = components(edges)
    return nodes.join(roots, nodes["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"))


_SQUARE = ["sample_id", "_sx", "_sy"]


def _squares(points: DataFrame, reach: float) -> DataFrame:
    """points with their square (_sx, _sy) of a grid so narrow that any two in a square are nearer than reach."""
    side = reach / math.sqrt(2) * (1 - 1e-9)
    return points.withColumns({"_sx": F.floor(F.col("x") / side).cast("long"), "_sy": F.floor(F.col("y") / side).cast("long")})


def _linked(points: DataFrame, reach: float, closed: bool = False) -> DataFrame:
    """(_SQUARE, node, root): the squares of the points, node the smallest id of each, root that of all squares linked to it.

    Squares are linked if two of their points are nearer than reach (closed: or as near). Boxes around the squares' points tell most links
    and gaps; only between the others points are compared, and those alone that are near the other box.
    """
    r2 = reach * reach
    near = (lambda d2: d2 <= r2) if closed else (lambda d2: d2 < r2)
    box = [f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))]
    boxes = cut(points.groupBy(*_SQUARE).agg(F.min("id").alias("node"), *box))
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)])
    ends = ["x0", "x1", "y0", "y1"]
    a = boxes.withColumn("_o", F.explode(half)).select("sample_id", F.col("_sx").alias("ax"), F.col("_sy").alias("ay"), (F.col("_sx") + F.col("_o.i")).alias("bx"), (F.col("_sy") + F.col("_o.j")).alias("by"), F.col("node").alias("u"), *[F.col(c).alias(f"a{c}") for c in ends])
    b = boxes.select("sample_id", F.col("_sx").alias("bx"), F.col("_sy").alias("by"), F.col("node").alias("v"), *[F.col(c).alias(f"b{c}") for c in ends])
    both = a.join(b, ["sample_id", "bx", "by"])
    least, most = F.lit(0.0), F.lit(0.0)
    for c in "xy":
        gap = F.greatest(F.col(f"b{c}0") - F.col(f"a{c}1"), F.col(f"a{c}0") - F.col(f"b{c}1"), F.lit(0.0))
        span = F.greatest(F.col(f"b{c}1") - F.col(f"a{c}0"), F.col(f"a{c}1") - F.col(f"b{c}0"))
        least, most = least + gap * gap, most + span * span
    both = cut(both.where(near(least)).withColumn("sure", near(most)))
    to_box = lambda k: sum((g * g for c in "xy" for g in [F.greatest(F.col(f"{k}{c}0") - F.col(c), F.col(c) - F.col(f"{k}{c}1"), F.lit(0.0))]), F.lit(0.0))
    some = both.where("not sure").select("sample_id", "ax", "ay", "bx", "by", "u", "v", *[f"{k}{c}" for k in "ab" for c in ends])
    place = points.select(*_SQUARE, "x", "y")
    left = some.join(place.toDF("sample_id", "ax", "ay", "x", "y"), ["sample_id", "ax", "ay"]).where(near(to_box("b"))).select("sample_id", "bx", "by", "u", "v", *[f"a{c}" for c in ends], F.col("x").alias("px"), F.col("y").alias("py"))
    pairs = left.join(place.toDF("sample_id", "bx", "by", "x", "y"), ["sample_id", "bx", "by"]).where(near(to_box("a")))
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    found = pairs.where(near(dx * dx + dy * dy)).select("u", "v").distinct()
    roots = components(both.where("sure").select("u", "v").union(found))
    return cut(boxes.join(roots, "node", "left").select(*_SQUARE, "node", F.coalesce("root", "node").alias("root")))


def dbscan(df: DataFrame, eps: float = 100, min_points: int = 25, min_size: int = 100, name: str = "dbscan_cluster") -> DataFrame:
    """Clusters of the marked cells: the smallest id of a core cell, 0 for noise, unmarked cells and clusters below min_size.

    A cell is core with min_points cells nearer than eps, itself included; a border cell joins the smallest of its core neighbours' clusters. All
    cells of a square with min_points are core; neighbours are counted for the others only, which are few in each square.
    """
    points = cut(_squares(df.where(bits.has_any(_c(), model.MARK)).select(*_XY), eps))
    full = points.groupBy(*_SQUARE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).drop("_n")
    dense, rest = points.join(full, _SQUARE, "left_semi"), cut(points.join(full, _SQUARE, "left_anti"))
    some = radius_join(rest.select(*_XY), points, eps, few=True).groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).select("id")
    some = cut(some)
    core = cut(dense.unionByName(rest.join(some, "id", "left_semi")))
    roots = core.join(_linked(core, eps).drop("node"), _SQUARE).select(*_XY, "root")
    roots = cut(roots)
    border = radius_join(rest.join(some, "id", "left_anti").select(*_XY), roots, eps, ["root"], few=True).groupBy("id").agg(F.min("n_root").alias("root"))
    found = cut(roots.select("id", "root").unionByName(border))
    large = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("root")
    found = found.join(large, "root", "left_semi").select("id", F.col("root").alias(name))
    return df.drop(name).join(found, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long")).select(*[c for c in df.columns if c != name], name)


def island(df: DataFrame, size: int = 100, *, stroma: bool = False, flag: int = model.TUMOR, distance: float = 100, k: int = 10) -> DataFrame:
    """Fill islands: components of cells without the flag (stroma: with it), by k nearest among themselves nearer than
    distance, that are smaller than size and touch a cell of the other kind, flip the flag. Margin is cleared on all."""
    df = df.withColumn("cflag", bits.clear_bits(_c(), model.MARGIN))
    has = bits.has_all(_c(), flag)
    inside = has if stroma else ~has
    own = df.where(inside)
    # the distance is exclusive
    edges = knn_join(own, own, k, within=distance).where(F.col("d2") < distance * distance).select(F.col("id").alias("u"), F.col("n_id").alias("v"))
    roots = cut(_rooted(own.select("id"), edges))
    near = knn_join(own, df, k, ["cflag"], within=distance).where(F.col("d2") < distance * distance)
    other = bits.has_all(F.col("n_cflag"), flag)
    touch = near.where(~other if stroma else other).select("id").distinct().withColumn("t", F.lit(1))
    flips = roots.join(touch, "id", "left").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t")).where((F.col("n") < size) & F.col("t").isNotNull())
    flip = roots.join(flips.select("root"), "root", "left_semi").select("id", F.lit(True).alias("_flip"))
    new = bits.clear_bits(_c(), flag) if stroma else bits.set_bits(_c(), flag)
    # what follows reads the cells many times, and this much lineage is costly to plan
    return cut(df.join(flip, "id", "left").withColumn("cflag", F.when(F.col("_flip"), new).otherwise(_c())).select(*df.columns), forget=True)


def delaunay(df: DataFrame, limit: float) -> DataFrame:
    """delaunay_component and delaunay_count: components of the triangulation's edges of length up to limit. The component is its smallest
    id, or 0 of a cell alone; the count is of distinct places. Cells at one place share a component.

    No triangulation is made: cells within limit of each other are connected by edges of the triangulation no longer than that, since it
    holds a minimum spanning tree, so the components are those of all pairs within limit.
    """
    places = cut(_squares(df.groupBy("sample_id", "x", "y").agg(F.min("id").alias("id")), limit))
    linked = _linked(places, limit, closed=True)
    sizes = places.groupBy(*_SQUARE).agg(F.count(F.lit(1)).alias("_n")).join(linked, _SQUARE)
    counts = sizes.groupBy("root").agg(F.sum("_n").alias("delaunay_count"))
    of = linked.join(counts, "root").select(*_SQUARE, F.when(F.col("delaunay_count") > 1, F.col("root")).otherwise(0).alias("delaunay_component"), "delaunay_count")
    return _squares(df, limit).join(of, _SQUARE).select(*df.columns, "delaunay_component", "delaunay_count")


def delaunay_edge_list(df: DataFrame, limit: float | None = None) -> DataFrame:
    """(sample_id, a, b, length): the edges between cells, a < b, one cell standing for those at its place."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id").drop_duplicates(["x", "y"])
        x, y, i = p["x"].to_numpy(float), p["y"].to_numpy(float), p["id"].to_numpy(np.int64)
        e = geometry.delaunay_edges(x, y)
        length = np.hypot(x[e[:, 0]] - x[e[:, 1]], y[e[:, 0]] - y[e[:, 1]])
        out = pd.DataFrame({"sample_id": p["sample_id"].iloc[0], "a": np.minimum(i[e[:, 0]], i[e[:, 1]]), "b": np.maximum(i[e[:, 0]], i[e[:, 1]]), "length": length})
        return out if limit is None else out[out["length"] <= limit]

    ship(df.sparkSession)
    return df.select(*_XY).groupBy("sample_id").applyInPandas(run, "sample_id long, a long, b long, length double")


def hulls(df: DataFrame, cluster: str) -> DataFrame:
    """(sample_id, cluster, verts, area) of each cluster above 0. Each cluster is first thinned, with
    partial aggregation, to the lowest and highest cell at each x: no other can be a corner."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p["x"].to_numpy(float), p["y"].to_numpy(float)
        h = geometry.convex_hull(x, y)
        hx, hy = x[h], y[h]
        size = abs((hx * np.roll(hy, -1) - hy * np.roll(hx, -1)).sum()) / 2
        return pd.DataFrame({"sample_id": [p["sample_id"].iloc[0]], "cluster": [p["cluster"].iloc[0]], "verts": [[{"x": a, "y": b} for a, b in zip(hx, hy, strict=True)]], "area": [size]})

    ship(df.sparkSession)
    rows = df.where(F.col(cluster) > 0).select("sample_id", F.col(cluster).alias("cluster"), "x", "y")
    ends = rows.groupBy("sample_id", "cluster", "x").agg(F.array_distinct(F.array(F.min("y"), F.max("y"))).alias("ys")).select("sample_id", "cluster", "x", F.explode("ys").alias("y"))
    return ends.groupBy("sample_id", "cluster").applyInPandas(run, f"sample_id long, cluster long, verts {geometry.VERTS}, area double")


def tls(df: DataFrame, b_cell: int, immune: int, min_size: int = 100, distance: float = 100) -> DataFrame:
    """Tertiary lymphoid structures: columns dbscan_cluster and tls_id, and the TLS bit.

    B cells (all bits) whose 25 nearest within distance are half B cells; of these and the others the cells whose 100 nearest within
    200 are a fifth such B cells; of those the immune ones (any bit) are clustered, and immune cells within a cluster's hull join it,
    the smallest cluster where hulls overlap. Structures below min_size go.
    """
    p, spark = F.col("pflag"), df.sparkSession
    where = f"{shared_dir(spark)}/tls-{uuid.uuid4().hex}"
    # each step's cells are kept without the other columns and go when the next one's are written
    cells = df.select(*_XY, "cflag", "pflag")

    def built(cells: DataFrame, mark: Column, k: int, fraction: float, reach: float, name: str) -> DataFrame:
        cells = cells.withColumn("cflag", bits.put_bits(_c(), model.MARK, mark))
        share, used = marked_shares(cells, bits.has_any(_c(), model.MARK), k, reach)
        out = kept(annotated(cells, share, model.BUILD_GRAPH, fraction), f"{where}/{name}")
        remove(spark, used)
        return out

    dense = bits.has_all(_c(), model.BUILD_GRAPH) & bits.has_all(p, b_cell)
    first = built(cells, bits.has_all(p, b_cell), 25, 0.5, distance, "first")
    second = first.withColumns({"cflag": bits.clear_bits(_c(), model.BUILD_GRAPH), "_dense": dense})
    second = built(second, F.col("_dense"), 100, 0.2, 200, "second").drop("_dense")
    remove(spark, f"{where}/first")
    chosen = bits.has_all(_c(), model.BUILD_GRAPH) & bits.has_any(p, immune)
    third = second.withColumn("cflag", bits.put_bits(bits.clear_bits(_c(), model.BUILD_GRAPH), model.MARK, chosen))
    clustered = kept(dbscan(third, 100, 25, 200), f"{where}/third")
    remove(spark, f"{where}/second")
    hull = hulls(clustered, "dbscan_cluster").select(F.col("sample_id").alias("_s"), F.col("cluster").alias("_hull"), "verts", *[f(F.expr(f"transform(verts, v -> v.{c})")).alias(f"_{c}_{k}") for c in "xy" for k, f in (("low", F.array_min), ("high", F.array_max))])
    box = F.col("x").between(F.col("_x_low"), F.col("_x_high")) & F.col("y").between(F.col("_y_low"), F.col("_y_high"))
    within = clustered.where(bits.has_any(p, immune)).join(hull, (F.col("sample_id") == F.col("_s")) & box)
    within = within.where(geometry.inside(F.col("x"), F.col("y"), F.col("verts"))).groupBy("id").agg(F.min("_hull").alias("_in"))
    out = clustered.join(within, "id", "left").withColumn("tls_id", F.when(F.col("dbscan_cluster") > 0, F.col("dbscan_cluster")).otherwise(F.coalesce("_in", F.lit(0))))
    large = out.where("tls_id > 0").groupBy("tls_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    out = out.join(large, "tls_id", "left").withColumn("tls_id", F.when(F.col("_n").isNotNull(), F.col("tls_id")).otherwise(F.lit(0).cast("long")))
    flags = bits.clear_bits(_c(), model.MARK)
    out = out.withColumn("cflag", F.when(F.col("tls_id") > 0, bits.set_bits(flags, model.TLS)).otherwise(flags))
    others = [c for c in df.columns if c not in (*_XY, "cflag", "pflag")]
    out = out.join(df.select("id", *others), "id") if others else out
    return out.select(*df.columns, "dbscan_cluster", "tls_id")


def neighbour_lists(df: DataFrame, k: int, name: str = "knn") -> DataFrame:
    """A graph column: array<struct<id, dist>> of the k nearest others, nearest first."""
    near = knn_join(df, df, k)
    lists = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("n_id").alias("nid"), F.sqrt("d2").alias("dist")))).alias("_l"))
    return df.join(lists, "id", "left").withColumn(name, F.expr("transform(_l, v -> struct(v.nid as id, v.dist as dist))")).drop("_l")
