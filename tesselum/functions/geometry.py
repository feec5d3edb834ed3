"""Plane geometry: polygons as array<struct<x, y>> columns, and numpy kernels for whole samples."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

VERTS = "array<struct<x: double, y: double>>"


def parse_vertices(text: Column) -> Column:
    """ "x,y x,y ..." as vertices; a malformed pair is left out."""

    def one(pair: Column) -> Column:
        p = F.split(pair, ",")
        return F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y"))

    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), one), lambda v: v["x"].isNotNull() & v["y"].isNotNull())


def inside(x: Column, y: Column, verts: Column) -> Column:
    """Even-odd rule: the parity of the edges that a ray to the right crosses."""
    n = F.size(verts)

    def crossings(total: Column, i: Column) -> Column:
        a, b = F.get(verts, i), F.get(verts, F.pmod(i + n - 1, n))
        spans = (a["y"] > y) != (b["y"] > y)
        at = F.when(spans, (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return total + F.when(spans & (x < at), 1).otherwise(0)

    return F.when(n >= 3, F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), crossings), F.lit(2)) == 1).otherwise(False)


def area(verts: Column) -> Column:
    """Shoelace formula."""
    n = F.size(verts)

    def cross(total: Column, i: Column) -> Column:
        a, b = F.get(verts, i), F.get(verts, F.pmod(i + 1, n))
        return total + (a["x"] * b["y"] - b["x"] * a["y"])

    return F.when(n >= 3, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), cross)) / 2).otherwise(0.0)


def move(verts: Column, scale: float = 1.0, invert_x: float | None = None, invert_y: float | None = None, dx: float = 0.0, dy: float = 0.0) -> Column:
    """Each vertex scaled, then mirrored at the given width or height, then shifted."""
    if scale <= 0:
        raise ValueError("the scale must be above 0")

    def one(v: Column) -> Column:
        x, y = v["x"] * scale, v["y"] * scale
        x = F.lit(float(invert_x)) - x if invert_x is not None else x
        y = F.lit(float(invert_y)) - y if invert_y is not None else y
        return F.struct((x + dx).alias("x"), (y + dy).alias("y"))

    return F.transform(verts, one)


def disc(radius: float) -> list[tuple[int, int]]:
    """(row, half-width) of the pixels of a disc: row dy reaches floor(sqrt(radius^2 - dy^2)) to either side."""
    top = math.floor(radius)
    return [(dy, math.isqrt(math.floor(radius * radius - dy * dy + 1e-9))) for dy in range(-top, top + 1)]


# ------------------------------------------------------------------ numpy kernels


def convex_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the hull's corners, counter-clockwise (monotone chain)."""
    order = np.lexsort((y, x))
    _, first = np.unique(np.stack([x[order], y[order]], axis=1), axis=0, return_index=True)
    pts = order[np.sort(first)]
    if len(pts) < 3:
        return pts

    def chain(ids) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) <= 0:
                out.pop()
            out.append(int(i))
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def in_polygon(px: np.ndarray, py: np.ndarray, vx: np.ndarray, vy: np.ndarray) -> np.ndarray:
    out = np.zeros(len(px), bool)
    j = len(vx) - 1
    for i in range(len(vx)):
        spans = (vy[i] > py) != (vy[j] > py)
        if vy[j] != vy[i]:
            out ^= spans & (px < (vx[j] - vx[i]) * (py - vy[i]) / (vy[j] - vy[i]) + vx[i])
        j = i
    return out


def _side(a: tuple[float, float], b: tuple[float, float], p: tuple[float, float]) -> float:
    """Above 0 where p lies left of a to b, below where right, 0 on the line: with the right sign, exact where floats can't tell."""
    left, right = (b[0] - a[0]) * (p[1] - a[1]), (b[1] - a[1]) * (p[0] - a[0])
    if abs(left - right) > 4e-15 * (abs(left) + abs(right)):
        return left - right
    (ax, ay), (bx, by), (px, py) = ([Fraction(v) for v in q] for q in (a, b, p))
    return float((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _in_circle(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float], p: tuple[float, float]) -> bool:
    """Whether p lies within the circle through a, b and c, which run against the clock; exact where floats can't tell."""

    def terms(number):
        px, py = map(number, p)
        (x, u), (y, v), (z, w) = ((number(q[0]) - px, number(q[1]) - py) for q in (a, b, c))
        return (x * x + u * u) * (y * w - z * v), (y * y + v * v) * (z * u - x * w), (z * z + w * w) * (x * v - y * u), (x * x + u * u) * (abs(y * w) + abs(z * v)) + (y * y + v * v) * (abs(z * u) + abs(x * w)) + (z * z + w * w) * (abs(x * v) + abs(y * u))

    one, two, three, size = terms(float)
    total = one + two + three
    if abs(total) > 1e-14 * size:
        return total > 0
    return sum(terms(Fraction)[:3]) > 0


def delaunay_edges(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The edges (n x 2 indices, i < j) of a Delaunay triangulation of distinct points.

    Incremental insertion in the order of a space-filling sweep; the triangle of a point is found by walking, and the cavity of
    triangles whose circumcircle holds it is retriangulated. Beyond each edge of the hull is a triangle with the point at infinity,
    whose circle is the half-plane outside. Collinear points give the chain along the line.
    """
    n = len(x)
    if n < 2:
        return np.zeros((0, 2), int)
    order = np.lexsort((y, x))
    at = list(zip(map(float, x), map(float, y), strict=True))
    # rows of a grid, left to right and back, keep walks short
    cells = max(1, int(math.sqrt(n / 2)))
    row = np.minimum((cells * (y - y.min()) / max(np.ptp(y), 1e-12)).astype(int), cells - 1)
    walk = [int(i) for i in np.lexsort((np.where(row % 2, -x, x), row))]
    a, b = walk[:2]
    third = next((p for p in walk[2:] if _side(at[a], at[b], at[p])), None)
    if third is None:
        return np.sort(np.stack([order[:-1], order[1:]], axis=1), axis=1)
    if _side(at[a], at[b], at[third]) < 0:
        a, b = b, a
    far = n  # the point at infinity
    tri: dict[int, tuple[int, int, int]] = {}
    of_edge: dict[tuple[int, int], int] = {}

    def put(k: int, t: tuple[int, int, int]) -> None:
        tri[k] = t
        of_edge[t[0], t[1]] = of_edge[t[1], t[2]] = of_edge[t[2], t[0]] = k

    for k, t in enumerate(((a, b, third), (b, a, far), (third, b, far), (a, third, far))):
        put(k, t)
    new_id, last = 4, 0

    def holds(t: tuple[int, int, int], p: int) -> bool:
        if far not in t:
            return _in_circle(at[t[0]], at[t[1]], at[t[2]], at[p])
        k = t.index(far)
        u, v, q = at[t[k - 2]], at[t[k - 1]], at[p]
        s = _side(u, v, q)
        return s > 0 or (s == 0 and min(u, v) < q < max(u, v))

    def found(p: int, start: int) -> int:
        """The triangle that p lies in, or one beyond an edge of the hull that it lies beyond."""
        t, before = start, None
        for _ in range(4 * len(tri) + 16):
            if far in tri[t]:
                return t
            u, v, w = tri[t]
            for e in ((u, v), (v, w), (w, u)):
                if e != before and _side(at[e[0]], at[e[1]], at[p]) < 0:
                    before = (e[1], e[0])
                    t = of_edge[before]
                    break
            else:
                return t
        return next(k for k, v in tri.items() if holds(v, p))

    for p in walk:
        if p in (a, b, third):
            continue
        start = found(p, last)
        bad, stack = {start}, [start]
        while stack:
            u, v, w = tri[stack.pop()]
            for e in ((v, u), (w, v), (u, w)):
                k = of_edge[e]
                if k not in bad and holds(tri[k], p):
                    bad.add(k)
                    stack.append(k)
        rim = [e for k in bad for u, v, w in (tri[k],) for e in ((u, v), (v, w), (w, u)) if of_edge[e[1], e[0]] not in bad]
        for k in bad:
            u, v, w = tri.pop(k)
            for e in ((u, v), (v, w), (w, u)):
                if of_edge.get(e) == k:
                    del of_edge[e]
        for u, v in rim:
            put(new_id, (u, v, p))
            if far not in (u, v):
                last = new_id
            new_id += 1
    edges = {(min(e), max(e)) for u, v, w in tri.values() for e in ((u, v), (v, w), (w, u)) if max(e) < n}
    return np.array(sorted(edges))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each point's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]
    return root
