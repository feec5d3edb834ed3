"""Connected components of a distributed graph, by alternating large and small stars.

Each round of stars is several jobs, however few edges are left. So as soon as they are at most LOCAL, which is checked before each round, one
task links them all; beyond that bound nothing is gathered anywhere. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselum.functions.lineage import cut, ship

#: Edges that one task links, at most: 8 MB of ids.
LOCAL = 500_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) to (node, root) of the nodes that aren't their component's smallest."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    ends = [np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1)]
    nodes, both = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = both[: len(ends[0])], both[len(ends[0]) :]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (up := root[root])).any():
            root = up
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["node", "root"])


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node among it and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node of its component, for each node with a smaller one in its component. edges: columns u, v.

    At most LOCAL edges are linked by one task. Else minima are partially aggregated and materialised, so that adaptive execution can split the hubs of the joins with
    them; each round is checkpointed. The number of rounds grows with the logarithm of the graph's diameter.
    """
    now = cut(edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v")).where("u <> v").distinct())
    ship(edges.sparkSession)
    mark, left = None, now.count()
    for _ in range(rounds):
        if left <= LOCAL:
            return cut(now.select("u", "v").coalesce(1).mapInArrow(_united, "node long, root long"))
        now = cut(_small(cut(_large(now), forget=True)).where(F.col("u") != F.col("v")).distinct(), forget=True)
        new = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(v, u), 1048573) as long))")).first()
        if new == mark:
            return now.toDF("node", "root")
        mark, left = new, new[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")
