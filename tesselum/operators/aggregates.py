"""Counts, means, matrices and histograms; each is one pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselum.functions import bits


def count_cells(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """One row: n, and min, max and mean of the columns, min and max of the registers."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    flags = [f(c).alias(f"{c}_{n}") for c in ("cflag", "pflag") for n, f in (("min", F.min), ("max", F.max))]
    return df.agg(F.count(F.lit(1)).alias("n"), *stats, *flags)


def info(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: size, first three values in the order of id, min, max, mean."""
    one = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    stats = df.select(F.explode(one).alias("c")).groupBy("c.name").agg(F.count("c.value").alias("n"), F.min("c.value").alias("min"), F.max("c.value").alias("max"), F.avg("c.value").alias("mean"))
    # three rows
    top = df.orderBy("id").limit(3).select("id", F.explode(one).alias("c")).groupBy("c.name").agg(F.sort_array(F.collect_list(F.struct("id", "c.value"))).alias("l"))
    return stats.join(F.broadcast(top.select("name", F.transform("l", lambda v: v["value"]).alias("first"))), "name").select("name", "n", "first", "min", "max", "mean")


def mean(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Means of the columns, per whole number of `by`; no rows for an empty table."""
    each = [F.avg(c).alias(c) for c in columns]
    if by:
        return df.groupBy(F.col(by).cast("int").alias(by)).agg(*each)
    return df.groupBy(F.lit(0).alias("_all")).agg(*each).drop("_all")


def cell_count(df: DataFrame, markers: Sequence[str], masks: Sequence[int] = ()) -> DataFrame:
    """One row: <marker>_count of each phenotype bit, <mask>_count of the cells with all bits of a mask (0: of none at all)."""
    p = F.col("pflag")
    counts = [F.count_if(bits.bit(p, i) == 1).alias(f"{m}_count") for i, m in enumerate(markers)]
    counts += [F.count_if(bits.has_all(p, m) if m else p == 0).alias(f"{m}_count") for m in masks]
    return df.agg(*counts)


def _pairs(df: DataFrame, names: Sequence[str], value) -> DataFrame:
    """(a, b, value) from one row that has the values of all pairs."""
    pairs = list(combinations(range(len(names)), 2))
    row = df.agg(*value(pairs))
    each = F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"v{k}").alias("value")) for k, (i, j) in enumerate(pairs)])
    return row.select(F.explode(each).alias("p")).select("p.a", "p.b", "p.value")


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The upper triangle of the correlation matrix, NaN beside a constant column; from sums of centred values in one pass."""

    def value(pairs):
        out = []
        for k, (i, j) in enumerate(pairs):
            a, b = (F.col(columns[x]).cast("double") for x in (i, j))
            spread = F.stddev_pop(a) * F.stddev_pop(b)
            out.append(F.when(spread > 0, F.covar_pop(a, b) / F.when(spread > 0, spread)).otherwise(F.lit(float("nan"))).alias(f"v{k}"))
        return out

    return _pairs(df, columns, value)


def jaccard(df: DataFrame, markers: Sequence[str], subset: bool = False) -> DataFrame:
    """Of each two phenotype bits, |A and B| / |A or B|, or with subset / min(|A|, |B|); 0 where that is empty."""
    p = F.col("pflag")

    def value(pairs):
        out = []
        for k, (i, j) in enumerate(pairs):
            a, b = bits.bit(p, i) == 1, bits.bit(p, j) == 1
            under = F.least(F.count_if(a), F.count_if(b)) if subset else F.count_if(a | b)
            out.append(F.when(under > 0, F.count_if(a & b) / F.when(under > 0, under)).otherwise(0.0).alias(f"v{k}"))
        return out

    return _pairs(df, markers, value)


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n): equal bins of [low, high], the last closed; values outside are left out."""
    x = F.col(column).cast("double")
    b = F.least(F.floor((x - low) * (bins / (high - low))), F.lit(bins - 1)).cast("int")
    return df.where((x >= low) & (x <= high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def joint_flags(df: DataFrame) -> DataFrame:
    return df.groupBy("sample_id", "cflag", "pflag").agg(F.count(F.lit(1)).alias("n"))


def category_flags(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy("sample_id", F.col(category).alias("level"), "cflag", "pflag").agg(F.count(F.lit(1)).alias("n"))


def tiles(df: DataFrame, columns: Sequence[str], size: float = 400.0) -> DataFrame:
    """Counts and means per square frame; frames are numbered from 1."""
    frame = {f"frame_{c}": (F.floor(F.col(c) / size) + 1).cast("long") for c in ("x", "y")}
    return df.withColumns(frame).groupBy("sample_id", *frame).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def grid(df: DataFrame, columns: int, rows: int, width: float, height: float) -> DataFrame:
    """Counts in a grid over [0, width) x [0, height)."""
    ix, iy = F.floor(F.col("x") * (columns / width)).cast("int"), F.floor(F.col("y") * (rows / height)).cast("int")
    inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    return df.where(inside).groupBy(ix.alias("column"), iy.alias("row")).agg(F.count(F.lit(1)).alias("n"))


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "variable", "value")


def dcast(df: DataFrame, ids: Sequence[str], names: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.groupBy(*ids).pivot(variable, list(names)).agg(F.avg(value))


def derive_gates(df: DataFrame, markers: Sequence[str], high: float = 100_000.0) -> DataFrame:
    """(marker, low, high): the least value of each marker among the cells with its phenotype bit."""
    lows = F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"v{i}").alias("low")) for i, m in enumerate(markers)])
    row = df.agg(*[F.min(F.when(bits.bit(F.col("pflag"), i) == 1, F.col(m).cast("double"))).alias(f"v{i}") for i, m in enumerate(markers)])
    return row.select(F.explode(lows).alias("g")).select("g.marker", "g.low", F.lit(high).alias("high")).where("low is not null")


def regions(df: DataFrame, masks: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    """Per sample and named region (a condition; regions may overlap): cells and means."""
    named = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in masks.items()]), lambda r: r.isNotNull())
    return df.withColumn("region", F.explode(named)).groupBy("sample_id", "region").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
