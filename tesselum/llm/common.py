"""What the training-data operators share: tables, checkpoints, words."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.functions.lineage import cut, remove, shared_dir, ship

__all__ = ["LOWER", "UPPER", "WHITE", "bind", "cut", "free", "fresh", "join_split", "lower_ascii", "once", "remove", "shared_dir", "ship", "table", "words"]

#: The ASCII white space that separates words: \x20 and \x09 to \x0D.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; an empty array for null or blank text."""
    inner = F.btrim(F.coalesce(col, F.lit("")), F.lit(WHITE))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def bind(value: Column, use) -> Column:
    """use(value) with value computed once, whatever the optimizer inlines: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(col: Column) -> Column:
    """col, kept by the optimizer from being copied into filters and later projections, where it would be computed again."""
    return F.when(F.monotonically_increasing_id() >= 0, col)


#: Keys that join_split broadcasts, at most.
HOT = 10_000


def join_split(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """big joined (left or inner) with small, which has one row per key, so that a key that very many rows of big have isn't one task's.

    A key is hot if it has more than 1 / HOT of big's rows: fewer than HOT keys, whatever the data, so these rows of small are broadcast; of
    any other key few rows meet in a task. big is read three times.
    """
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull())
    total = big.count()
    hot = cut(counts.where(F.col("_n") * HOT > total).select(key))
    if hot.isEmpty():
        return big.join(small, key, how)
    few = F.broadcast(hot)
    own = cut(small.join(few, key, "left_semi"))
    cold = big.join(few, key, "left_anti").join(small.join(few, key, "left_anti"), key, how)
    return cold.unionByName(big.join(few, key, "left_semi").join(F.broadcast(own), key, how))


def free(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
