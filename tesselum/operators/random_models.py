"""Null models and generators; all draw by ids and seeds, so they repeat whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum import model
from tesselum.functions.draws import PRIME, draw
from tesselum.functions.lineage import cut


def _numbered(df: DataFrame, order) -> DataFrame:
    """df with _n, its place in the order within its sample: range-sorted, counted per range, so no sample goes through one task."""
    at = cut(df.withColumn("_key", order).repartitionByRange("sample_id", "_key", "id").sortWithinPartitions("sample_id", "_key", "id").drop("_key").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    ranges = at.groupBy("sample_id", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    starts = ranges.alias("a").join(ranges.select("sample_id", F.col("_part").alias("_p"), F.col("_c").alias("_k")), "sample_id").groupBy("sample_id", "_part", "_first").agg(F.coalesce(F.sum(F.when(F.col("_p") < F.col("_part"), F.col("_k"))), F.lit(0)).alias("_before"))
    out = at.withColumn("_part", part).join(starts, ["sample_id", "_part"])
    return out.withColumn("_n", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def scramble(df: DataFrame, n_bits: int, seed: int = 0, *, whole: bool = False) -> DataFrame:
    """Permute pflag among the cells of a sample: each of the lowest n_bits by itself, or whole. Counts per bit stay."""
    base = cut(_numbered(df, draw(F.col("id"), seed)))
    out = base.withColumn("pflag", F.lit(0).cast("long"))
    for b in [None] if whole else range(n_bits):
        value = F.col("pflag") if b is None else F.col("pflag").bitwiseAND(1 << b)
        drawn = _numbered(df.select("sample_id", "id", value.alias("_v")), draw(F.col("id"), seed + 1, -1 if b is None else b)).select("sample_id", "_n", "_v")
        out = out.join(drawn, ["sample_id", "_n"]).withColumn("pflag", F.col("pflag").bitwiseOR(F.col("_v"))).drop("_v")
    return out.select(*df.columns)


def scatter(df: DataFrame, width: int, length: int, seed: int = 0) -> DataFrame:
    """x and y become uniform whole numbers of 0..width and 0..length."""
    one = lambda k, top: (draw(F.col("id"), seed, k) % (top + 1)).cast("double")
    return df.withColumns({"x": one(0, width), "y": one(1, length)})


def hallucinate(df: DataFrame, header: model.Header, n: int, seed: int = 0) -> tuple[DataFrame, model.Header]:
    """n zero markers in place of the markers, and one random phenotype bit of them per cell."""
    out = df.drop(*header.markers)
    names = [f"fake{i + 1}" for i in range(n)]
    out = out.withColumns({m: F.lit(0.0).cast("float") for m in names})
    bit = draw(F.col("id"), seed) % n
    out = out.withColumn("pflag", F.get(F.array(*[F.lit(1 << i) for i in range(n)]), bit.cast("int")).cast("long"))
    header = header.without(lambda t: t.kind != "MA")
    for m in names:
        header = header.add("MA", ID=m, TY="f")
    return out, header


def synthesise(spark: SparkSession, clusters: int, points: int, width: float = 1000.0, sigma: float = 10.0, seed: int = 0) -> tuple[DataFrame, model.Header]:
    """Gaussian clusters of cells around uniform centres, with one zero marker."""
    n = spark.range(clusters * points).withColumnRenamed("id", "cell_id")
    k = F.floor(F.col("cell_id") / points)
    unit = lambda what, by: (draw(by, seed, what) + 0.5) / float(PRIME)
    normal = lambda a, b: F.sqrt(-2 * F.log(unit(a, F.col("cell_id")))) * F.cos(6.283185307179586 * unit(b, F.col("cell_id")))
    cells = n.withColumns({"sample_id": F.lit(0).cast("long"), "x": unit(0, k) * width + sigma * normal(2, 3), "y": unit(1, k) * width + sigma * normal(4, 5)})
    cells = cells.withColumns({"id": model.pack(F.col("sample_id"), F.col("cell_id")), "cflag": F.lit(0).cast("long"), "pflag": F.lit(0).cast("long"), "marker1": F.lit(0.0).cast("float")})
    header = model.Header().add("HD", VN="1.0", MP="1", UN="micron").add("MA", ID="marker1", TY="f").program("synthesise")
    return cells.select("id", "sample_id", "cell_id", "x", "y", "cflag", "pflag", "marker1"), header
