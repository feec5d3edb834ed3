"""Parameter files: gates, density rings, palettes and regions. All are small and read on the driver through Spark's readers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.functions import geometry
from tesselum.operators.rows import Gates
from tesselum.operators.spatial import Ring


def _lines(spark: SparkSession, path: str) -> list[str]:
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip() and not r[0].startswith("#")]


def gates(spark: SparkSession, path: str) -> Gates:
    """marker,low,high lines; or, under a header with "Gate", the quoted marker in the second and the logarithm of the low gate in the third field."""
    out: Gates = {}
    lines = _lines(spark, path)
    if lines and "Gate" in lines[0]:
        for line in lines[1:]:
            f = [x.strip().strip('"') for x in line.split(",")]
            out[f[1].replace("-", "")] = (math.exp(float(f[2])), 1e8)
        return out
    if lines and lines[0].startswith("Sample"):
        raise ValueError("gates of several samples in one table aren't supported")
    for line in lines:
        f = line.split(",")
        out[f[0].strip()] = (float(f[1]), float(f[2]))
    return out


def rings(spark: SparkSession, path: str) -> list[Ring]:
    """inner,outer,any,all,local,global,label; lines that don't begin with a number are left out."""
    out = []
    for line in _lines(spark, path):
        f = [x.strip() for x in line.split(",")]
        if f[0][:1].isdigit():
            if len(f) != 7:
                raise ValueError(f"a ring needs seven fields: {line}")
            out.append(Ring(f[6], float(f[0]), float(f[1]), int(f[2]), int(f[3]), f[4] == "1"))
    return out


def palette(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """cflag,pflag,r,g,b,alpha,label in order, as rules for rows.palette."""
    return [(int(f[0]), int(f[1]), f[6].strip()) for f in (line.split(",") for line in _lines(spark, path)) if f[0].strip().lstrip("-").isdigit()]


def regions(spark: SparkSession, path: str, scale: float = 1.0, sample: int = 0) -> DataFrame:
    """rois from a quoted CSV with Id, Name, Text, type and all_points; rows without points are left out."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    points = F.col("all_points")
    ok = points.isNotNull() & (F.trim(points) != "") & (F.trim(points) != "-1")
    text = F.col("Text") if "Text" in rows.columns else F.lit("")
    out = rows.where(ok).select(F.col("Id").cast("long").alias("roi_id"), F.coalesce("Name", F.lit("")).alias("name"), F.coalesce(text, F.lit("")).alias("text"), F.lit(sample).cast("long").alias("sample_id"), geometry.parse_vertices(points).alias("verts"))
    return out.withColumn("verts", geometry.move(F.col("verts"), scale=scale))
