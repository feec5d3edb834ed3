"""Ingest of quantification tables: CSV with a header line to a typed cell table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselum import model
from tesselum.functions import bits


def roles(names: Sequence[str], markers: Sequence[str], x: str = "X", y: str = "Y", ignore: Sequence[str] = ()) -> dict[str, list[str]]:
    """Which column plays which role. First that fits: ignored, x, y, CellID, Region, IC, marker, gate (<marker>p; of another stem: dropped), meta."""
    out: dict[str, list[str]] = {k: [] for k in ("ignore", "x", "y", "id", "region", "marker", "gate", "meta")}
    for n in names:
        if n in ignore:
            out["ignore"].append(n)
        elif n == x:
            out["x"].append(n)
        elif n == y:
            out["y"].append(n)
        elif n == "CellID":
            out["id"].append(n)
        elif n == "Region":
            out["region"].append(n)
        elif n == "IC":
            out["meta"].append(n)
        elif n in markers:
            out["marker"].append(n)
        elif n.endswith("p"):
            if n[:-1] in markers:
                out["gate"].append(n)
        else:
            out["meta"].append(n)
    if not out["x"] or not out["y"]:
        raise ValueError(f"the table lacks the columns {x} and {y}")
    return out


def plain(name: str) -> str:
    return name.replace("-", "")


def _number(c: str) -> Column:
    """What stands there as a number, 0 for anything else."""
    return F.coalesce(F.trim(F.col(f"`{c}`")).try_cast("float"), F.lit(0).cast("float"))


def sample_number(path: str) -> int:
    """The digits after LSP in a file's name."""
    found = re.search(r"LSP([0-9]+)", path.rsplit("/", 1)[-1])
    if not found:
        raise ValueError(f"{path} names no sample")
    return int(found[1])


def read(spark: SparkSession, path: str, *, markers: Sequence[str], microns: float, unit: str, x: str = "X", y: str = "Y", ignore: Sequence[str] = (), sample: int | None = 0) -> tuple[DataFrame, model.Header]:
    """The cells of a CSV file and their header; a row with another number of fields than the header fails when it is read."""
    if microns <= 0 or unit not in ("micron", "pixel"):
        raise ValueError("microns must be above 0 and unit micron or pixel")
    if sample is None:
        sample = sample_number(path)
    first = spark.read.text(path).where(F.col("value").rlike("^[A-Za-z\"]")).first()
    if first is None:
        raise ValueError(f"{path} has no header line")
    names = [n.strip().strip('"') for n in first[0].split(",")]
    kinds = roles(names, markers, x, y, ignore)
    # read as lines, since the reader would fill short rows up
    lines = spark.read.text(path).where((F.col("value") != first[0]) & (F.trim("value") != ""))
    parts = F.split("value", ",")
    checked = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit(f"a row has not {len(names)} fields: "), F.col("value"))))
    rows = lines.select(checked.alias("_p")).select(*[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if kinds["id"]:
        cell = F.coalesce(F.trim(F.col(kinds["id"][0])).try_cast("double"), F.lit(0.0)).cast("long")
    else:
        cell = F.monotonically_increasing_id()
    order = {m: i for i, m in enumerate(kinds["marker"])}
    p = bits.either(*[F.when(_number(g) != 0, F.lit(bits.bit_mask(order[g[:-1]]))).otherwise(F.lit(0)) for g in kinds["gate"]])
    c = bits.either(*[F.when(_number(n) == 1, F.lit(model.TUMOR_MANUAL)).otherwise(F.lit(0)) for n in kinds["region"]], *[F.when(_number(n) != 0, F.lit(model.TLS)).otherwise(F.lit(0)) for n in kinds["meta"] if n == "IC"])
    data = [*kinds["marker"], *kinds["meta"]]
    df = rows.select(cell.alias("cell_id"), F.lit(sample).cast("long").alias("sample_id"), _number(x).alias("x"), _number(y).alias("y"), c.alias("cflag"), p.alias("pflag"), *[_number(n).alias(plain(n)) for n in data])
    df = df.withColumn("id", model.pack(F.col("sample_id"), F.col("cell_id")))
    header = model.Header().add("HD", MP=str(microns), UN=unit)
    for kind, cols in (("MA", kinds["marker"]), ("CA", kinds["meta"])):
        for n in cols:
            header = header.add(kind, ID=plain(n), TY="f")
    header = header.standard_flags().program(f"convert {path}")
    return df.select("id", "sample_id", "cell_id", "x", "y", "cflag", "pflag", *[plain(n) for n in data]), header


def schema(header: model.Header) -> T.StructType:
    """The Spark schema of a table with this header, roles and levels in the fields' metadata."""
    fixed = [T.StructField(n, t) for n, t in (("id", T.LongType()), ("x", T.FloatType()), ("y", T.FloatType()), ("cflag", T.LongType()), ("pflag", T.LongType()))]
    out = []
    for t in header.data:
        code = t.fields.get("TY", "f")
        kind = T.ArrayType(T.LongType()) if code == "B" else T._parse_datatype_string(model.TYPES[code])
        out.append(T.StructField(t.id, kind, metadata={"role": t.kind, **({"levels": t.fields["LV"].split(",")} if "LV" in t.fields else {})}))
    return T.StructType(fixed + out)
