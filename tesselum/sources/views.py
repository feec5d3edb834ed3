"""Cells as lines of text: a DataFrame with the column line, in the order of id where it is shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum import model
from tesselum.operators import rows


def _cut(c: Column, decimals: int) -> Column:
    """Data values are truncated, not rounded."""
    scale = 10**decimals
    d = c.cast("double") * scale
    whole = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("double") / scale
    return F.format_string(f"%.{decimals}f", whole)


def _place(c: str, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", F.round(F.col(c).cast("double"), decimals))


def _columns(header: model.Header, style: str, fields: Sequence[str] | None, markers_only: bool, strict: bool) -> tuple[list[str], list[str]]:
    """The key columns and the data columns of a view."""
    names = header.markers if markers_only or style == "crevasse" else [t.id for t in header.data]
    names = [n for n in names if fields is None or n in fields]
    keys = [] if strict else ["cell_id", "x", "y"] if style == "crevasse" else ["sample_id", "cell_id", "cflag", "pflag", "x", "y"]
    return keys, names


def view(df: DataFrame, header: model.Header, *, style: str = "csv", fields: Sequence[str] | None = None, markers_only: bool = False, decimals: int = 2, strict: bool = False, justify: bool = False) -> DataFrame:
    """line per cell. style: csv (sample, cell, cflag, pflag, x, y, data), tab (the same), named (name:value of the same), crevasse (CellID, X, Y, markers).
    strict: the data columns alone; justify: each but the last padded to its widest value."""
    if style not in _BETWEEN:
        raise ValueError(f"no style {style}")
    keys, names = _columns(header, style, fields, markers_only, strict)
    cells = {k: _place(k, decimals) if k in ("x", "y") else F.col(k).cast("string") for k in keys}
    cells |= {n: _cut(F.col(n), decimals) for n in names}
    if style == "named":
        cells = {n: F.concat(F.lit(f"{n}:"), c) for n, c in cells.items()}
    if not justify:
        return df.select(F.concat_ws(_BETWEEN[style], *cells.values()).alias("line"))
    shown = df.select(*[c.alias(n) for n, c in cells.items()])
    widths = shown.agg(*[F.max(F.length(n)).alias(n) for n in cells]).first()  # a number per column
    padded = [F.rpad(n, widths[n] or 0, " ") if i + 1 < len(cells) else F.col(n) for i, n in enumerate(cells)]
    return shown.select(F.concat_ws(_BETWEEN[style], *padded).alias("line"))


#: What stands between the columns of a style.
_BETWEEN = {"csv": ",", "tab": "\t", "named": "\t", "crevasse": ","}


def header_lines(spark: SparkSession, header: model.Header) -> DataFrame:
    """The header alone: (n, line) in order."""
    lines = header.text().rstrip("\n").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


def with_header(df: DataFrame, header: model.Header, **how) -> DataFrame:
    """The header's lines and then the cells', as (part, line); part 0 is the header."""
    top = header_lines(df.sparkSession, header).select(F.lit(0).alias("part"), "line")
    return top.unionByName(view(df, header, **how).select(F.lit(1).alias("part"), "line"))


def head_line(header: model.Header, style: str = "csv") -> str:
    if style == "crevasse":
        return ",".join(["CellID", "X", "Y", *header.markers])
    return ",".join(["sid", "cid", "cflag", "pflag", "x", "y", *[t.id for t in header.data]])


def for_display(df: DataFrame, most: int = 4_000_000, seed: int = 0) -> DataFrame:
    """df, or about `most` of its cells by hash where it has more: what a viewer is given."""
    n = df.count()
    return df if n <= most else rows.subsample(df, most / n, seed)
