"""Cohort tables: contingency of flags, and compartments with painted area and density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselum import model
from tesselum.functions import bits, geometry
from tesselum.operators.aggregates import category_flags, joint_flags

ALL = -1


def _compartments(df: DataFrame) -> DataFrame:
    """Each cell once per compartment: all cells (-1), and each structure bit that it has."""
    return df.withColumn("compartment", F.explode(F.concat(F.array(F.lit(ALL)), bits.bits_of(F.col("cflag")))))


def painted_area(df: DataFrame, radius: float = 20.0, pixel: float = 1.0) -> DataFrame:
    """(sample_id, compartment, n, area_mm2, density): the union of discs around the cells of each compartment, in pixels.

    Each compartment has its own origin, as its least x and y less the radius. A disc is a list of rows of pixels, and the area is the length of the
    union of all rows' segments: cells at one pixel are merged first, then a running maximum per row of pixels adds up what each
    segment adds. So there is a row per cell and disc row, not per pixel.
    """
    cells = _compartments(df.select("sample_id", "x", "y", "cflag"))
    key = ["sample_id", "compartment"]
    origin = cells.groupBy(*key).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.count(F.lit(1)).alias("n"))
    at = lambda c: F.round((F.col(c) - F.col(f"_{c}0") + radius) / pixel).cast("long")
    places = cells.join(origin, key).select(*key, at("x").alias("ix"), at("y").alias("iy")).distinct()
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dy, w in geometry.disc(radius / pixel)])
    spans = places.withColumn("_r", F.explode(rows)).select(*key, (F.col("iy") + F.col("_r.dy")).alias("row"), (F.col("ix") - F.col("_r.w")).alias("lo"), (F.col("ix") + F.col("_r.w") + 1).alias("hi"))
    spans = spans.groupBy(*key, "row", "lo").agg(F.max("hi").alias("hi"))
    before = F.max("hi").over(Window.partitionBy(*key, "row").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("hi") - F.greatest("lo", F.coalesce("_top", "lo")), F.lit(0))
    pixels = spans.withColumn("_top", before).groupBy(*key).agg(F.sum(new).alias("pixels"))
    area = F.col("pixels") * (pixel * pixel / 1e6)
    return origin.join(pixels, key).select(*key, "n", "pixels", area.alias("area_mm2"), F.when(area > 0, F.col("n") / F.when(area > 0, area)).otherwise(0.0).alias("density"))


def boxes(df: DataFrame) -> DataFrame:
    return df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_cells"), *[f(c).alias(f"{c}_{k}") for c in "xy" for k, f in (("min", F.min), ("max", F.max))])


def free_bits(df: DataFrame, header: model.Header, n: int) -> list[int]:
    """The lowest cflag bits that neither data nor header use."""
    used = df.agg(F.bit_or("cflag")).first()[0] or 0
    named = {int(t.fields["BI"]) for t in header.of("FL") if t.fields.get("RG") == "cflag"}
    return [b for b in range(64) if b not in named and not used >> b & 1][:n]


def membership_bits(df: DataFrame, header: model.Header, category: str) -> tuple[DataFrame, model.Header]:
    """Two free bits for category != 0 and = 0, where both kinds are there."""
    both = df.agg(F.count_if(F.col(category) == 0).alias("zero"), F.count_if(F.col(category) != 0).alias("other")).first()
    found = free_bits(df, header, 2)
    if not both["zero"] or not both["other"] or len(found) < 2:
        return df, header
    on = [bits.bit_mask(b) for b in found]
    c = F.col("cflag").bitwiseOR(F.when(F.col(category) != 0, F.lit(on[0])).otherwise(F.lit(on[1])))
    for b, what in zip(found, (f"{category}!=0", f"{category}=0"), strict=True):
        header = header.add("FL", ID=what, RG="cflag", BI=str(b))
    return df.withColumn("cflag", c), header


def cohort_json(df: DataFrame, header: model.Header, categories: list[str] = (), radius: float = 20.0, pixel: float = 1.0, group: Column | None = None) -> DataFrame:
    """(sample_id, json): one document per sample, of compartments, joint and per-category flag histograms. x and y in microns."""
    if problems := header.check():
        raise ValueError("; ".join(problems))
    scaled = df.withColumns({c: F.col(c) * header.microns for c in "xy"})
    for c in categories:
        scaled, header = membership_bits(scaled, header, c)
    lists = lambda rows, name, *cols: rows.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = boxes(scaled).join(lists(painted_area(scaled, radius, pixel), "compartments", "compartment", "n", "area_mm2", "density"), "sample_id", "left")
    out = out.join(lists(joint_flags(scaled), "flag_histogram", "cflag", "pflag", "n"), "sample_id", "left")
    for c in categories:
        out = out.join(lists(category_flags(scaled, c), f"cat_{c}", "level", "cflag", "pflag", "n"), "sample_id", "left")
    names = {r: F.array(*[F.struct(F.lit(int(t.fields["BI"])).alias("bit"), F.lit(t.id).alias("name")) for t in header.of("FL") if t.fields.get("RG") == r]) for r in ("cflag", "pflag")}
    box = F.struct(*[F.col(f"{c}_{k}") for c in "xy" for k in ("min", "max")])
    cats = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"cat_{c}").alias("histogram")) for c in categories]) if categories else F.array()
    doc = F.struct("sample_id", (group if group is not None else F.lit("")).alias("group"), "n_cells", box.alias("bbox_um"), names["cflag"].alias("cflag_bits"), names["pflag"].alias("pflag_bits"), "compartments", "flag_histogram", cats.alias("catcols"))
    return out.select("sample_id", F.to_json(doc).alias("json"))


def convolve(df: DataFrame, width: int, microns: float) -> DataFrame:
    """(sample_id, i, j_from, j_to, n): of the image's occupied pixels int(x / microns), int(y / microns), those in the window of width // 2 to each side.

    Window sums from two running passes, along the rows and then the columns, of differences at the windows' edges: a row per occupied pixel and
    edge, not per pixel of the image. Pixels of equal counts come as runs j_from..j_to; empty windows are left out.
    """
    h = width // 2
    px = df.select("sample_id", F.floor(F.col("x") / microns).cast("long").alias("i"), F.floor(F.col("y") / microns).cast("long").alias("j")).distinct()
    top = px.groupBy("sample_id").agg(F.max("i").alias("_i1"), F.max("j").alias("_j1"))
    rows = px.withColumn("i", F.explode(F.sequence(F.col("i") - h, F.col("i") + h))).join(top, "sample_id").where((F.col("i") >= 0) & (F.col("i") <= F.col("_i1")))
    edges = F.array(F.struct(F.greatest(F.col("j") - h, F.lit(0)).alias("j"), F.lit(1).alias("d")), F.struct((F.col("j") + h + 1).alias("j"), F.lit(-1).alias("d")))
    steps = rows.withColumn("_e", F.explode(edges)).groupBy("sample_id", "i", F.col("_e.j").alias("j_from"), "_j1").agg(F.sum("_e.d").alias("d"))
    w = Window.partitionBy("sample_id", "i").orderBy("j_from")
    runs = steps.withColumn("n", F.sum("d").over(w)).withColumn("j_to", F.least(F.lead("j_from").over(w) - 1, F.col("_j1")))
    return runs.where((F.col("n") > 0) & (F.col("j_from") <= F.col("j_to"))).select("sample_id", "i", "j_from", "j_to", "n")
