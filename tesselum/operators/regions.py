"""Regions of interest: polygons as a small DataFrame rois(roi_id, name, sample_id, verts), and what they do to cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselum import model
from tesselum.functions import bits, geometry

def _c() -> Column:
    return F.col("cflag")


def _p() -> Column:
    return F.col("pflag")
#: Corners of regions that are broadcast, at most: some 32 MB; more are joined by sample.
MAX_CORNERS = 1_000_000

# Bits of the region flags beyond the standard ones.
GLEASON = {"3+3": 12, "3+4": 13, "4+3": 14, "4+4": 15, "5+5": 16}
PNI, SEMINAL_VESICLE = 17, 18


def _boxed(rois: DataFrame, order: str) -> DataFrame:
    ends = {f"_{c}_{k}": f(F.expr(f"transform(verts, v -> v.{c})")) for c in "xy" for k, f in (("low", F.array_min), ("high", F.array_max))}
    return rois.withColumns(ends).withColumnRenamed("sample_id", "_roi_sample").withColumnRenamed(order, "_roi_order")


def containing(df: DataFrame, rois: DataFrame, value: Column, order: str = "roi_id") -> DataFrame:
    """df with _hits: the value of each region of the cell's sample that holds the cell, in order. The regions of a sample travel to its cells as one array,
    broadcast while all have at most MAX_CORNERS corners."""
    corners = rois.agg(F.sum(F.size("verts") + 8)).first()[0] or 0
    boxed = _boxed(rois, order).withColumn("_value", value)
    per = boxed.groupBy("_roi_sample").agg(F.sort_array(F.collect_list(F.struct("_roi_order", "verts", "_x_low", "_x_high", "_y_low", "_y_high", "_value"))).alias("_rois"))
    out = df.join(F.broadcast(per) if corners <= MAX_CORNERS else per, F.col("sample_id") == F.col("_roi_sample"), "left")

    def hit(r: Column) -> Column:
        box = F.col("x").between(r["_x_low"], r["_x_high"]) & F.col("y").between(r["_y_low"], r["_y_high"])
        return F.when(box, geometry.inside(F.col("x"), F.col("y"), r["verts"])).otherwise(False)

    hits = F.transform(F.filter(F.coalesce("_rois", F.expr("array()").cast(per.schema["_rois"].dataType)), hit), lambda r: r["_value"])
    return out.withColumn("_hits", hits).drop("_rois", "_roi_sample")


def region_of(df: DataFrame, rois: DataFrame, name: str = "roi") -> DataFrame:
    """The id of the first region that holds the cell, -1 if none."""
    out = containing(df, rois, F.col("_roi_order"))
    return out.withColumn(name, F.coalesce(F.get("_hits", F.lit(0)), F.lit(-1))).drop("_hits")


def flag_regions(df: DataFrame, rois: DataFrame, bit: int, *, name: str | None = None, clear_first: bool = False) -> DataFrame:
    """Set a cflag bit on cells inside regions of three corners and more, whose name holds the given text."""
    chosen = rois.where(F.size("verts") >= 3)
    chosen = chosen.where(F.col("name").contains(name)) if name else chosen
    mask = bits.bit_mask(bit)
    base = bits.clear_bits(_c(), mask) if clear_first else _c()
    out = containing(df, chosen, F.lit(1))
    return out.withColumn("cflag", F.when(F.size("_hits") > 0, bits.set_bits(base, mask)).otherwise(base)).drop("_hits")


# What regions' names hold, in any place; the first letters are left out, as they may be capital.
_NORMAL, _TUMOR, _CD3_ERROR, _PNI, _SEMINAL, _DROP = "ormal", "umor", "cd3panck_error", "PNI", "eminal", "blacklist|artifact|error"


def apply_keywords(df: DataFrame, rois: DataFrame, *, cd3: int = 0, panck: int = 0) -> DataFrame:
    """Regions by keyword in their names, later ones over earlier: blacklists drop their cells (Artifact), normal tissue, tumour, the
    CD3 error (CD3 goes where PanCK is), Gleason grades, perineural invasion and seminal vesicles set their bits.

    Cells outside all regions stay; of several regions the last decides whether a cell stays.
    """
    text = F.concat_ws(" ", "name", "text") if "text" in rois.columns else F.col("name")
    has = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    kind = F.when(F.lower(text).rlike(_DROP) & ~has(_CD3_ERROR), "drop").when(has(_NORMAL), "normal").when(has(_TUMOR), "tumor").when(has(_CD3_ERROR), "cd3").otherwise("other")
    grade = F.lit(None).cast("int")
    for word, b in reversed([*GLEASON.items(), (_PNI, PNI), (_SEMINAL, SEMINAL_VESICLE)]):
        grade = F.when(has(word), b).otherwise(grade)
    out = containing(df, rois, F.struct(kind.alias("kind"), grade.alias("grade")))
    tumor, margin, manual, normal, artifact = model.TUMOR, model.MARGIN, model.TUMOR_MANUAL, model.NORMAL, model.ARTIFACT

    def step(a: Column, r: Column) -> Column:
        c, p = a["c"], a["p"]
        c = F.when(r["kind"] == "drop", bits.set_bits(c, artifact)).when(r["kind"] == "normal", bits.set_bits(bits.clear_bits(c, tumor | margin | manual), normal)).when(r["kind"] == "tumor", bits.set_bits(c, manual)).otherwise(c)
        p = F.when((r["kind"] == "cd3") & bits.has_all(p, panck), bits.clear_bits(p, cd3)).otherwise(p)
        graded = F.when(r["grade"] <= max(GLEASON.values()), bits.set_bits(c, manual)).otherwise(c)
        c = F.when(r["grade"].isNotNull(), graded.bitwiseOR(F.pow(F.lit(2.0), r["grade"]).cast("long"))).otherwise(c)
        return F.struct(c.alias("c"), p.alias("p"), (r["kind"] != "drop").alias("keep"))

    end = F.aggregate("_hits", F.struct(_c().alias("c"), _p().alias("p"), F.lit(True).alias("keep")), step)
    out = out.withColumn("_end", end).where("_end.keep")
    return out.withColumns({"cflag": F.col("_end.c"), "pflag": F.col("_end.p")}).select(*df.columns)


def region_info(rois: DataFrame, microns: float = 1.0) -> DataFrame:
    """id, name, sample, vertices, area, area_um2."""
    size = geometry.area(F.col("verts"))
    return rois.select(F.col("roi_id").alias("id"), "name", F.col("sample_id").alias("sample"), F.size("verts").alias("vertices"), size.alias("area"), (size * microns * microns).alias("area_um2"))


def move_regions(rois: DataFrame, **how) -> DataFrame:
    return rois.withColumn("verts", geometry.move(F.col("verts"), **how))


def shift_regions(rois: DataFrame, dx: float, dy: float) -> DataFrame:
    return move_regions(rois, dx=dx, dy=dy)


def add_regions(rois: DataFrame, more: DataFrame, *, scale: float = 1.0, mode: str = "refuse", **how) -> DataFrame:
    """More regions, in the table's units. mode where there are some already: add, overwrite or refuse."""
    if mode == "refuse" and not rois.isEmpty():
        raise ValueError("there are regions already; say add or overwrite")
    more = move_regions(more, scale=scale, **how)
    return more if mode == "overwrite" else rois.unionByName(more)


def remove_regions(rois: DataFrame, roi_id: int | None = None, name: str | None = None, sample: int | None = None) -> DataFrame:
    """Without the regions that fit all given conditions; without any, none stays."""
    cond = F.lit(True)
    for c, v in (("roi_id", roi_id), ("name", name), ("sample_id", sample)):
        cond = cond & (F.col(c) == v) if v is not None else cond
    return rois.where(~cond)
