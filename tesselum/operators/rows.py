"""Row-wise operators: selection, projection, flags, coordinates. All are narrow and run on streams too."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselum import model
from tesselum.functions import bits
from tesselum.functions.draws import PRIME, draw
from tesselum.functions.lineage import cut

def _c() -> Column:
    return F.col("cflag")


def _p() -> Column:
    return F.col("pflag")


@dataclass(frozen=True)
class Unit:
    """A flag predicate: all its parts must hold. por/cor: any of the bits; pand/cand: all; pnot/cnot: none."""

    por: int = 0
    pand: int = 0
    pnot: int = 0
    cor: int = 0
    cand: int = 0
    cnot: int = 0

    def column(self) -> Column:
        parts = [bits.has_any(r, m) for r, m in ((_p(), self.por), (_c(), self.cor)) if m]
        parts += [bits.has_all(r, m) for r, m in ((_p(), self.pand), (_c(), self.cand)) if m]
        parts += [bits.has_none(r, m) for r, m in ((_p(), self.pnot), (_c(), self.cnot)) if m]
        return reduce(and_, parts, F.lit(True))


#: (field, comparison, value); comparisons > < >= <= =.
Criterion = tuple[str, str, float]


def _criterion(df: DataFrame, c: Criterion) -> Column:
    name, op, value = c
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    x = F.col(name)
    return {">": x > value, "<": x < value, ">=": x >= value, "<=": x <= value, "=": x == value}[op]


def predicate(df: DataFrame, units: Sequence[Unit] = (), fields: Sequence[Criterion] = (), any_field: bool = False) -> Column:
    """Some unit, if there are any, and all (any_field: some) criteria."""
    flags = reduce(or_, [u.column() for u in units]) if units else F.lit(True)
    found = [_criterion(df, c) for c in fields]
    values = (reduce(or_, found) if found else F.lit(False)) if any_field else reduce(and_, found, F.lit(True))
    return flags & values


def filter_cells(df: DataFrame, units: Sequence[Unit] = (), fields: Sequence[Criterion] = (), any_field: bool = False) -> DataFrame:
    """The cells that pass, with Mark cleared."""
    return df.where(predicate(df, units, fields, any_field)).withColumn("cflag", bits.clear_bits(_c(), model.MARK))


def mark_cells(df: DataFrame, units: Sequence[Unit] = (), fields: Sequence[Criterion] = (), any_field: bool = False, mask: int = model.MARK) -> DataFrame:
    """All cells; the mask (Mark, or BuildGraph) is set on those that pass and cleared on the others."""
    return df.withColumn("cflag", bits.put_bits(_c(), mask, predicate(df, units, fields, any_field)))


def trim(df: DataFrame) -> DataFrame:
    return df.where(bits.has_any(_c(), model.MARK))


def crop(df: DataFrame, x_low: float, x_high: float, y_low: float, y_high: float) -> DataFrame:
    return df.where(F.col("x").between(x_low, x_high) & F.col("y").between(y_low, y_high))


def select_samples(df: DataFrame, samples: Sequence[int]) -> DataFrame:
    return df.where(F.col("sample_id").isin(*samples))


def cut_columns(df: DataFrame, header: model.Header, keep: Sequence[str]) -> tuple[DataFrame, model.Header]:
    """Only the named data columns, in header order."""
    unknown = set(keep) - {t.id for t in header.data}
    if unknown:
        raise ValueError(f"no columns {sorted(unknown)}")
    gone = [t.id for t in header.data if t.id not in keep]
    return df.drop(*gone), header.without(lambda t: t.kind not in ("MA", "CA", "GA") or t.id in keep)


def clean(df: DataFrame, header: model.Header, *, markers: bool = False, metas: bool = False, programs: bool = False, cflag: bool = False, pflag: bool = False, c_mask: int = 0, p_mask: int = 0) -> tuple[DataFrame, model.Header]:
    """Drop marker or other data columns or program tags, zero registers, or clear bits of them."""
    kinds = [k for k, on in (("MA", markers), ("CA", metas), ("GA", metas), ("PG", programs)) if on]
    df = df.drop(*[t.id for t in header.of(*[k for k in kinds if k != "PG"])])
    df = df.withColumns({"cflag": F.lit(0).cast("long") if cflag else bits.clear_bits(_c(), c_mask), "pflag": F.lit(0).cast("long") if pflag else bits.clear_bits(_p(), p_mask)})
    return df, header.without(lambda t: t.kind not in kinds)


#: (low, high), inclusive, of a marker.
Gates = dict[str, tuple[float, float]]


def phenotype(df: DataFrame, markers: Sequence[str], gates: Gates, scale: float = 1.0) -> DataFrame:
    """pflag anew: bit i where marker i lies in its gate; markers without a gate leave their bit off."""
    on = [F.when(F.col(m).between(gates[m][0] * scale, gates[m][1] * scale), F.lit(bits.bit_mask(i))).otherwise(F.lit(0)) for i, m in enumerate(markers) if m in gates]
    return df.withColumn("pflag", bits.either(*on))


def phenotype_jittered(df: DataFrame, markers: Sequence[str], gates: Gates, spread: float, seed: int) -> DataFrame:
    """As phenotype, each low gate scaled by a seeded factor of 1 - spread to 1 + spread."""
    draw = random.Random(seed)
    return phenotype(df, markers, {m: (lo * (1 + spread * draw.uniform(-1, 1)), hi) for m, (lo, hi) in gates.items()})


def set_flags(df: DataFrame, p_set: int = 0, p_clear: int = 0, c_set: int = 0, c_clear: int = 0) -> DataFrame:
    """On marked cells set, then clear, bits; Mark goes everywhere."""
    marked = bits.has_any(_c(), model.MARK)
    change = lambda r, s, c: F.when(marked, bits.clear_bits(bits.set_bits(r, s), c)).otherwise(r)
    return df.withColumns({"pflag": change(_p(), p_set, p_clear), "cflag": bits.clear_bits(change(_c(), c_set, c_clear), model.MARK)})


def flag_to_flag(df: DataFrame, source: str, mask: int, target: str, put: int, *, negate: bool = False, clear: bool = False) -> DataFrame:
    """Where the source register has all of mask (negate: has not), set or clear bits of the target register."""
    cond = bits.has_all(F.col(source), mask)
    new = bits.clear_bits(F.col(target), put) if clear else bits.set_bits(F.col(target), put)
    return df.withColumn(target, F.when(~cond if negate else cond, new).otherwise(F.col(target)))


def copy_flag(df: DataFrame, source: int, target: int) -> DataFrame:
    """Set the target mask of cflag where the source mask is set in full, and clear it elsewhere."""
    return df.withColumn("cflag", bits.put_bits(_c(), target, bits.has_all(_c(), source)))


def count_flag(df: DataFrame, mask: int) -> DataFrame:
    return df.agg(F.count_if(bits.has_all(_c(), mask)).alias("n"))


def rescale(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Marker values become 0 where the marker's phenotype bit is off."""
    return df.withColumns({m: F.when(bits.bit(_p(), i) == 1, F.col(m)).otherwise(F.lit(0).cast(df.schema[m].dataType)) for i, m in enumerate(markers)})


def log10(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """log10 of the markers; cells with one at or below 0 go."""
    positive = reduce(and_, [F.col(m) > 0 for m in markers], F.lit(True))
    return df.where(positive).withColumns({m: F.log10(F.when(F.col(m) > 0, F.col(m))) for m in markers})


def divide(df: DataFrame, over: str, under: str, if_zero: float = -1.0) -> DataFrame:
    """The column <over>div<under>."""
    for c in (over, under):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    return df.withColumn(f"{over}div{under}", F.when(F.col(under) == 0, F.lit(float(if_zero))).otherwise(F.col(over).cast("double") / F.when(F.col(under) != 0, F.col(under))))


def magnify(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in ("x", "y")})


def offset(df: DataFrame, dx: float = 0, dy: float = 0) -> DataFrame:
    return df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def flip(df: DataFrame, x_line: float | None = None, x_shift: float = 0, y_line: float | None = None, y_shift: float = 0) -> DataFrame:
    """Mirror at x = x_line or y = y_line, then shift."""
    new = {}
    if x_line is not None:
        new["x"] = F.lit(2.0 * x_line) - F.col("x") + x_shift
    if y_line is not None:
        new["y"] = F.lit(2.0 * y_line) - F.col("y") + y_shift
    return df.withColumns(new) if new else df


def palette(df: DataFrame, rules: Sequence[tuple[int, int, str]], name: str = "class") -> DataFrame:
    """The label of the first rule (cflag mask, pflag mask, label; 0: any) that fits, else of the last."""
    out = F.lit(rules[-1][2])
    for c, p, label in reversed(rules):
        out = F.when(bits.has_all(_c(), c) & bits.has_all(_p(), p), F.lit(label)).otherwise(out)
    return df.withColumn(name, out)


def sort_cells(df: DataFrame, by: str | None = None, descending: bool = False) -> DataFrame:
    """Whole rows by a column, or by the distance from the origin; ties by id."""
    key = F.col(by) if by else F.hypot("x", "y")
    return df.orderBy(key.desc() if descending else key.asc(), "id")


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("id").limit(n)


def subsample(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Each cell with probability rate, drawn by id and seed: the same cells whatever the partitions."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be above 0 and at most 1")
    return df.where(draw(F.col("id"), seed) < int(rate * PRIME))


def subsample_n(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n cells, drawn by id and seed, in the order of id."""
    return df.orderBy(draw(F.col("id"), seed), "id").limit(n).orderBy("id")


def concat(*parts: DataFrame) -> DataFrame:
    """UNION ALL; the cell ids of each part begin above the largest of those before it, samples stay."""
    out, base = None, 0
    for df in parts:
        df = df.withColumn("cell_id", F.col("cell_id") + base)
        df = df.withColumn("id", model.pack(F.col("sample_id"), F.col("cell_id")))
        out = df if out is None else out.unionByName(df)
        top = df.agg(F.max("cell_id")).first()[0]
        base = base if top is None else max(base, top + 1)
    return out


def renumber(df: DataFrame) -> DataFrame:
    """Cell ids 1, 2, ... per sample in the order of id. Ranges of ids are counted, so that no sample goes through one task."""
    parts = cut(df.repartitionByRange("sample_id", "id").sortWithinPartitions("sample_id", "id").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    firsts = parts.groupBy("sample_id", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a row per sample and range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("sample_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = firsts.select("sample_id", "_part", "_first", before.alias("_before"))
    out = parts.withColumn("_part", part).join(starts, ["sample_id", "_part"])
    out = out.withColumn("cell_id", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return out.withColumn("id", model.pack(F.col("sample_id"), F.col("cell_id"))).select(*df.columns)


def check(df: DataFrame, header: model.Header) -> DataFrame:
    """df as it is, if the header is valid and describes it; reading it fails on a row that lacks an id, a place or a register."""
    problems = header.check() + [f"no column {t.id}" for t in header.data if t.id not in df.columns] + [f"no column {c}" for c in model.FIXED if c not in df.columns]
    if problems:
        raise ValueError("; ".join(problems))
    whole = reduce(and_, [F.col(c).isNotNull() for c in model.FIXED])
    return df.where(F.assert_true(whole, F.lit("a cell lacks an id, a place or a register")).isNull())


def replace_fixed(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """df with x, y, id, pflag or cflag from values (key, value), a row for each cell's id; a cell without one, or two, is an error."""
    if column not in model.FIXED:
        raise ValueError(f"{column} is none of {', '.join(model.FIXED)}")
    one = values.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.first("value").alias("_value"))
    out = df.join(one, df["id"] == one["key"], "left")
    fits = F.assert_true(F.coalesce(F.col("_n") == 1, F.lit(False)), F.lit("the new column's size is not the table's")).isNull()
    return out.where(fits).withColumn(column, F.col("_value").cast(df.schema[column].dataType)).select(*df.columns)


def check_unmarked(df: DataFrame) -> DataFrame:
    """df; reading it fails on a marked cell."""
    ok = F.assert_true(bits.has_none(_c(), model.MARK), F.lit("a cell is marked")).isNull()
    return df.where(ok)


#: Values of a categorical column, at most; their names are part of the header.
MAX_LEVELS = 1_000_000


def set_type(df: DataFrame, header: model.Header, column: str, code: str) -> tuple[DataFrame, model.Header]:
    """Cast a data column. A makes it categorical: its distinct rounded values, ascending, become levels, and the column their index."""
    if code not in ("f", "d", "i", "I", "l", "L", "A"):
        raise ValueError(f"no cast to {code}")
    tag = next(t for t in header.data if t.id == column)
    if code != "A":
        whole = F.round(column) if code in "iIlL" else F.col(column)
        return df.withColumn(column, whole.cast(model.TYPES[code])), header.add(tag.kind, ID=column, TY=code)
    levels = df.select(F.round(column).cast("long").alias("level")).where("level is not null").distinct().limit(MAX_LEVELS + 1)
    # the levels' text goes to the header, which is held on the driver and written whole
    found = sorted(r[0] for r in levels.collect())
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{column} has over {MAX_LEVELS} values: no categories")
    ranked = df.sparkSession.createDataFrame(list(enumerate(found)), "_index int, _level long") if found else None
    if ranked is None:
        return df, header.add(tag.kind, ID=column, TY="A", LV="")
    # at most MAX_LEVELS rows of 12 bytes
    out = df.join(F.broadcast(ranked), F.round(F.col(column)).cast("long") == F.col("_level"), "left")
    out = out.withColumn(column, F.coalesce("_index", F.lit(0))).drop("_index", "_level")
    return out.select(*df.columns), header.add(tag.kind, ID=column, TY="A", LV=",".join(map(str, found)))
