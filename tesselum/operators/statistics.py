"""Group tests and survival curves, from sums and ranks."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselum.functions.lineage import cut, ship


#: Groups that are compared with each other, at most: each is a category, and each two give a row.
MAX_GROUPS = 5_000


def t_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's t, degrees of freedom and two-sided p of each two groups (a < b), from one aggregation; groups of two rows and more, MAX_GROUPS at most."""
    v = F.col(value).cast("double")
    if df.select(group).distinct().limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise ValueError(f"over {MAX_GROUPS} groups are not compared by pairs")
    s = df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var")).where("n > 1")
    a, b = (s.select(F.col(group).alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "mean", "var")]) for k in "ab")
    # groups, not rows: their number is that of the categories
    both = a.join(b, F.col("a") < F.col("b"))
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    se = ea + eb
    t = F.when(se > 0, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(F.when(se > 0, se)))
    dof = F.when(se > 0, se * se / F.when(se > 0, ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1)))
    @F.pandas_udf("double")
    def p(value: pd.Series, n: pd.Series) -> pd.Series:  # a row per pair of groups
        return pd.Series([two_sided("t", v, d) for v, d in zip(value, n, strict=True)], dtype=float)

    ship(df.sparkSession)
    out = both.select("a", "b", t.alias("t"), dof.alias("df"))
    return out.withColumn("p", p("t", "df"))


def _before(counts: DataFrame) -> DataFrame:
    """counts (v, n and others; a row per distinct value) with _before: how many rows have a lesser value. Values are dealt in ranges, whose totals give
    what is before them, so that no task orders all."""
    ranged = cut(counts.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    starts = ranged.groupBy("_part").agg(F.sum("n").alias("_n"))  # a row per range
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_before", within).join(F.broadcast(starts), "_part").withColumn("_before", F.col("_before") + F.col("_start")).drop("_part", "_start")


def rank_sums(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Wilcoxon's W of group a against b: its rank sum, ties averaged, less the least possible; p: two-sided, of the normal approximation with
    corrections for ties and continuity. Ranks come from counts per value."""
    v = F.col(value).cast("double")
    counts = df.where(F.col(group).isin(a, b) & v.isNotNull()).groupBy(v.alias("v")).agg(F.count_if(F.col(group) == a).alias("na"), F.count(F.lit(1)).alias("n"))
    middle = F.col("_before") + (F.col("n") + 1) / 2
    na, n, ties = F.sum("na"), F.sum("n"), F.sum(F.pow(F.col("n"), F.lit(3.0)) - F.col("n"))
    sums = _before(counts).agg((F.sum(middle * F.col("na")) - na * (na + 1) / 2).alias("w"), na.alias("n_a"), (n - na).alias("n_b"), ties.alias("_ties"))
    ab, total = F.col("n_a") * F.col("n_b"), F.col("n_a") + F.col("n_b")
    var = ab / 12 * (total + 1 - F.col("_ties") / F.when(total > 1, total * (total - 1)))
    z = F.greatest(F.abs(F.col("w") - ab / 2) - 0.5, F.lit(0.0)) / F.sqrt(F.when(var > 0, var))
    ship(df.sparkSession)
    return sums.withColumn("_z", z).select("w", "n_a", "n_b", _tail("normal")("_z").alias("p"))


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # modified Lentz steps of 1 / (1 + d1 / (1 + d2 / (1 + ...)))
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d)
        c = 1 + num / c
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def two_sided(kind: str, value: float, dof: float = 0.0) -> float:
    """p of |value| under the normal or Student's distribution, or (chi2) of value above, with one degree of freedom."""
    if value is None or math.isnan(value):
        return math.nan
    if kind == "t":
        return _beta(dof / 2, 0.5, dof / (dof + value * value))
    return math.erfc((abs(value) if kind == "normal" else math.sqrt(max(0.0, value))) / math.sqrt(2))


def _tail(kind: str):
    @F.pandas_udf("double")
    def p(value: pd.Series) -> pd.Series:  # a row per test
        return value.map(lambda v: two_sided(kind, v))

    return p


def kaplan_meier(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(group, time, at_risk, events, survival) at each time with an event (event: 1, censored: 0).

    Times are counted before they are ordered, so the window has a row per distinct time.
    """
    counts = df.groupBy(F.col(group).alias("group"), F.col(time).alias("time")).agg(F.sum(F.col(event).cast("long")).alias("events"), F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy("group").orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy("group").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("at_risk", F.sum("n").over(later))
    left = 1 - F.col("events") / F.col("at_risk")
    logs = F.sum(F.when(left > 0, F.log(F.when(left > 0, left))).otherwise(0.0)).over(upto)
    none = F.max(F.when(left <= 0, 1).otherwise(0)).over(upto)
    return rows.withColumn("survival", F.when(none == 1, 0.0).otherwise(F.exp(logs))).where("events > 0").select("group", "time", "at_risk", "events", "survival")


def merge_clinical(cells: DataFrame, clinical: DataFrame, on: str) -> DataFrame:
    """Left equi-join of per-sample rows with a clinical table."""
    return cells.join(clinical, on, "left")


def exact_quantile(df: DataFrame, value: str, at: float = 0.5) -> float | None:
    """The quantile of the values that aren't null, interpolated between neighbours in order; None of none. No task orders or holds all."""
    v = F.col(value).cast("double")
    counts = cut(_before(df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    place = at * (total - 1)
    low, high = math.floor(place), math.ceil(place)
    rows = counts.where(((F.col("_before") <= low) & (F.col("_before") + F.col("n") > low)) | ((F.col("_before") <= high) & (F.col("_before") + F.col("n") > high))).orderBy("v").collect()  # two at most
    return rows[0]["v"] + (place - low) * (rows[-1]["v"] - rows[0]["v"])


def quantile_groups(df: DataFrame, value: str, at: float = 0.5, name: str = "group") -> DataFrame:
    """df with low or high: below, or at and above, the exact quantile of the value."""
    return df.withColumn(name, F.when(F.col(value) < F.lit(exact_quantile(df, value, at)).cast("double"), "low").otherwise("high"))


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """One row: of two groups (a < b) a's observed and expected events, the variance, chi square with one degree of freedom, and p.

    Counts per time and group come first; the windows have a row per distinct time.
    """
    ends = df.agg(F.min(group).alias("a"), F.max(group).alias("b")).first()
    in_a = F.col(group) == ends["a"]
    e = F.col(event).cast("long")
    counts = df.groupBy(F.col(time).alias("t")).agg(F.sum(e).alias("d"), F.coalesce(F.sum(F.when(in_a, e)), F.lit(0)).alias("da"), F.count(F.lit(1)).alias("n"), F.count_if(in_a).alias("na"))
    later = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    r = counts.withColumns({"r": F.sum("n").over(later), "ra": F.sum("na").over(later)}).where("d > 0")
    share = F.col("ra") / F.col("r")
    var = F.when(F.col("r") > 1, F.col("d") * share * (1 - share) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    sums = r.agg(F.sum("da").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(var).alias("variance"))
    chi2 = F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)) / F.when(F.col("variance") > 0, F.col("variance"))
    ship(df.sparkSession)
    return sums.withColumn("chi2", chi2).withColumn("p", _tail("chi2")("chi2"))


def survival_cutpoint(df: DataFrame, time: str, event: str, value: str, candidates: int = 19) -> DataFrame:
    """(cut, chi2): of evenly spaced quantiles of the value the one that splits survival most (above against not above), the least of equals."""
    found = sorted({exact_quantile(df, value, (k + 1) / (candidates + 1)) for k in range(candidates)} - {None})
    parts = [log_rank(df.where(F.col(value).isNotNull()).withColumn("_g", (F.col(value) > c).cast("int")), time, event, "_g").select(F.lit(c).alias("cut"), "chi2") for c in found]
    if not parts:
        raise ValueError(f"{value} has no values")
    return reduce(DataFrame.union, parts).where("chi2 is not null").orderBy(F.desc("chi2"), "cut").limit(1)


def cox(df: DataFrame, time: str, event: str, covariates: list[str], steps: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """(covariate, coef, hazard_ratio, se, z, p): proportional hazards by Newton's method on the partial likelihood, ties by Breslow.

    Each step is one aggregation per distinct time and one window over these; the driver holds sums of covariates only.
    """
    k = len(covariates)
    rows = df.select(F.col(time).alias("t"), F.col(event).cast("double").alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]).dropna()
    rows = cut(rows)
    beta, pairs = np.zeros(k), [(i, j) for i in range(k) for j in range(i, k)]
    later = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(steps):
        w = F.exp(sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)))
        x = [F.col(f"x{i}") for i in range(k)]
        per = rows.groupBy("t").agg(F.sum("e").alias("d"), F.sum(w).alias("s0"), *[F.sum(w * x[i]).alias(f"s{i}_") for i in range(k)], *[F.sum(w * x[i] * x[j]).alias(f"q{i}_{j}") for i, j in pairs], *[F.sum(F.col("e") * x[i]).alias(f"d{i}") for i in range(k)])
        sums = [c for c in per.columns if c[0] in "sq"]
        per = per.withColumns({c: F.sum(c).over(later) for c in sums}).where("d > 0")
        mean = [F.col(f"s{i}_") / F.col("s0") for i in range(k)]
        got = per.agg(*[F.sum(F.col(f"d{i}") - F.col("d") * mean[i]).alias(f"u{i}") for i in range(k)], *[F.sum(F.col("d") * (F.col(f"q{i}_{j}") / F.col("s0") - mean[i] * mean[j])).alias(f"h{i}_{j}") for i, j in pairs]).first()
        if got["u0"] is None:
            raise ValueError("no events")
        u, h = np.array([got[f"u{i}"] for i in range(k)]), np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = got[f"h{i}_{j}"]
        step = np.linalg.solve(h, u)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    out = [(c, float(b), float(np.exp(b)), float(s), float(b / s), two_sided("normal", float(b / s))) for c, b, s in zip(covariates, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(out, "covariate string, coef double, hazard_ratio double, se double, z double, p double")


def mantel(a: np.ndarray, b: np.ndarray, permutations: int = 999, seed: int = 0) -> tuple[float, float]:
    """Correlation of two square symmetric matrices above the diagonal, and its one-sided p by permuting one's rows and columns."""
    up = np.triu_indices(len(a), 1)
    r = float(np.corrcoef(a[up], b[up])[0, 1])
    draw = np.random.default_rng(seed)
    more = sum(np.corrcoef(a[up], b[np.ix_(p, p)][up])[0, 1] >= r - 1e-12 for p in (draw.permutation(len(a)) for _ in range(permutations)))
    return r, (more + 1) / (permutations + 1)


def mantel_pairs(df: DataFrame, group: str, x: str, y: str, value: str, permutations: int = 999) -> DataFrame:
    """(a, b, r, p) of each two groups (a < b) of long-form matrices (group, x, y, value), a task per pair; matrices are of columns, not rows."""
    ship(df.sparkSession)
    one = df.groupBy(F.col(group).alias("g")).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(value).cast("double").alias("v"))).alias("m"))
    pairs = one.select(F.col("g").alias("a"), F.col("m").alias("m_a")).join(one.select(F.col("g").alias("b"), F.col("m").alias("m_b")), F.col("a") < F.col("b"))

    def run(batches):
        for p in batches:
            out = []
            for ma, mb in zip(p["m_a"], p["m_b"], strict=True):
                names = sorted({c["x"] for c in [*ma, *mb]} | {c["y"] for c in [*ma, *mb]})
                at = {n: i for i, n in enumerate(names)}
                full = []
                for m in (ma, mb):
                    k = np.zeros((len(names), len(names)))
                    for c in m:
                        k[at[c["x"]], at[c["y"]]] = k[at[c["y"]], at[c["x"]]] = c["v"]
                    full.append(k)
                out.append(mantel(*full, permutations))
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "r": [o[0] for o in out], "p": [o[1] for o in out]})

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.repartition("a", "b").mapInPandas(run, f"a {kind}, b {kind}, r double, p double")


def even_split(values: list[float]) -> tuple[list[int], list[int]]:
    """Indices of two parts whose sums are as near as can be, by subset sums of whole numbers."""
    whole = [round(v) for v in values]
    if any(v < 0 for v in whole):
        raise ValueError("values must not be negative")
    reach: dict[int, list[int]] = {0: []}
    for i, v in enumerate(whole):
        for s, taken in list(reach.items()):
            reach.setdefault(s + v, [*taken, i])
    best = min(reach, key=lambda s: (abs(sum(whole) - 2 * s), s))
    one = reach[best]
    return one, [i for i in range(len(values)) if i not in one]
