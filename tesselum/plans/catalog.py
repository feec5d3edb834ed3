"""The catalogue: every operator as a query over the driver's tables, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum import model
from tesselum.functions import geometry
from tesselum.functions.draws import PRIME, draw_sql
from tesselum.functions.lineage import cut, remove, shared_dir
from tesselum.operators import aggregates as agg
from tesselum.operators import cohort, graph, random_models, regions, rows, spatial, statistics, topics
from tesselum.plans.adapter import CELLS, CLUMPS, DATA, MARKERS, cells, clumps
from tesselum.sources import cell_files, csv_cells, rules, views
from tesselum.streaming import cells as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_C = f"WITH c AS ({CELLS})"
_ALL = "id, sample_id, cell_id, x, y, cflag, pflag, m_value, m_k"
GATES = {"m_value": (20.0, 200.0), "m_k": (10.0, 60.0)}
_GATED = "CAST((CASE WHEN m_value BETWEEN 20 AND 200 THEN 1 ELSE 0 END) + (CASE WHEN m_k BETWEEN 10 AND 60 THEN 2 ELSE 0 END) AS BIGINT)"
UNITS = (rows.Unit(pand=33), rows.Unit(por=6, cnot=1))
_UNITS = "((pflag & 33) = 33 OR ((pflag & 6) <> 0 AND (cflag & 1) = 0))"
RINGS = (spatial.Ring("d_all", 0, 20), spatial.Ring("d_click", 10, 50, any_of=1), spatial.Ring("d_local", 0, 50, all_of=33, local=True))
#: id, name, sample, vertices.
ROIS = (
    (1, "square", 0, "200,200 900,200 900,900 200,900"),
    (2, "kite tumor", 1, "1000,100 1700,1000 1000,1900 300,1000"),
    (3, "notch", 0, "100,100 1900,100 1900,1900 1000,600 100,1900"),
    (4, "bow", 3, "300.5,400.5 1500.5,1700.5 1500.5,400.5 300.5,1700.5"),
)


def header() -> model.Header:
    out = model.Header().add("HD", MP="0.5", UN="micron").standard_flags()
    for m in DATA:
        out = out.add("MA", ID=m, TY="d")
    return out


def _query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")})


def _rois(spark: SparkSession) -> DataFrame:
    rows_ = [(i, n, s, p) for i, n, s, p in ROIS]
    df = spark.createDataFrame(rows_, "roi_id long, name string, sample_id long, points string")
    return df.withColumn("verts", geometry.parse_vertices(F.col("points"))).drop("points")


# ------------------------------------------------------------------ scans, projections and row selection


@_query("cells_scan", f"{_C} SELECT {_ALL} FROM c")
def _(spark, sf_dir):
    return cells(spark, sf_dir)


@_query("cut_columns", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag, pflag, m_k FROM c")
def _(spark, sf_dir):
    return rows.cut_columns(cells(spark, sf_dir), header(), ["m_k"])[0]


@_query("clean_flags", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag & ~CAST(2 AS BIGINT) AS cflag, pflag & ~CAST(96 AS BIGINT) AS pflag FROM c")
def _(spark, sf_dir):
    return rows.clean(cells(spark, sf_dir), header(), markers=True, c_mask=2, p_mask=96)[0]


@_query("filter_flags_or_units", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag & ~CAST(2 AS BIGINT) AS cflag, pflag, m_value, m_k FROM c WHERE {_UNITS}")
def _(spark, sf_dir):
    return rows.filter_cells(cells(spark, sf_dir), UNITS)


@_query("filter_fields_and", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag & ~CAST(2 AS BIGINT) AS cflag, pflag, m_value, m_k FROM c WHERE m_value > 30 AND m_k <= 40")
def _(spark, sf_dir):
    return rows.filter_cells(cells(spark, sf_dir), fields=[("m_value", ">", 30.0), ("m_k", "<=", 40.0)])


@_query("filter_fields_or", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag & ~CAST(2 AS BIGINT) AS cflag, pflag, m_value, m_k FROM c WHERE {_UNITS} AND (m_value > 100 OR m_k = 7)")
def _(spark, sf_dir):
    return rows.filter_cells(cells(spark, sf_dir), UNITS, [("m_value", ">", 100.0), ("m_k", "=", 7.0)], any_field=True)


@_query("filter_mark", f"{_C} SELECT id, sample_id, cell_id, x, y, CASE WHEN {_UNITS} THEN cflag | 2 ELSE cflag & ~CAST(2 AS BIGINT) END AS cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return rows.mark_cells(cells(spark, sf_dir), UNITS)


@_query("filter_build_graph", f"{_C} SELECT id, sample_id, cell_id, x, y, CASE WHEN {_UNITS} THEN cflag | 2097152 ELSE cflag & ~CAST(2097152 AS BIGINT) END AS cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return rows.mark_cells(cells(spark, sf_dir), UNITS, mask=model.BUILD_GRAPH)


@_query("trim_marked", f"{_C} SELECT {_ALL} FROM c WHERE (cflag & 2) <> 0")
def _(spark, sf_dir):
    return rows.trim(cells(spark, sf_dir))


@_query("crop_box", f"{_C} SELECT {_ALL} FROM c WHERE x BETWEEN 100 AND 900 AND y BETWEEN 200 AND 1500")
def _(spark, sf_dir):
    return rows.crop(cells(spark, sf_dir), 100, 900, 200, 1500)


@_query("sample_select", f"{_C} SELECT {_ALL} FROM c WHERE sample_id IN (1, 3)")
def _(spark, sf_dir):
    return rows.select_samples(cells(spark, sf_dir), [1, 3])


@_query("palette_class", f"{_C} SELECT {_ALL}, CASE WHEN (cflag & 1) = 1 AND (pflag & 32) = 32 THEN 'tumor mid' WHEN (cflag & 1) = 1 THEN 'tumor' WHEN (pflag & 1) = 1 THEN 'click' ELSE 'other' END AS class FROM c")
def _(spark, sf_dir):
    return rows.palette(cells(spark, sf_dir), [(1, 32, "tumor mid"), (1, 0, "tumor"), (0, 1, "click"), (0, 0, "other")])


# ------------------------------------------------------------------ flags and values


@_query("pheno_gates", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag, {_GATED} AS pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return rows.phenotype(cells(spark, sf_dir), DATA, GATES)


@_query("flagset", f"{_C} SELECT id, sample_id, cell_id, x, y, CASE WHEN (cflag & 2) <> 0 THEN (cflag | 16) & ~CAST(3 AS BIGINT) ELSE cflag & ~CAST(2 AS BIGINT) END AS cflag, CASE WHEN (cflag & 2) <> 0 THEN (pflag | 128) & ~CAST(64 AS BIGINT) ELSE pflag END AS pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return rows.set_flags(cells(spark, sf_dir), p_set=128, p_clear=64, c_set=16, c_clear=1)


@_query("flag_to_flag", f"{_C} SELECT id, sample_id, cell_id, x, y, CASE WHEN (pflag & 33) <> 33 THEN cflag | 4 ELSE cflag END AS cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return rows.flag_to_flag(cells(spark, sf_dir), "pflag", 33, "cflag", 4, negate=True)


@_query("rescale_markers", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag, pflag, CASE WHEN (pflag & 1) = 1 THEN m_value ELSE 0 END AS m_value, CASE WHEN (pflag & 2) = 2 THEN m_k ELSE 0 END AS m_k FROM c")
def _(spark, sf_dir):
    return rows.rescale(cells(spark, sf_dir), DATA)


@_query("log10_markers", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag, pflag, round(log10(m_value), 6) AS m_value, round(log10(m_k), 6) AS m_k FROM c WHERE m_value > 0 AND m_k > 0")
def _(spark, sf_dir):
    return _rounded(rows.log10(cells(spark, sf_dir), DATA))


@_query("divide_columns", f"{_C} SELECT {_ALL}, CASE WHEN m_k = 0 THEN -1 ELSE m_value / m_k END AS m_valuedivm_k FROM c")
def _(spark, sf_dir):
    return rows.divide(cells(spark, sf_dir), "m_value", "m_k")


@_query("magnify", f"{_C} SELECT id, sample_id, cell_id, x * 0.5 AS x, y * 0.5 AS y, cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return rows.magnify(cells(spark, sf_dir), 0.5)


@_query("offset", f"{_C} SELECT id, sample_id, cell_id, x + 10 AS x, y - 20 AS y, cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return rows.offset(cells(spark, sf_dir), 10, -20)


@_query("flip", f"{_C} SELECT id, sample_id, cell_id, 2000 - x + 5 AS x, 1800 - y AS y, cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return rows.flip(cells(spark, sf_dir), 1000, 5, 900)


@_query("settype_levels", f"{_C}, l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT m_k AS v FROM c)) SELECT id, sample_id, cell_id, x, y, cflag, pflag, m_value, CAST(i AS INTEGER) AS m_k FROM c JOIN l ON m_k = v")
def _(spark, sf_dir):
    return rows.set_type(cells(spark, sf_dir), header(), "m_k", "A")[0]


# ------------------------------------------------------------------ order, samples, union


@_query("sort_head", f"{_C} SELECT {_ALL} FROM c ORDER BY m_value DESC, id LIMIT 100")
def _(spark, sf_dir):
    return rows.sort_cells(cells(spark, sf_dir), "m_value", descending=True).limit(100)


@_query("sort_from_origin", f"{_C} SELECT {_ALL} FROM c ORDER BY sqrt(x * x + y * y), id LIMIT 50")
def _(spark, sf_dir):
    return rows.sort_cells(cells(spark, sf_dir)).limit(50)


@_query("head", f"{_C} SELECT {_ALL} FROM c ORDER BY id LIMIT 25")
def _(spark, sf_dir):
    return rows.head(cells(spark, sf_dir), 25)


@_query("subsample_hash", f"{_C} SELECT {_ALL} FROM c WHERE {draw_sql('id', 3)} < {int(0.1 * PRIME)}")
def _(spark, sf_dir):
    return rows.subsample(cells(spark, sf_dir), 0.1, seed=3)


@_query("subsample_n", f"{_C} SELECT {_ALL} FROM c ORDER BY {draw_sql('id', 3)}, id LIMIT 500")
def _(spark, sf_dir):
    return rows.subsample_n(cells(spark, sf_dir), 500, seed=3)


@_query(
    "cat_union_offset",
    f"{_C}, a AS (SELECT * FROM c WHERE sample_id = 0), b AS (SELECT * FROM c WHERE sample_id <> 0), m AS (SELECT max(cell_id) + 1 AS k FROM a) SELECT {_ALL} FROM a UNION ALL SELECT sample_id * 4294967296 + cell_id + k AS id, sample_id, cell_id + k AS cell_id, x, y, cflag, pflag, m_value, m_k FROM b, m",
)
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    return rows.concat(c.where("sample_id = 0"), c.where("sample_id <> 0"))


@_query("renumber", f"{_C}, n AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY id) AS k FROM c) SELECT sample_id * 4294967296 + k AS id, sample_id, k AS cell_id, x, y, cflag, pflag, m_value, m_k FROM n")
def _(spark, sf_dir):
    return rows.renumber(cells(spark, sf_dir))


# ------------------------------------------------------------------ aggregates


@_query("count_cells", f"{_C} SELECT count(*) AS n FROM c")
def _(spark, sf_dir):
    return agg.count_cells(cells(spark, sf_dir))


@_query(
    "summary_stats",
    f"{_C} SELECT count(*) AS n, " + ", ".join(f"round({f}({k}), 6) AS {k}_{n}" for k in ("x", "y", "m_value", "m_k") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) + ", " + ", ".join(f"{f}({k}) AS {k}_{f}" for k in ("cflag", "pflag") for f in ("min", "max")) + " FROM c",
)
def _(spark, sf_dir):
    return _rounded(agg.summary(cells(spark, sf_dir), ("x", "y", "m_value", "m_k")))


@_query("column_info", f"{_C}, t AS (SELECT * FROM c ORDER BY id LIMIT 3) " + " UNION ALL ".join(f"SELECT '{k}' AS name, count({k}) AS n, (SELECT string_agg(round({k}, 2), ';' ORDER BY id) FROM t) AS first, round(min({k}), 6) AS min, round(max({k}), 6) AS max, round(avg({k}), 6) AS mean FROM c" for k in ("m_value",)) + " UNION ALL " + "SELECT 'x' AS name, count(x) AS n, (SELECT string_agg(x, ';' ORDER BY id) FROM t) AS first, min(x), max(x), round(avg(x), 6) FROM c")
def _(spark, sf_dir):
    info = agg.info(cells(spark, sf_dir), ("m_value", "x"))
    return _rounded(info.withColumn("first", F.array_join(F.transform("first", lambda v: F.round(v, 2).cast("string")), ";")))


@_query("mean_by_group", f"{_C} SELECT CAST(m_k AS INTEGER) AS m_k, round(avg(m_value), 6) AS m_value, round(avg(x), 6) AS x FROM c GROUP BY CAST(m_k AS INTEGER)")
def _(spark, sf_dir):
    return _rounded(agg.mean(cells(spark, sf_dir), ["m_value", "x"], "m_k"))


@_query("mean_all", f"{_C} SELECT round(avg(m_value), 6) AS m_value, round(avg(m_k), 6) AS m_k FROM c")
def _(spark, sf_dir):
    return _rounded(agg.mean(cells(spark, sf_dir), DATA))


@_query("cell_count_bits", f"{_C} SELECT " + ", ".join(f"count(*) FILTER ((pflag & {1 << i}) <> 0) AS {m}_count" for i, m in enumerate(MARKERS)) + ', count(*) FILTER ((pflag & 33) = 33) AS "33_count", count(*) FILTER (pflag = 0) AS "0_count" FROM c')
def _(spark, sf_dir):
    return agg.cell_count(cells(spark, sf_dir), MARKERS, [33, 0])


@_query("pearson_pairs", f"{_C} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS value FROM c" for a, b in (("m_value", "m_k"), ("m_value", "x"), ("m_value", "y"), ("m_k", "x"), ("m_k", "y"), ("x", "y"))))
def _(spark, sf_dir):
    return _rounded(agg.pearson(cells(spark, sf_dir), ["m_value", "m_k", "x", "y"]))


def _jaccard(under: str) -> str:
    b = [f"((pflag & {1 << i}) <> 0)" for i in range(7)]
    return f"{_C} " + " UNION ALL ".join(
        f"SELECT '{MARKERS[i]}' AS a, '{MARKERS[j]}' AS b, round(CASE WHEN u > 0 THEN k / u ELSE 0 END, 6) AS value FROM (SELECT count(*) FILTER ({b[i]} AND {b[j]}) AS k, {under.format(a=b[i], b=b[j])} AS u FROM c)" for i in range(7) for j in range(i + 1, 7)
    )


@_query("jaccard_pairs", _jaccard("count(*) FILTER ({a} OR {b})"))
def _(spark, sf_dir):
    return _rounded(agg.jaccard(cells(spark, sf_dir), MARKERS))


@_query("jaccard_subset", _jaccard("least(count(*) FILTER ({a}), count(*) FILTER ({b}))"))
def _(spark, sf_dir):
    return _rounded(agg.jaccard(cells(spark, sf_dir), MARKERS, subset=True))


@_query("histogram_bins", f"{_C} SELECT CAST(least(floor(m_value * (20 / 500.0)), 19) AS INTEGER) AS bin, count(*) AS n FROM c WHERE m_value BETWEEN 0 AND 500 GROUP BY 1")
def _(spark, sf_dir):
    return agg.histogram(cells(spark, sf_dir), "m_value", 20, 0.0, 500.0)


@_query("joint_flag_histogram", f"{_C} SELECT sample_id, cflag, pflag, count(*) AS n FROM c GROUP BY ALL")
def _(spark, sf_dir):
    return agg.joint_flags(cells(spark, sf_dir))


@_query("category_histogram", f"{_C} SELECT sample_id, CAST(m_k AS INTEGER) AS level, cflag, pflag, count(*) AS n FROM c GROUP BY ALL")
def _(spark, sf_dir):
    return agg.category_flags(cells(spark, sf_dir).withColumn("m_k", F.col("m_k").cast("int")), "m_k")


@_query("frame_tiles", f"{_C} SELECT sample_id, CAST(floor(x / 400) + 1 AS BIGINT) AS frame_x, CAST(floor(y / 400) + 1 AS BIGINT) AS frame_y, count(*) AS n, round(avg(m_value), 6) AS m_value, round(avg(m_k), 6) AS m_k FROM c GROUP BY sample_id, 2, 3")
def _(spark, sf_dir):
    return _rounded(agg.tiles(cells(spark, sf_dir), DATA))


@_query("plot_grid", f'{_C} SELECT CAST(floor(x * (40 / 2010.0)) AS INTEGER) AS "column", CAST(floor(y * (20 / 2010.0)) AS INTEGER) AS "row", count(*) AS n FROM c GROUP BY 1, 2')
def _(spark, sf_dir):
    return agg.grid(cells(spark, sf_dir), 40, 20, 2010.0, 2010.0)


@_query("derive_gates", f"{_C} SELECT 'm_value' AS marker, min(m_value) FILTER ((pflag & 1) <> 0) AS low, 100000.0::DOUBLE AS high FROM c UNION ALL SELECT 'm_k', min(m_k) FILTER ((pflag & 2) <> 0), 100000.0::DOUBLE FROM c")
def _(spark, sf_dir):
    return agg.derive_gates(cells(spark, sf_dir), DATA)


@_query("region_summary", f"{_C} SELECT sample_id, region, count(*) AS n, round(avg(m_value), 6) AS m_value FROM (SELECT *, 'tumor' AS region FROM c WHERE (cflag & 1) <> 0 UNION ALL SELECT *, 'stroma' FROM c WHERE (cflag & 1) = 0 UNION ALL SELECT *, 'marked' FROM c WHERE (cflag & 2) <> 0) GROUP BY sample_id, region")
def _(spark, sf_dir):
    c = F.col("cflag")
    return _rounded(agg.regions(cells(spark, sf_dir), {"tumor": c.bitwiseAND(1) != 0, "stroma": c.bitwiseAND(1) == 0, "marked": c.bitwiseAND(2) != 0}, ["m_value"]))


@_query("melt_markers", f"{_C} SELECT id, 'm_value' AS variable, m_value AS value FROM c UNION ALL SELECT id, 'm_k', m_k FROM c")
def _(spark, sf_dir):
    return agg.melt(cells(spark, sf_dir), ["id"], DATA)


@_query("dcast_means", f"{_C} SELECT sample_id, round(avg(m_value), 6) AS m_value, round(avg(m_k), 6) AS m_k FROM c GROUP BY sample_id")
def _(spark, sf_dir):
    return _rounded(agg.dcast(agg.melt(cells(spark, sf_dir), ["sample_id"], DATA), ["sample_id"], DATA))


@_query("clinical_merge", f"{_C}, s AS (SELECT sample_id, count(*) AS n, round(avg(m_value), 6) AS m_value FROM c GROUP BY sample_id) SELECT s.sample_id, n, m_value, n_name FROM s LEFT JOIN nation ON sample_id = n_nationkey")
def _(spark, sf_dir):
    s = cells(spark, sf_dir).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.avg("m_value").alias("m_value"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("sample_id"), "n_name")
    return _rounded(statistics.merge_clinical(s, nation, "sample_id"))


@_query(
    "ttest_pairs",
    f"{_C}, s AS (SELECT sample_id AS g, count(*) AS n, avg(m_value) AS m, var_samp(m_value) AS v FROM c GROUP BY sample_id) SELECT a.g AS a, b.g AS b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM s a JOIN s b ON a.g < b.g",
)
def _(spark, sf_dir):
    return statistics.t_tests(cells(spark, sf_dir), "sample_id", "m_value").select("a", "b", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@_query("wilcoxon", f"{_C}, r AS (SELECT sample_id, rank() OVER (ORDER BY m_value) + (count(*) OVER (PARTITION BY m_value) - 1) / 2 AS r FROM c WHERE sample_id IN (0, 1)) SELECT sum(r) FILTER (sample_id = 0) - count(*) FILTER (sample_id = 0) * (count(*) FILTER (sample_id = 0) + 1) / 2 AS w, count(*) FILTER (sample_id = 0) AS n_a, count(*) FILTER (sample_id = 1) AS n_b FROM r")
def _(spark, sf_dir):
    return statistics.rank_sums(cells(spark, sf_dir), "sample_id", "m_value", 0, 1).drop("p")


@_query(
    "km_curve",
    "WITH o AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS g, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e FROM orders), k AS (SELECT g, t, sum(e) AS d, count(*) AS n FROM o GROUP BY g, t), r AS (SELECT g, t, d, sum(n) OVER (PARTITION BY g ORDER BY t DESC) AS risk FROM k) SELECT g AS \"group\", CAST(t AS INTEGER) AS time, CAST(risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(CASE WHEN min(1 - d / risk) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk) ELSE 0 END) OVER w) END, 6) AS survival FROM r WINDOW w AS (PARTITION BY g ORDER BY t) QUALIFY d > 0",
)
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("g"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("e"))
    return _rounded(statistics.kaplan_meier(o, "t", "e", "g"))


@_query("median_groups", f"{_C}, m AS (SELECT median(m_value) AS k FROM c) SELECT id, CASE WHEN m_value < k THEN 'low' ELSE 'high' END AS \"group\" FROM c, m")
def _(spark, sf_dir):
    return statistics.quantile_groups(cells(spark, sf_dir), "m_value").select("id", "group")


def _jaccard_by_sample() -> str:
    b = [f"((pflag & {1 << i}) <> 0)" for i in range(7)]
    return " UNION ALL ".join(f"SELECT sample_id, {i * 7 + j} AS pair, CASE WHEN count(*) FILTER ({b[i]} OR {b[j]}) > 0 THEN count(*) FILTER ({b[i]} AND {b[j]}) / count(*) FILTER ({b[i]} OR {b[j]}) ELSE 0 END AS v FROM c GROUP BY sample_id" for i in range(7) for j in range(i + 1, 7))


@_query("mantel_pairs", f"{_C}, j AS ({_jaccard_by_sample()}) SELECT a.sample_id AS a, b.sample_id AS b, round(corr(a.v, b.v), 6) AS r FROM j a JOIN j b ON a.pair = b.pair AND a.sample_id < b.sample_id GROUP BY a.sample_id, b.sample_id")
def _(spark, sf_dir):
    """The matrices' correlation; p, from permutations, has unit tests."""
    c = cells(spark, sf_dir)
    parts = [agg.jaccard(c.where(F.col("sample_id") == s), MARKERS).withColumn("sample", F.lit(s).cast("long")) for s in range(8)]
    return statistics.mantel_pairs(reduce(DataFrame.union, parts), "sample", "a", "b", "value", 199).select("a", "b", F.round("r", 6).alias("r"))


_KM = "WITH o AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS g, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e, CAST(o_totalprice AS DOUBLE) AS price FROM orders)"


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("g"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("e"), F.col("o_totalprice").cast("double").alias("price"))


def _log_rank_sql(source: str, group: str) -> str:
    """observed, expected, variance of the rows where the group expression is 0."""
    return (
        f"(SELECT sum(da) AS observed, sum(d * ra / r) AS expected, sum(CASE WHEN r > 1 THEN d * (ra / r) * (1 - ra / r) * (r - d) / (r - 1) ELSE 0 END) AS variance FROM (SELECT t, d, da, sum(n) OVER (ORDER BY t DESC) AS r, sum(na) OVER (ORDER BY t DESC) AS ra "
        f"FROM (SELECT t, sum(e) AS d, sum(CASE WHEN {group} = 0 THEN e ELSE 0 END) AS da, count(*) AS n, count(*) FILTER ({group} = 0) AS na FROM {source} GROUP BY t)) WHERE d > 0)"
    )


@_query("log_rank", f"{_KM} SELECT CAST(observed AS BIGINT) AS observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(pow(observed - expected, 2) / variance, 6) AS chi2 FROM {_log_rank_sql('o', "(CASE WHEN g = 'a' THEN 0 ELSE 1 END)")}")
def _(spark, sf_dir):
    return _rounded(statistics.log_rank(_orders(spark, sf_dir), "t", "e", "g").drop("p"))


_CUTS = 3


@_query(
    "survival_cutpoint",
    f"{_KM}, q AS (SELECT unnest([{', '.join(f'quantile_cont(price, {(k + 1) / (_CUTS + 1)})' for k in range(_CUTS))}]) AS cut FROM o) "
    "SELECT round(cut, 4) AS cut, round(chi2, 6) AS chi2 FROM (" + " UNION ALL ".join(f"SELECT k.cut, pow(observed - expected, 2) / variance AS chi2 FROM (SELECT quantile_cont(price, {(k + 1) / (_CUTS + 1)}) AS cut FROM o) k, {_log_rank_sql('o', f'(CASE WHEN price > (SELECT quantile_cont(price, {(k + 1) / (_CUTS + 1)}) FROM o) THEN 1 ELSE 0 END)')}" for k in range(_CUTS)) + ") ORDER BY chi2 DESC, cut LIMIT 1",
)
def _(spark, sf_dir):
    return statistics.survival_cutpoint(_orders(spark, sf_dir), "t", "e", "price", _CUTS).select(F.round("cut", 4).alias("cut"), F.round("chi2", 6).alias("chi2"))


@_query("cox_hazards")
def _(spark, sf_dir):
    """Proportional hazards; checked against a direct maximum of the likelihood in the tests."""
    o = _orders(spark, sf_dir).select("t", "e", (F.col("g") == "a").cast("double").alias("in_a"), (F.col("price") / 100_000).alias("price"))
    return _rounded(statistics.cox(o, "t", "e", ["in_a", "price"]))


_FMT = "printf('%.2f', CASE WHEN {0} < 0 THEN ceil({0} * 100) ELSE floor({0} * 100) END / 100)"


@_query("view_csv", f"{_C} SELECT concat_ws(',', sample_id, cell_id, cflag, pflag, printf('%.2f', round(x, 2)), printf('%.2f', round(y, 2)), {_FMT.format('m_value')}, {_FMT.format('m_k')}) AS line FROM c")
def _(spark, sf_dir):
    return views.view(cells(spark, sf_dir), header())


@_query("view_crevasse", f"{_C} SELECT concat_ws(',', cell_id, printf('%.2f', x), printf('%.2f', y), {_FMT.format('m_value')}, {_FMT.format('m_k')}) AS line FROM c")
def _(spark, sf_dir):
    return views.view(cells(spark, sf_dir), header(), style="crevasse")


@_query("view_named", f"{_C} SELECT concat_ws(chr(9), 'sample_id:' || sample_id, 'cell_id:' || cell_id, 'cflag:' || cflag, 'pflag:' || pflag, 'x:' || printf('%.2f', x), 'y:' || printf('%.2f', y), 'm_value:' || {_FMT.format('m_value')}, 'm_k:' || {_FMT.format('m_k')}) AS line FROM c")
def _(spark, sf_dir):
    return views.view(cells(spark, sf_dir), header(), style="named")


@_query("view_justified", f"{_C}, v AS (SELECT CAST(sample_id AS VARCHAR) AS a, CAST(cell_id AS VARCHAR) AS b, CAST(cflag AS VARCHAR) AS d, CAST(pflag AS VARCHAR) AS e, printf('%.2f', x) AS x, printf('%.2f', y) AS y, {_FMT.format('m_value')} AS v, {_FMT.format('m_k')} AS k FROM c), w AS (SELECT " + ", ".join(f"CAST(max(length({n})) AS INTEGER) AS w{n}" for n in ("a", "b", "d", "e", "x", "y", "v")) + " FROM v) SELECT concat_ws(chr(9), " + ", ".join(f"rpad({n}, w{n}, ' ')" for n in ("a", "b", "d", "e", "x", "y", "v")) + ", k) AS line FROM v, w")
def _(spark, sf_dir):
    return views.view(cells(spark, sf_dir), header(), style="tab", justify=True)


@_query("view_header", "SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(n, line.replace("'", "''")) for n, line in enumerate(header().text().rstrip("\n").split("\n"))) + ") AS h(n, line)")
def _(spark, sf_dir):
    return views.header_lines(spark, header())


@_query("view_with_header", f"{_C} SELECT 1 AS part, {_FMT.format('m_k')} AS line FROM c UNION ALL SELECT * FROM (VALUES " + ", ".join("(0, '{}')".format(line.replace("'", "''")) for line in header().text().rstrip("\n").split("\n")) + ") AS h(part, line)")
def _(spark, sf_dir):
    return views.with_header(cells(spark, sf_dir), header(), fields=["m_k"], strict=True)


@_query("check_table", f"{_C} SELECT {_ALL} FROM c")
def _(spark, sf_dir):
    return rows.check(cells(spark, sf_dir), header())


@_query("check_unmarked", f"{_C} SELECT {_ALL} FROM c WHERE (cflag & 2) = 0")
def _(spark, sf_dir):
    return rows.check_unmarked(cells(spark, sf_dir).where("(cflag & 2) = 0"))


@_query("replace_x", f"{_C} SELECT id, sample_id, cell_id, y * 2 + 1 AS x, y, cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    return rows.replace_fixed(c, "x", c.select(F.col("id").alias("key"), (F.col("y") * 2 + 1).alias("value")))


@_query("reheader", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag, pflag, m_value AS intensity, m_k FROM c")
def _(spark, sf_dir):
    renamed = header().renamed({"m_value": "intensity"})
    assert renamed.markers == ["intensity", "m_k"]
    return cells(spark, sf_dir).withColumnRenamed("m_value", "intensity")


@_query("settype_int", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag, pflag, CAST(round(m_value) AS INTEGER) AS m_value, m_k FROM c")
def _(spark, sf_dir):
    return rows.set_type(cells(spark, sf_dir), header(), "m_value", "i")[0]


@_query("copy_flag", f"{_C} SELECT id, CASE WHEN (cflag & 1) = 1 THEN cflag | 8 ELSE cflag & ~CAST(8 AS BIGINT) END AS cflag FROM c")
def _(spark, sf_dir):
    return rows.copy_flag(cells(spark, sf_dir), model.TUMOR, model.TUMOR_MANUAL).select("id", "cflag")


@_query("count_flag", f"{_C} SELECT count(*) FILTER ((cflag & 3) = 3) AS n FROM c")
def _(spark, sf_dir):
    return rows.count_flag(cells(spark, sf_dir), 3)


_FILED = "id, x, y, cflag, pflag, m_value, m_k"


def _through_files(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    """All samples written as cell files, one each, and read back; x and y are whole numbers, so 32 bits hold them."""
    where = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    cell_files.write_samples(cells(spark, sf_dir), header(), where, ending)
    back = cut(cell_files.read(spark, f"{where}/*{ending}")[0])
    remove(spark, where)
    return back.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "cflag", "pflag", "m_value", "m_k")


@_query("trips_through_files", f"{_C} SELECT {_FILED} FROM c")
def _(spark, sf_dir):
    return _through_files(spark, sf_dir, ".byf")


@_query("trips_through_text_files", f"{_C} SELECT {_FILED} FROM c")
def _(spark, sf_dir):
    return _through_files(spark, sf_dir, ".cyf")


def _written(spark: SparkSession, lines: list[str] | DataFrame, use):
    """use(path) of a folder with the lines as text, before it goes."""
    where = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    lines = lines if isinstance(lines, DataFrame) else spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    lines.write.text(where)
    out = use(where)
    out = cut(out) if isinstance(out, DataFrame) else out
    remove(spark, where)
    return out


@_query("convert_csv", f"{_C} SELECT CAST(3 * 4294967296 + cell_id AS BIGINT) AS id, CAST(3 AS BIGINT) AS sample_id, cell_id, x, y, CAST(0 AS BIGINT) AS cflag, CAST(CASE WHEN m_k > 30 THEN 1 ELSE 0 END AS BIGINT) AS pflag, CAST(m_value AS FLOAT) AS mvalue, CAST(m_k AS FLOAT) AS k FROM c")
def _(spark, sf_dir):
    """The cells written as a quantification table, with a marker whose name has a hyphen, its gate and a further column, and ingested."""
    c = cells(spark, sf_dir)
    body = c.select(F.concat_ws(",", *[F.col(x).cast("string") for x in ("cell_id", "x", "y", "m_value")], (F.col("m_k") > 30).cast("int").cast("string"), F.col("m_k").cast("string")).alias("line"))
    top = spark.createDataFrame([("CellID,X,Y,m-value,m-valuep,k",)], "line string")
    found = _written(spark, top.union(body), lambda where: csv_cells.read(spark, where, markers=["m-value"], microns=0.5, unit="micron", sample=3)[0])
    return found.withColumns({a: F.col(a).cast("double") for a in ("x", "y")})


@_query("gate_file", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag, {_GATED} AS pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    gates = _written(spark, [f"{m},{low},{high}" for m, (low, high) in GATES.items()], lambda where: rules.gates(spark, where))
    return rows.phenotype(cells(spark, sf_dir), DATA, gates)


@_query("palette_file", f"{_C} SELECT id, CASE WHEN (cflag & 1) = 1 AND (pflag & 32) = 32 THEN 'tumor mid' WHEN (cflag & 1) = 1 THEN 'tumor' ELSE 'other' END AS class FROM c")
def _(spark, sf_dir):
    lines = ["# cflag,pflag,r,g,b,alpha,label", "1,32,255,0,0,1,tumor mid", "1,0,200,0,0,1,tumor", "0,0,9,9,9,0.5,other"]
    return rows.palette(cells(spark, sf_dir), _written(spark, lines, lambda where: rules.palette(spark, where))).select("id", "class")


# ------------------------------------------------------------------ regions


def _inside(p: str) -> str:
    v = [tuple(map(float, q.split(","))) for q in p.split()]
    edges = [f"(CASE WHEN ({b}::DOUBLE > y) <> ({d}::DOUBLE > y) AND x < {c - a}::DOUBLE * (y - {b}) / {d - b}::DOUBLE + {a} THEN 1 ELSE 0 END)" for (a, b), (c, d) in zip(v, v[-1:] + v[:-1], strict=True) if b != d]
    return f"({' + '.join(edges)}) % 2 = 1"


@_query("roi_point_in_polygon", f"{_C} SELECT {_ALL}, CAST(CASE " + " ".join(f"WHEN sample_id = {s} AND {_inside(p)} THEN {i}" for i, _, s, p in ROIS) + " ELSE -1 END AS BIGINT) AS roi FROM c")
def _(spark, sf_dir):
    return regions.region_of(cells(spark, sf_dir), _rois(spark)).select(*_ALL.split(", "), "roi")


@_query("flag_roi", f"{_C} SELECT id, sample_id, cell_id, x, y, CASE WHEN " + " OR ".join(f"(sample_id = {s} AND {_inside(p)})" for _, n, s, p in ROIS if "o" in n) + " THEN cflag | 512 ELSE cflag & ~CAST(512 AS BIGINT) END AS cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return regions.flag_regions(cells(spark, sf_dir), _rois(spark), 9, name="o", clear_first=True).select(*_ALL.split(", "))


@_query("roi_keywords", f"{_C} SELECT id, sample_id, cell_id, x, y, CASE WHEN sample_id = 1 AND {_inside(ROIS[1][3])} THEN cflag | 8 ELSE cflag END AS cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return regions.apply_keywords(cells(spark, sf_dir), _rois(spark))


def _area(p: str) -> float:
    v = [tuple(map(float, q.split(","))) for q in p.split()]
    return abs(sum(a * d - c * b for (a, b), (c, d) in zip(v, v[1:] + v[:1], strict=True))) / 2


@_query("roi_info", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS id, '{n}' AS name, CAST({s} AS BIGINT) AS sample, {len(p.split())} AS vertices, {_area(p)}::DOUBLE AS area, {_area(p) / 4}::DOUBLE AS area_um2" for i, n, s, p in ROIS))
def _(spark, sf_dir):
    return regions.region_info(_rois(spark), 0.5)


@_query("roi_scaled_area", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS id, {_area(p) * 4}::DOUBLE AS area" for i, _, _, p in ROIS))
def _(spark, sf_dir):
    moved = regions.shift_regions(regions.move_regions(_rois(spark), scale=2.0, invert_y=4000.0), 10, 20)
    return regions.region_info(moved).select("id", "area")


@_query("roi_file", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS id, '{n}' AS name, CAST(0 AS BIGINT) AS sample, {len(p.split())} AS vertices, {_area(p) * 4}::DOUBLE AS area, {_area(p)}::DOUBLE AS area_um2" for i, n, s, p in ROIS))
def _(spark, sf_dir):
    lines = ["Id,Name,Text,type,all_points", *[f'{i},"{n}","a ""quoted"" text, with a comma",Polygon,"{p}"' for i, n, _, p in ROIS], '9,"none",,Polygon,""']
    return regions.region_info(_written(spark, lines, lambda where: rules.regions(spark, where, scale=2.0)), 0.5)


@_query("roi_add_and_clear", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS id, CAST({s} AS BIGINT) AS sample, {_area(p) * k}::DOUBLE AS area" for i, n, s, p in ROIS for i, k in ((i, 1), (i + 10, 9)) if n != "bow" and i != 11))
def _(spark, sf_dir):
    """Regions added in other units, and cleared by name and by id."""
    own = _rois(spark)
    more = own.withColumn("roi_id", F.col("roi_id") + 10)
    both = regions.add_regions(own, more, scale=3.0, mode="add")
    return regions.region_info(regions.remove_regions(regions.remove_regions(both, name="bow"), roi_id=11)).select("id", "sample", "area")


# ------------------------------------------------------------------ cohort


_DISC = geometry.disc(20.0)


@_query(
    "painted_area",
    f"{_C}, k AS (SELECT sample_id, -1 AS compartment, x, y FROM c UNION ALL SELECT sample_id, b AS compartment, x, y FROM c, (SELECT unnest([0, 1]) AS b) WHERE (cflag >> b) & 1 = 1), o AS (SELECT sample_id, compartment, min(x) AS x0, min(y) AS y0, count(*) AS n FROM k GROUP BY ALL), "
    f"px AS (SELECT DISTINCT sample_id, compartment, CAST(round(x - x0 + 20) AS BIGINT) AS ix, CAST(round(y - y0 + 20) AS BIGINT) AS iy FROM k JOIN o USING (sample_id, compartment)), d AS (SELECT unnest({[dy for dy, _ in _DISC]}) AS dy, unnest({[w for _, w in _DISC]}) AS w), "
    "p AS (SELECT DISTINCT sample_id, compartment, iy + dy AS r, ix + unnest(generate_series(-w, w)) AS q FROM px, d), a AS (SELECT sample_id, compartment, count(*) AS pixels FROM p GROUP BY ALL) "
    "SELECT sample_id, CAST(compartment AS INTEGER) AS compartment, n, pixels, round(pixels / 1e6, 6) AS area_mm2, round(n / (pixels / 1e6), 4) AS density FROM o JOIN a USING (sample_id, compartment)",
)
def _(spark, sf_dir):
    return cohort.painted_area(cells(spark, sf_dir)).withColumns({"area_mm2": F.round("area_mm2", 6), "density": F.round("density", 4)})


@_query("compartment_counts", f"{_C} SELECT sample_id, count(*) AS n_cells, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM c GROUP BY sample_id")
def _(spark, sf_dir):
    return cohort.boxes(cells(spark, sf_dir))


@_query(
    "cohort_json",
    f"{_C}, k AS (SELECT sample_id, x * 0.5 AS x, y * 0.5 AS y, cflag | CASE WHEN floor(m_k / 20) <> 0 THEN 1024 ELSE 2048 END AS cflag, pflag, floor(m_k / 20) AS level FROM c), f AS (SELECT sample_id, count(*) AS n FROM (SELECT DISTINCT sample_id, cflag, pflag FROM k) GROUP BY sample_id), "
    "l AS (SELECT sample_id, count(*) AS n FROM (SELECT DISTINCT sample_id, level, cflag, pflag FROM k) GROUP BY sample_id), m AS (SELECT sample_id, count(*) AS n_cells, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, 1 + " + " + ".join(f"max((cflag >> {b}) & 1)" for b in (0, 1, 10, 11)) + " AS compartments, count(*) + " + " + ".join(f"sum((cflag >> {b}) & 1)" for b in (0, 1, 10, 11)) + " AS members FROM k GROUP BY sample_id) "
    "SELECT sample_id, n_cells, x_min, x_max, y_min, y_max, CAST(compartments AS INTEGER) AS compartments, CAST(members AS BIGINT) AS members, CAST(f.n AS INTEGER) AS flags, n_cells AS counted, CAST(l.n AS INTEGER) AS levels, 13 AS named FROM m JOIN f USING (sample_id) JOIN l USING (sample_id)",
)
def _(spark, sf_dir):
    """One document per sample, read again: its boxes, how many compartments, members, histogram rows and names it has."""
    scaled = model.Header().add("HD", MP="0.5", UN="pixel").standard_flags()
    docs = cohort.cohort_json(cells(spark, sf_dir).withColumn("m_k", F.floor(F.col("m_k") / 20).cast("int")), scaled, ["m_k"])
    hist = "array<struct<cflag: bigint, pflag: bigint, n: bigint>>"
    kind = f"sample_id bigint, n_cells bigint, bbox_um struct<x_min: double, x_max: double, y_min: double, y_max: double>, cflag_bits array<struct<bit: int, name: string>>, compartments array<struct<compartment: int, n: bigint>>, flag_histogram {hist}, catcols array<struct<name: string, histogram: {hist}>>"
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v["n"])
    return docs.select(F.from_json("json", kind).alias("d")).select(
        "d.sample_id", "d.n_cells", "d.bbox_um.*", F.size("d.compartments").alias("compartments"), total(F.col("d.compartments")).alias("members"), F.size("d.flag_histogram").alias("flags"), total(F.col("d.flag_histogram")).alias("counted"), F.size(F.expr("d.catcols[0].histogram")).alias("levels"), F.size("d.cflag_bits").alias("named")
    )


@_query(
    "convolve_box",
    f"{_C}, px AS (SELECT DISTINCT sample_id, CAST(floor(x / 10) AS BIGINT) AS i, CAST(floor(y / 10) AS BIGINT) AS j FROM c), t AS (SELECT sample_id, max(i) AS i1, max(j) AS j1 FROM px GROUP BY sample_id), w AS (SELECT sample_id, i + di AS i, j + dj AS j, count(*) AS n FROM px, (SELECT unnest(generate_series(-5, 5)) AS di) a, (SELECT unnest(generate_series(-5, 5)) AS dj) b GROUP BY ALL) "
    "SELECT sample_id, i, count(*) AS width, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM w JOIN t USING (sample_id) WHERE i BETWEEN 0 AND i1 AND j BETWEEN 0 AND j1 GROUP BY sample_id, i",
)
def _(spark, sf_dir):
    runs = cohort.convolve(cells(spark, sf_dir), 10, 10.0)
    length = F.col("j_to") - F.col("j_from") + 1
    return runs.groupBy("sample_id", "i").agg(F.sum(length).alias("width"), F.sum(length * F.col("n")).alias("total"), F.max("n").alias("most"))


# ------------------------------------------------------------------ spatial joins

_NEAR = "a.sample_id = b.sample_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@_query("radius_counts", f"{_C} SELECT a.id, count(*) AS n FROM c a JOIN c b ON {_NEAR} < 2500 GROUP BY a.id")
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    return spatial.radius_join(c, c, 50.0).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _ring(r: spatial.Ring, rule: str) -> str:
    within = f"d2 >= {r.inner**2} AND d2 <= {r.outer**2}"
    dens = f"coalesce(count(*) FILTER ({within} AND {rule}), 0) * 1e6 / (pi() * {r.outer**2 - r.inner**2})"
    total = f"count(*) FILTER ({within})"
    return f"round(CASE WHEN {total} = 0 THEN 0 ELSE {dens} / {total} END, 6) AS {r.label}" if r.local else f"round({dens}, 6) AS {r.label}"


@_query("radial_density", f"{_C}, p AS (SELECT a.id, b.pflag AS pf, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM c a JOIN c b ON {_NEAR} < 2500) SELECT id, {_ring(RINGS[0], 'true')}, {_ring(RINGS[1], '(pf & 1) <> 0')}, {_ring(RINGS[2], '(pf & 33) = 33')} FROM p GROUP BY id")
def _(spark, sf_dir):
    return _rounded(spatial.radial_density(cells(spark, sf_dir), RINGS).select("id", "d_all", "d_click", "d_local"))


@_query("margin_flag", f"{_C} SELECT id, sample_id, cell_id, x, y, CASE WHEN EXISTS (SELECT 1 FROM c b WHERE {_NEAR} < 10000 AND (a.cflag & 1) <> (b.cflag & 1)) THEN cflag | 4 ELSE cflag & ~CAST(4 AS BIGINT) END AS cflag, pflag, m_value, m_k FROM c a")
def _(spark, sf_dir):
    return spatial.margin(cells(spark, sf_dir), 100)


@_query("filter_radius_mask", f"{_C} SELECT {_ALL} FROM c a WHERE EXISTS (SELECT 1 FROM c b WHERE {_NEAR} < 900 AND (b.pflag & 64) <> 0)")
def _(spark, sf_dir):
    return spatial.with_surroundings(cells(spark, sf_dir), F.col("pflag").bitwiseAND(64) != 0, 30)


@_query("dist_to_marked", f"{_C} SELECT a.id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS dist_mark FROM c a JOIN c b ON a.sample_id = b.sample_id AND (b.cflag & 2) <> 0 GROUP BY a.id")
def _(spark, sf_dir):
    return _rounded(spatial.distance_to_marked(cells(spark, sf_dir), "mark").select("id", "dist_mark"))


_KNN = "SELECT a.id, b.id AS n_id, b.cflag AS n_cflag, b.m_value AS n_value, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rank FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.id <> b.id QUALIFY rank <= {k}"


@_query("knn_pairs", f"{_C} SELECT id, n_id, d2, CAST(rank AS INTEGER) AS rank FROM ({_KNN.format(k=5)})")
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    return spatial.knn_join(c, c, 5)


@_query("annotate_knn", f"{_C}, n AS ({_KNN.format(k=25)}), s AS (SELECT id, avg(CASE WHEN (n_cflag & 2) <> 0 THEN 1.0 ELSE 0.0 END) AS f FROM n WHERE d2 <= 90000 GROUP BY id) SELECT c.id, CASE WHEN f >= 0.12 THEN (cflag & ~CAST(2 AS BIGINT)) | 16 ELSE cflag & ~CAST(2 AS BIGINT) END AS cflag FROM c LEFT JOIN s ON c.id = s.id")
def _(spark, sf_dir):
    return spatial.annotate(cells(spark, sf_dir), model.TCELL, 25, 0.12, 300).select("id", "cflag")


@_query("neighbour_mean", f"{_C}, n AS ({_KNN.format(k=6)}) SELECT id, round(avg(n_value), 6) AS lag_m_value FROM n GROUP BY id")
def _(spark, sf_dir):
    return _rounded(spatial.neighbour_mean(cells(spark, sf_dir), "m_value", 6).select("id", "lag_m_value"))


@_query("morans_i", f"{_C}, n AS ({_KNN.format(k=6)}), m AS (SELECT sample_id, avg(m_value) AS m FROM c GROUP BY sample_id), l AS (SELECT id, avg(n_value) AS lag FROM n GROUP BY id) SELECT c.sample_id, round(sum((m_value - m) * (lag - m)) / sum((m_value - m) * (m_value - m)), 6) AS moran FROM c JOIN m ON c.sample_id = m.sample_id JOIN l ON c.id = l.id GROUP BY c.sample_id")
def _(spark, sf_dir):
    return _rounded(spatial.morans_i(cells(spark, sf_dir), "m_value", 6))


@_query("knn_graph_column", f"{_C}, n AS ({_KNN.format(k=4)}) SELECT id, string_agg(n_id, ',' ORDER BY rank) AS knn FROM n GROUP BY id")
def _(spark, sf_dir):
    return graph.neighbour_lists(cells(spark, sf_dir), 4).select("id", F.array_join(F.expr("transform(knn, v -> cast(v.id as string))"), ",").alias("knn"))


# ------------------------------------------------------------------ clusters and graphs

_D = f"WITH RECURSIVE c AS ({CLUMPS}), "


@_query(
    "dbscan_clusters",
    _D + "k AS MATERIALIZED (SELECT * FROM c WHERE (pflag & 32) <> 0), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON " + _NEAR + " < 400), core AS MATERIALIZED (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 4), "
    "ce AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), r AS (SELECT id, id AS root FROM core UNION SELECT ce.b AS id, r.root FROM r JOIN ce ON r.id = ce.a AND r.root < ce.b), l AS (SELECT id, min(root) AS root FROM r GROUP BY id), "
    "f AS (SELECT id, root FROM l UNION ALL SELECT e.a AS id, min(l.root) AS root FROM e JOIN l ON e.b = l.id WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a), s AS (SELECT root FROM f GROUP BY root HAVING count(*) >= 5) "
    "SELECT c.id, CASE WHEN f.root IN (SELECT root FROM s) THEN f.root ELSE 0 END AS dbscan_cluster FROM c LEFT JOIN f ON c.id = f.id",
)
def _(spark, sf_dir):
    marked = rows.mark_cells(clumps(spark, sf_dir), [rows.Unit(pand=32)])
    return graph.dbscan(marked, 20, 4, 5).select("id", "dbscan_cluster")


def _roots(p: str, nodes: str, edges: str) -> str:
    """CTEs {p}r(id, root): the smallest id of each node's component. nodes: id; edges: a, b, both ways."""
    return (
        f"{p}e AS MATERIALIZED ({edges}), {p}r(id, root) USING KEY (id) AS (SELECT id, id AS root FROM {nodes} UNION "
        f"SELECT e.b AS id, min(r.root) AS root FROM {p}r r JOIN {p}e e ON r.id = e.a JOIN recurring.{p}r cur ON cur.id = e.b WHERE r.root < cur.root GROUP BY e.b)"
    )


def _island(p: str, source: str, size: int, stroma: bool, distance: int = 100, k: int = 10) -> str:
    """CTEs up to {p}out: the cells of source after islands are filled."""
    inside, other = ("(cflag & 1) = 1", "(n_cflag & 1) = 0") if stroma else ("(cflag & 1) = 0", "(n_cflag & 1) = 1")
    near = lambda b: f"(SELECT a.id, b.id AS n_id, b.cflag AS n_cflag, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM {p}own a JOIN {b} b ON {_NEAR} < {distance * distance} AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d2, b.id) <= {k})"
    return (
        f"{p}in AS MATERIALIZED (SELECT * REPLACE (cflag & ~CAST(4 AS BIGINT) AS cflag) FROM {source}), {p}own AS MATERIALIZED (SELECT * FROM {p}in WHERE {inside}), "
        + _roots(p, f"{p}own", f"SELECT id AS a, n_id AS b FROM {near(f'{p}own')} UNION SELECT n_id, id FROM {near(f'{p}own')}")
        + f", {p}t AS MATERIALIZED (SELECT DISTINCT id FROM {near(f'{p}in')} WHERE {other}), "
        f"{p}f AS MATERIALIZED (SELECT r.root FROM {p}r r LEFT JOIN {p}t t ON r.id = t.id GROUP BY r.root HAVING count(*) < {size} AND count(t.id) > 0), {p}g AS MATERIALIZED (SELECT id FROM {p}r WHERE root IN (SELECT root FROM {p}f)), "
        f"{p}out AS MATERIALIZED (SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM {p}g) THEN {'cflag & ~CAST(1 AS BIGINT)' if stroma else 'cflag | 1'} ELSE cflag END AS cflag) FROM {p}in)"
    )


_R = f"WITH RECURSIVE c AS ({CELLS}), "


@_query("island_fill", f"{_R}{_island('i', 'c', 50, True)} SELECT id, cflag FROM iout")
def _(spark, sf_dir):
    return graph.island(cells(spark, sf_dir), 50, stroma=True).select("id", "cflag")


def _triangles(p: str, source: str, limit: int) -> str:
    """CTEs up to {p}d(id, delaunay_component, delaunay_count), by all pairs of places within the limit."""
    return (
        f"{p}p AS MATERIALIZED (SELECT sample_id, x, y, min(id) AS id FROM {source} GROUP BY sample_id, x, y), "
        + _roots(p, f"{p}p", f"SELECT a.id AS a, b.id AS b FROM {p}p a JOIN {p}p b ON {_NEAR} <= {limit * limit} AND a.id <> b.id")
        + f", {p}n AS (SELECT root, count(*) AS n FROM {p}r GROUP BY root), {p}d AS MATERIALIZED (SELECT s.id, CASE WHEN n.n > 1 THEN r.root ELSE 0 END AS delaunay_component, n.n AS delaunay_count FROM {source} s JOIN {p}p p ON s.sample_id = p.sample_id AND s.x = p.x AND s.y = p.y JOIN {p}r r ON p.id = r.id JOIN {p}n n ON r.root = n.root)"
    )


@_query("delaunay_components", f"{_R}{_triangles('z', 'c', 20)} SELECT id, delaunay_component, delaunay_count FROM zd")
def _(spark, sf_dir):
    return graph.delaunay(cells(spark, sf_dir), 20).select("id", "delaunay_component", "delaunay_count")


@_query("delaunay_clumps", f"WITH RECURSIVE c AS ({CLUMPS}), {_triangles('z', 'c', 15)} SELECT id, delaunay_component, delaunay_count FROM zd")
def _(spark, sf_dir):
    return graph.delaunay(clumps(spark, sf_dir), 15).select("id", "delaunay_component", "delaunay_count")


@_query("delaunay_edges")
def _(spark, sf_dir):
    return graph.delaunay_edge_list(clumps(spark, sf_dir), 50)


@_query("tls_calls")
def _(spark, sf_dir):
    c = clumps(spark, sf_dir).select("sample_id", *model.FIXED)
    return graph.tls(c, 1, 7, 30, 100).select("id", "cflag", "dbscan_cluster", "tls_id")


@_query("lda_topics")
def _(spark, sf_dir):
    counts = agg.tiles(cells(spark, sf_dir).withColumns({m: F.bit_get("pflag", F.lit(i)).cast("double") * 100 for i, m in enumerate(MARKERS)}), MARKERS)
    fitted = topics.fit_topics(counts, MARKERS, topics=4, iterations=5)
    return topics.topic_weights(counts, fitted, MARKERS).select("sample_id", "frame_x", "frame_y", *[f"topic{i}" for i in range(1, 5)])


# ------------------------------------------------------------------ null models


@_query("scramble_counts", f"{_C} SELECT sample_id, count(*) AS n, " + ", ".join(f"count(*) FILTER ((pflag & {1 << i}) <> 0) AS {m}_count" for i, m in enumerate(MARKERS)) + " FROM c GROUP BY sample_id")
def _(spark, sf_dir):
    s = random_models.scramble(cells(spark, sf_dir), len(MARKERS), seed=1)
    return s.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.bit_get("pflag", F.lit(i)) == 1).alias(f"{m}_count") for i, m in enumerate(MARKERS)])


def _scrambled(bits: list[int | None]) -> str:
    """The cells of c with the bits (None: the register) permuted within each sample."""
    numbered = lambda d: f"row_number() OVER (PARTITION BY sample_id ORDER BY {d}, id)"
    out = f"{_C}, base AS (SELECT *, {numbered(draw_sql('id', 1))} AS n FROM c)"
    for i, b in enumerate(bits):
        out += f", s{i} AS (SELECT sample_id, {'pflag' if b is None else f'pflag & {1 << b}'} AS v, {numbered(draw_sql('id', 2, -1 if b is None else b))} AS n FROM c)"
    joins = " ".join(f"JOIN s{i} ON base.sample_id = s{i}.sample_id AND base.n = s{i}.n" for i in range(len(bits)))
    return f"{out} SELECT id, base.sample_id, cell_id, x, y, cflag, {' | '.join(f's{i}.v' for i in range(len(bits)))} AS pflag, m_value, m_k FROM base {joins}"


@_query("scramble_flags", _scrambled(list(range(len(MARKERS)))))
def _(spark, sf_dir):
    return random_models.scramble(cells(spark, sf_dir), len(MARKERS), seed=1)


@_query("scramble_whole", _scrambled([None]))
def _(spark, sf_dir):
    return random_models.scramble(cells(spark, sf_dir), len(MARKERS), seed=1, whole=True)


@_query("scatter", f"{_C} SELECT id, sample_id, cell_id, CAST({draw_sql('id', 1, 0)} % 1001 AS DOUBLE) AS x, CAST({draw_sql('id', 1, 1)} % 501 AS DOUBLE) AS y, cflag, pflag, m_value, m_k FROM c")
def _(spark, sf_dir):
    return random_models.scatter(cells(spark, sf_dir), 1000, 500, seed=1)


@_query("hallucinate", f"{_C} SELECT id, sample_id, cell_id, x, y, cflag, CAST(1 AS BIGINT) << CAST({draw_sql('id', 1)} % 5 AS INTEGER) AS pflag, " + ", ".join(f"CAST(0 AS FLOAT) AS fake{i}" for i in range(1, 6)) + " FROM c")
def _(spark, sf_dir):
    return random_models.hallucinate(cells(spark, sf_dir), header(), 5, seed=1)[0]


def _unit(by: str, what: int) -> str:
    return f"(({draw_sql(by, 1, what)} + 0.5) / {PRIME}.0::DOUBLE)"


def _normal(a: int, b: int) -> str:
    return f"sqrt(-2 * ln({_unit('i', a)})) * cos(6.283185307179586 * {_unit('i', b)})"


@_query("synth_cells", f"SELECT i AS id, CAST(0 AS BIGINT) AS sample_id, i AS cell_id, round({_unit('k', 0)} * 1000 + 10 * {_normal(2, 3)}, 6) AS x, round({_unit('k', 1)} * 1000 + 10 * {_normal(4, 5)}, 6) AS y, CAST(0 AS BIGINT) AS cflag, CAST(0 AS BIGINT) AS pflag, CAST(0 AS FLOAT) AS marker1 FROM (SELECT range AS i, range // 50 AS k FROM range(1000))")
def _(spark, sf_dir):
    return _rounded(random_models.synthesise(spark, 20, 50, seed=1)[0])


# ------------------------------------------------------------------ streams


@_query("stream_counts", f"{_C} SELECT sample_id, count(*) AS n, count(*) FILTER ((pflag & 1) <> 0) AS click_count, count(*) FILTER ((pflag & 32) <> 0) AS mid_count FROM c WHERE m_value > 30 GROUP BY sample_id")
def _(spark, sf_dir):
    """The cells as files of a stream, filtered row by row and counted over several micro-batches."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    cells(spark, sf_dir).repartition(6).write.parquet(f"{where}/in")
    like = spark.read.parquet(f"{where}/in")
    stream = streams.read(spark, f"{where}/in", like, files_per_batch=2)
    counts = streams.counts(rows.filter_cells(stream, fields=[("m_value", ">", 30.0)]), {"click": 0, "mid": 5})

    def step(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/{k}")

    query = counts.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = cut(spark.read.parquet(f"{where}/out/{query.lastProgress['batchId']}"))
    remove(spark, where)
    return out


# ------------------------------------------------------------------ composed plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gates, selection and counts in one scan: what each phenotype counts among the gated cells."""
    gated = rows.phenotype(cells(spark, sf_dir), DATA, GATES)
    chosen = rows.filter_cells(gated, [rows.Unit(pand=1)], [("x", ">", 100.0)])
    return agg.cell_count(chosen, DATA, [3, 0])


_query("flagship_counts", f'{_C}, g AS (SELECT *, {_GATED} AS pf FROM c) SELECT count(*) FILTER ((pf & 1) <> 0) AS m_value_count, count(*) FILTER ((pf & 2) <> 0) AS m_k_count, count(*) FILTER ((pf & 3) = 3) AS "3_count", count(*) FILTER (pf = 0) AS "0_count" FROM g WHERE (pf & 1) = 1 AND x > 100')(flagship)


_CHAIN = (
    f"{_R} g0 AS (SELECT * REPLACE ({_GATED} AS pflag) FROM c), g AS MATERIALIZED (SELECT * REPLACE (CASE WHEN (pflag & 3) = 3 THEN cflag | 2 ELSE cflag & ~CAST(2 AS BIGINT) END AS cflag) FROM g0), "
    "nn AS (SELECT a.id, b.cflag AS n_cflag FROM g a JOIN g b ON a.sample_id = b.sample_id AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) <= 25), "
    "sh AS MATERIALIZED (SELECT id, avg(CASE WHEN (n_cflag & 2) <> 0 THEN 1.0 ELSE 0.0 END) AS f FROM nn GROUP BY id), "
    "an AS (SELECT g.* REPLACE ((CASE WHEN f >= 0.33 THEN cflag | 1 ELSE cflag END) & ~CAST(2 AS BIGINT) AS cflag, 2000 - x AS x) FROM g LEFT JOIN sh ON g.id = sh.id), "
    "fl AS MATERIALIZED (SELECT * REPLACE (CASE WHEN " + " OR ".join(f"(sample_id = {s} AND {_inside(p)})" for _, _, s, p in ROIS) + " THEN cflag | 8 ELSE cflag END AS cflag) FROM an), "
    "di AS MATERIALIZED (SELECT a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM fl a JOIN fl b ON a.sample_id = b.sample_id AND (b.cflag & 1) <> 0 GROUP BY a.id), "
    f"ra AS MATERIALIZED (SELECT id, {_ring(RINGS[0], 'true')}, {_ring(RINGS[1], '(pf & 1) <> 0')} FROM (SELECT a.id, b.pflag AS pf, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM fl a JOIN fl b ON {_NEAR} < 2500) GROUP BY id), "
    + _triangles("z", "fl", 20)
    + " SELECT fl.id, sample_id, cell_id, x, y, cflag, pflag, m_value, m_k, round(coalesce(d, 'nan'::DOUBLE), 6) AS dist_tumor, d_all, d_click, delaunay_component, delaunay_count FROM fl LEFT JOIN di ON fl.id = di.id JOIN ra ON fl.id = ra.id JOIN zd ON fl.id = zd.id"
)


@_query("tumor_chain", _CHAIN)
def _(spark, sf_dir):
    """The chain of a slide: gates, mark, annotate, flip, regions, distance, densities, triangulation."""
    c = rows.magnify(cells(spark, sf_dir), 1.0)
    c = rows.phenotype(c, DATA, GATES)
    c = rows.mark_cells(c, [rows.Unit(pand=3)])
    c = cut(spatial.annotate(c, model.TUMOR, 25, 0.33, 10_000))
    c = regions.flag_regions(rows.flip(c, 1000), _rois(spark), model.CFLAG_BITS["TumorManual"])
    c = cut(spatial.distance_to_marked(rows.mark_cells(c, [rows.Unit(cand=model.TUMOR)]), "tumor"))
    c = spatial.radial_density(c, RINGS[:2])
    return _rounded(graph.delaunay(c, 20))


@_query(
    "margin_chain",
    f"{_R}{_island('i', 'c', 50, False)}, {_island('j', 'iout', 50, True)} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM jout b WHERE {_NEAR} < 10000 AND (a.cflag & 1) <> (b.cflag & 1)) THEN cflag | 4 ELSE cflag & ~CAST(4 AS BIGINT) END AS cflag FROM jout a",
)
def _(spark, sf_dir):
    c = graph.island(cells(spark, sf_dir), 50)
    return spatial.margin(graph.island(c, 50, stroma=True), 100).select("id", "cflag")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
