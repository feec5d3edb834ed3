"""Cell tables made from the driver's tables, by one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The phenotype bits, in order: five event kinds and two gates on the value.
MARKERS = ("click", "error", "purchase", "signup", "view", "mid", "high")
DATA = ("m_value", "m_k")

_BITS = " + ".join([*(f"CASE WHEN event_type = '{m}' THEN {1 << i} ELSE 0 END" for i, m in enumerate(MARKERS[:5])), "CASE WHEN value >= 50 THEN 32 ELSE 0 END", "CASE WHEN value >= 120 THEN 64 ELSE 0 END"])


def _cells(x: str, y: str) -> str:
    return (
        "SELECT CAST((user_id % 8) * 4294967296 + event_id AS BIGINT) AS id, CAST(user_id % 8 AS BIGINT) AS sample_id, event_id AS cell_id, x, y, "
        "CAST((CASE WHEN (x - 1000) * (x - 1000) + (y - 1000) * (y - 1000) < 250000 THEN 1 ELSE 0 END) + (CASE WHEN value > 120 THEN 2 ELSE 0 END) AS BIGINT) AS cflag, "
        f"CAST({_BITS} AS BIGINT) AS pflag, value AS m_value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS m_k "
        f"FROM (SELECT *, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM events) e"
    )


#: Cells on a lattice of whole coordinates, so that distances are exact.
CELLS = _cells("(event_id * 7919) % 2003", "(event_id * 104729) % 1999")
#: Cells in clumps around their user's place.
CLUMPS = _cells("(user_id * 337) % 2000 + (event_id * 31) % 61", "(user_id * 811) % 2000 + (event_id * 17) % 59")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events)", "FROM {events})"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CELLS)


def clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CLUMPS)
