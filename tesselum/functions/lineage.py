"""Where intermediate results lie: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or an own folder where that is unset (local mode)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tesselum-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, *, forget: bool = False) -> DataFrame:
    """Materialise df in the shared folder; a lost executor then costs no recomputation of what made it.

    A checkpoint keeps its plan's size estimates and constraints, and in a loop of joins these multiply until planning takes
    longer than running. forget drops them, for a conversion of each row in the JVM.
    """
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    out = df.checkpoint(eager=True)
    if not forget:
        return out
    return DataFrame(spark._jsparkSession.createDataFrame(out._jdf.toJavaRDD(), out._jdf.schema()), spark)


def kept(df: DataFrame, folder: str) -> DataFrame:
    """df, written to a folder of the shared one and read again: by columns and compressed, a fraction of a checkpoint's size."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tesselum_shipped", False):
        return
    package, where = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="tesselum-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{where}/{package.name}", "zip", package.parent, package.name))
    sc._tesselum_shipped = True
