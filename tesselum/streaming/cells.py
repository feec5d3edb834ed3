"""Cells as streams. Row-wise operators run on a stream as they are; here are the counts, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def counts(stream: DataFrame, bits: dict[str, int]) -> DataFrame:
    """Running counts per sample: cells, and those with each phenotype bit. Output mode complete or update."""
    each = [F.sum(F.bit_get("pflag", F.lit(b)).cast("long")).alias(f"{m}_count") for m, b in bits.items()]
    return stream.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), *each)


def windowed(stream: DataFrame, ts: str, every: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts per tumbling window and kind, with late rows up to the watermark. An addition: cells have no event time."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), by).agg(F.count(F.lit(1)).alias("n"))


def each_batch(stream: DataFrame, whole: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run an operator that needs whole samples on each micro-batch, whose files hold whole samples, and append to Parquet under the batch's own folder, so a repeated batch overwrites itself."""

    def step(batch: DataFrame, k: int) -> None:
        whole(batch).write.mode("overwrite").parquet(f"{out}/batch={k}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
