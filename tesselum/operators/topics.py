"""Topic models of cells: whole-number columns are a cell's word counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    whole = {f"_t_{c}": F.greatest(F.col(c).cast("int"), F.lit(0)).cast("double") for c in columns}
    return VectorAssembler(inputCols=list(whole), outputCol="_words").transform(df.withColumns(whole)).drop(*whole)


def fit_topics(df: DataFrame, columns: Sequence[str], topics: int = 10, iterations: int = 10, seed: int = 0) -> LDAModel:
    return LDA(k=topics, maxIter=iterations, seed=seed, optimizer="online", featuresCol="_words", topicDistributionCol="_topics").fit(_vectors(df, columns))


def topic_weights(df: DataFrame, model: LDAModel, columns: Sequence[str]) -> DataFrame:
    """topic1..topicK: the weights, of sum 1."""
    out = model.transform(_vectors(df, columns)).withColumn("_topics", vector_to_array("_topics"))
    total = F.aggregate("_topics", F.lit(0.0), lambda a, x: a + x)
    k = model.getK() if hasattr(model, "getK") else model.topicsMatrix().numCols
    return out.withColumns({f"topic{i + 1}": F.get("_topics", F.lit(i)) / total for i in range(k)}).drop("_words", "_topics")
