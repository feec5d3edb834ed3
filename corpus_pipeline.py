"""From raw documents to token ids: the stages of a training corpus, each an operator of tesselum.llm over all that the stage before kept.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents. `run` writes each
stage's rows to the shared folder and reads them again, so that a lost executor costs at most one stage; a stage's rows go when the next one's are written.

Edge cases, beside those of the operators: a null, empty or blank text fails the base quality rules and goes with the first stage; of repeated rows
and equal texts one stays, that of the smallest doc_id (null only if there is no other); unlike texts that share a doc_id both stay; nulls in other columns
and extra columns, whatever their names, pass through to the last stage; an empty table gives no rows; very long texts are treated whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm import decontamination, pii, quality_rules, sentence_pieces, simhash
from tesselum.llm.common import remove, shared_dir, table


def _aside(docs: DataFrame) -> DataFrame:
    """docs with all columns but the text under names that no operator uses."""
    return docs.toDF(*[c if c == "text" else f"_{i}_" for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the decision list, learned from labels.quality, keep."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    rest = _aside(docs)
    return quality_rules.judge(rest, rules).where("kept").select(*rest.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    return simhash.distinct(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark table."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    out = pii.pseudonymise(_aside(docs)).drop("n_entities").toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the end id, and the bytes of the text that they stand for: doc_id, lang, source, n_tokens, ids, spans."""
    rows = sentence_pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "spans")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", private),
    ("SentencePiece encoding", tokens),
]

#: The learned list, the fingerprints, the surrogates and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{where}/{k}")
            docs = spark.read.parquet(f"{where}/{k}")
            if k:
                remove(spark, f"{where}/{k - 1}")
    return docs
