"""Raw documents to token ids in five stages; each reads all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm import bpe, line_dedup, mixing, near_dup, quality
from photocat.llm.common import remove, table
from photocat.session import work_dir

#: The mix hands out so much of the tokens that are left, and takes no document twice.
MIX_PERCENT = 90
MIX_EPOCHS = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.filter_quality(docs)


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go; ``n_chars`` follows the text."""
    out = line_dedup.remove_boilerplate(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dup.one_of_each(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its share of the budget."""
    return mixing.repeated(docs, percent=MIX_PERCENT, max_epochs=MIX_EPOCHS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary_path()).withColumnRenamed("ids", "token_ids")


STAGES = [("quality rules", quality_rules), ("line dedup", line_spread), ("near dedup", near_copies), ("mixing", target_weights), ("byte BPE", byte_bpe)]

#: The outlier estimate of the first stage is iterative; tests hold run() against a version without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what the next one has read goes."""
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
