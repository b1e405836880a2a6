"""A corpus pipeline of five operators; each stage is written as Parquet and read again.

Quality rules reject documents, exact and near copies leave, the rest is mixed to
target weights (a document may then occur in up to two copies, the one at a source's
end in part), and the mix is encoded.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import bpe, dedup, mixing, ngram_join, quality
from panelspark.llm.queries import vocabulary
from panelspark.sources.readers import table
from panelspark.sources.store import scratch, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, vocabulary()).drop("text")


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup),
          ("mixing", mix), ("bpe", encode)]

# The splitting tree and the encoding are not expressible in SQL; tests hold every stage
# against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        # what a stage cuts is of no use once its rows are written
        with scratch(spark):
            # zstd: texts in shuffled order are most of the disk of a stage
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
