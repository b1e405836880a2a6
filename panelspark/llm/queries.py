"""Queries of the operators, each over its whole table, and their DuckDB twins."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.readers import table
from ..sources.store import shared_dir
from . import (align, bpe, conversations, dedup, licenses, mixing, ngram_join, pii, quality, sharding, sql, tokenfile, urls,
               warc)

VOCABULARY = "word_bpe_49k.json"

QUERIES = {}
SQL = {}


def query(name, twin=None):
    def wrap(fn):
        QUERIES[name] = fn
        if twin:
            SQL[name] = twin
        return fn
    return wrap


@query("op6_quality_rules", sql.QUALITY)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept")


@query("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


@query("op2_mixing", sql.MIXING)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, vocabulary(), ids=False).drop("text")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pii.found(table(spark, sf_dir, "documents"))
    return f.select("doc_id", *[f"n_{k}" for k in pii.PATTERNS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
                    pii.joined(F.col("spans")).alias("spans"))


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sharding.assigned(table(spark, sf_dir, "documents"))
    return a.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query("op7_url_filters")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.labelled_names(spark)).select("page_id", "host", "path", "rule", "verdict")


@query("op8_warc", sql.WARC)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.pages_of(warc.read(spark, path))


@query("op9_license_scans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query("op10_exact_dedup", sql.DEDUP)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.copy_groups(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.aligned(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), groups=False).drop("text")


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))
    return r.withColumn("repaired_sha256", conversations.digest(F.col("turns"))).drop("turns")


@query("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return tokenfile.read(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
