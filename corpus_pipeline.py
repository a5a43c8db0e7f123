"""A corpus pipeline of five stages: toxicity, exact dedup, SimHash near-dedup, personal data, best-fit packing.

Each stage works on all that the one before kept. Between stages documents are Parquet in the folder that the cluster
shares, so a lost executor never goes back further than one stage.

Cases, of every stage but where it says more: a null text counts as empty; a null doc_id is a document that comes last;
rows that repeat a doc_id are documents of their own, each decided by its own text; texts of any length are read whole;
further columns, whatever their names, are passed through; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import exact_dedup as exact
from postloom.llm import pii, toxicity
from postloom.llm.common import bitmap, in_bitmap, out_of_bitmap, shared_folder, stored, whole_row
from postloom.llm.near_copies import near_copies
from postloom.llm.packing import pack_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, rejects go; a text without words is clean."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def only_kept(docs: DataFrame, decided: DataFrame, digest: Column) -> DataFrame:
    """The rows of docs that stay by decided: (doc_id, h, kept) for every row, h the row's digest. Of rows that share
    doc_id and digest at most one is kept; which of them is open.

    Whole rows are shuffled only where a bitmap of fixed size says that a row of their digest may have to go.
    """
    gone = stored(decided.groupBy(F.col("doc_id").alias("gone_id"), "h").agg(
        F.count("*").alias("rows"), F.max("kept").alias("stays")).where("rows > 1 or not stays"))
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("row_id"), digest.alias("row_h"))
    words = bitmap(gone, "h")
    rest = in_bitmap(rows, "row_h", words).join(gone, F.col("row_id").eqNullSafe(F.col("gone_id")) & (F.col("row_h") == F.col("h")), "left")
    one = rest.where("stays").dropDuplicates(["row_id", "row_h"])
    return out_of_bitmap(rows, "row_h", words).select("row.*").union(rest.where("stays is null").select("row.*")).union(one.select("row.*"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the least doc_id stays."""
    decided = exact.exact_dedup(*exact.split_by_id(docs)).select("doc_id", F.xxhash64("text_sha256").alias("h"), "kept")
    return only_kept(docs, decided, F.xxhash64(F.sha2(exact.normalised(), 256)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents at Jaccard 0.8 or more over five-word shingles the one with the least doc_id stays."""
    return only_kept(docs, near_copies(docs).withColumnRenamed("sha", "h"), F.xxhash64(F.coalesce("text", F.lit(""))))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selected spans of personal data are replaced by their kinds; null texts stay null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in sequences of 2048 tokens. Further columns end here."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack),
]

#: The trained stages (toxicity, personal data) and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to packed pieces."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
