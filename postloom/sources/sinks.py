"""Outputs: JSON Lines, CSV with a byte-order mark, whole-table swaps, logs and the Markdown report."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the export, and log fields that are never written.
FINAL_FIELDS = ("author", "content", "publish_time", "like_count", "share_count", "comment_count", "comments")
SECRET_FIELDS = ("cookie", "cookies", "authorization", "storage_state", "html")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def swap_in(df: DataFrame, path: str, kind: str = "json") -> None:
    """Replace the table at path only once the new one is whole; a failure leaves the old one."""
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.format(kind).save(staged)
    fs, target = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not replace {path}")
    if had:
        fs.delete(old, True)


def csv_rows(final: DataFrame) -> DataFrame:
    """The seven columns of the export, comments as JSON."""
    return final.select(*(F.to_json(c).alias(c) if c == "comments" else c for c in FINAL_FIELDS))


def write_csv(final: DataFrame, path: str) -> None:
    """A folder of CSV parts with a header; each begins with a byte-order mark, as the header's first name does. Values are
    quoted where they need it, so that no quote comes before the mark."""
    rows = csv_rows(final)
    rows.withColumnRenamed(FINAL_FIELDS[0], "﻿" + FINAL_FIELDS[0]).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def log_fields(extras: Column) -> Column:
    return F.map_filter(extras, lambda k, _: ~F.lower(k).isin(*SECRET_FIELDS))


def report(posts: DataFrame) -> str:
    """Markdown of status counts, failure categories in order and comments; posts: collection_status, failure_category,
    comments. Three aggregates of a few rows each reach the driver."""
    status = posts.groupBy(F.coalesce("collection_status", F.lit("None")).alias("k")).count().orderBy("k").collect()
    kinds = posts.where("failure_category <> ''").groupBy("failure_category").count().orderBy("failure_category").collect()
    comments = posts.agg(F.coalesce(F.sum(F.coalesce(F.size("comments"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    lines = ["# Collection report", "", "| Status | Records |", "|---|---|", *(f"| {r['k']} | {r['count']} |" for r in status), "",
             "| Failure category | Records |", "|---|---|", *(f"| {r[0]} | {r[1]} |" for r in kinds), "", f"Comments: {comments}", ""]
    return "\n".join(lines)


DDL = {
    "collection_runs": "id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, keywords_json STRING, platform_order_json STRING, global_limit INT, output_path STRING, summary_json STRING",
    "authors": "id BIGINT, platform STRING, name STRING, handle STRING, profile_url STRING, type STRING, raw_json STRING",
    "posts": "id BIGINT, platform STRING, post_id STRING, input_url STRING, canonical_url STRING, author_id BIGINT, collection_run_id BIGINT, content STRING,"
             " publish_time TIMESTAMP, comment_count BIGINT, like_count BIGINT, share_count BIGINT, repost_count BIGINT, view_count BIGINT,"
             " collection_status STRING, error STRING, collected_at TIMESTAMP, platform_metrics_json STRING, platform_context_json STRING, raw_json STRING",
    "post_keywords": "post_id BIGINT, keyword STRING",
}


def create_tables(spark: SparkSession) -> None:
    for name, columns in DDL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
