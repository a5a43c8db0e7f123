"""The engine's incremental paths as Structured Streaming: resume, history and restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom.functions.url import classify
from postloom.operators.relational import history_upsert
from postloom.sources.versions import VersionedTables


def distinct_posts(stream: DataFrame, time: str | None = None, late: str = "7 days") -> DataFrame:
    """Supported posts of a stream with a column url, each identity once. With an event-time column the state is
    bounded: an identity is forgotten once the watermark passes it by `late`."""
    posts = classify(stream).where("platform is not null")
    if time is None:
        return posts.dropDuplicates(["platform", "post_id"])
    return posts.withWatermark(time, late).dropDuplicatesWithinWatermark(["platform", "post_id"])


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Posts a platform and window of event time; late rows beyond the watermark are left out."""
    posts = classify(stream).where("platform is not null").withWatermark(time, late)
    return posts.groupBy(F.window(time, width), "platform").count().select("window.start", "window.end", "platform", "count")


def append_available(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to a table and stop; the next call resumes behind it."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table)


HISTORY = "platform string, post_id string, canonical_url string, first_run string, last_run string, status string"


def upsert_history(stream: DataFrame, path: str, checkpoint: str, run: str) -> StreamingQuery:
    """Keep the history at path up to date with each micro-batch of posts.

    A batch rewrites the buckets that its identities fall into, no others, and becomes visible at once; a batch that is replayed
    after a failure is left out.
    """
    tables = VersionedTables(stream.sparkSession, path)

    def merge(batch: DataFrame, number: int) -> None:
        change = tables.begin()
        if not change.has_seen("history", number):
            change.merge("history", HISTORY, ["platform", "post_id"], batch, lambda old, rows: history_upsert(old, rows, run))
            change.commit("history", number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return VersionedTables(spark, path).read("history", HISTORY)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table at path: read if an earlier run finished it, else made, written and read."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
