"""Counters of a write against separate aggregates, and those of streams."""

import pytest
from pyspark.sql import functions as F

from postloom.plans import queries, summaries

DIR = "/root/testdata/sf0.001"


def test_counters_are_the_writes_own(spark, tmp_path):
    results = queries.classified(spark, DIR).select("keyword", "pos", "url", "platform", "post_id", "status").persist()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    try:
        got = summaries.write_accepted(results, str(tmp_path / "out"))
        n_jobs = len(jobs.getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    reasons = queries._reasons(spark, DIR)
    want = {f"rejected_{r.reason}": r["count"] for r in reasons.where("reason is not null").groupBy("reason").count().collect()}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {k: v for k, v in got.items() if k.startswith("rejected_") and k != "rejected_count" and v} == want and got["rejected_count"] == sum(want.values())
    assert got["search_result_count"] == results.count() and got["batch_input_count"] == out.count() == out.select("platform", "post_id").distinct().count()
    assert got["accepted_before_global_dedup"] == reasons.where("reason is null").count() and got["failed_count"] == out.where("status = 'failed'").count()
    assert n_jobs <= 6  # stages of one write; AQE runs each as a job


def test_empty(spark, tmp_path):
    got = summaries.write_accepted(queries.classified(spark, DIR).select("keyword", "pos", "url", "platform", "post_id", "status").where("false"), str(tmp_path / "out"))
    assert set(got.values()) == {0}
    r = summaries.pipeline_summary(spark, got, {}).first()
    assert r.pipeline_status == "no_accepted_urls" and not r.batch_started


@pytest.mark.parametrize(("row", "want"), [(("held", 1, 1, 0, 1), "held"), (("", 1, 1, 0, 1), "partial_search_failure"), ((None, 1, 0, 0, 1), "no_accepted_urls"), ((None, 0, 1, 3, 1), "batch_completed_with_failures"),
                                           ((None, 0, 1, 3, 0), "success")])
def test_status(spark, row, want):
    df = spark.createDataFrame([row], "o string, f int, g int, i int, b int")
    assert df.select(summaries.pipeline_status(*map(F.col, "ofgib"))).first()[0] == want


def test_stream_counters(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "in"))
    listener = summaries.StreamCounters()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id") % 2 == 0).alias("even"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.sums == {"seen": {"rows": 100, "even": 50}}


def test_without_batch(spark):
    r = summaries.without_batch(spark, {"a": "failed", "b": "failed"}, "search_failed").first()
    assert (r.pipeline_status, r.keyword_failed_count, r.batch_input_count, r.batch_started) == ("search_failed", 2, 0, False)
