"""Summaries of runs from counters that the write itself keeps: no table is read again to be counted.

`Counters.watch` puts an Observation at a place in a plan; one action then fills all of them. Streams report theirs by batch to a listener.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from postloom.operators import relational as rel

# Why a search result isn't taken, and how a run ended.
REASONS = ("missing_url", "unsupported_url", "non_facebook_post", "duplicate_facebook_post")
STATUSES = ("partial_search_failure", "no_accepted_urls", "batch_completed_with_failures", "success")


class Counters:
    """Counters at places of one plan, there once the plan has run."""

    def __init__(self) -> None:
        self.places: list[Observation] = []

    def watch(self, df: DataFrame, **counters: Column) -> DataFrame:
        place = Observation(f"counters-{uuid.uuid4().hex}")
        self.places.append(place)
        return df.observe(place, *(c.alias(k) for k, c in counters.items()))

    def get(self) -> dict[str, int]:
        """Waits for the action that fills them; without rows counts are 0."""
        return {k: v or 0 for place in self.places for k, v in place.get.items()}


class StreamCounters(StreamingQueryListener):
    """Sums what queries report by their observed counters, batch by batch. Add it by spark.streams.addListener; name a place of a
    stream by df.observe(name, ...)."""

    def __init__(self) -> None:
        self.sums: dict[str, dict[str, int]] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            for name, row in event.progress.observedMetrics.items():
                sums = self.sums.setdefault(name, {})
                for k, v in row.asDict().items():
                    sums[k] = sums.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def pipeline_status(override: Column, failed_keywords: Column, good_keywords: Column, inputs: Column, batch_failed: Column) -> Column:
    """How a run ended: as it was overridden, else by the first rule that holds."""
    partial, none, failures, success = map(F.lit, STATUSES)
    rest = F.when((failed_keywords > 0) & (good_keywords > 0), partial).when(inputs == 0, none).when(batch_failed > 0, failures).otherwise(success)
    return F.coalesce(F.nullif(override, F.lit("")), rest)


def of_status(*statuses: str) -> Column:
    return F.count_if(F.coalesce(F.col("status").isin(*statuses), F.lit(False)))


def write_accepted(results: DataFrame, path: str) -> dict[str, int]:
    """Write the posts of search results (keyword, pos, url, platform, post_id, status), each once, to path; gives the counters of that one job.

    Of a post of several keywords the first stays. Counted on the way: results, rejections by reason, what was accepted before and
    after keywords were put together, and how the posts' collection went.
    """
    c = Counters()
    first = rel.with_first_position(results, ["keyword", "platform", "post_id"], "pos")
    judged = first.withColumn("reason", rel.reject_reason(F.col("first_pos"), F.col("pos"), F.col("url"), F.col("platform")))
    because = {f"rejected_{r}": F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))) for r in REASONS}
    judged = c.watch(judged, search_result_count=F.count(F.lit(1)), rejected_count=F.count("reason"), **because)
    accepted = c.watch(judged.where("reason is null"), accepted_before_global_dedup=F.count(F.lit(1)))
    unique = rel.dedupe_first(accepted.select("platform", "post_id", "keyword", "pos", "url", "status"), ["platform", "post_id"], "pos")
    posts = c.watch(unique, batch_input_count=F.count(F.lit(1)), success_count=of_status("success", "partial"), failed_count=of_status("failed"), skipped_count=of_status("skipped"))
    posts.write.parquet(path)
    return c.get()


def pipeline_summary(spark: SparkSession, counts: dict[str, int], keywords: dict[str, str], earlier: dict[str, int] | None = None, override: str | None = None) -> DataFrame:
    """One row: a run's summary from write_accepted's counters, the keywords' search status (success, manifest or failed), and
    the counts of earlier runs for the totals."""
    good, bad = (sum(s in kinds for s in keywords.values()) for kinds in (("success", "manifest"), ("failed",)))
    earlier = earlier or {}
    ended = ("success_count", "failed_count", "skipped_count")
    within = counts["rejected_duplicate_facebook_post"]
    across = max(0, counts["accepted_before_global_dedup"] - counts["batch_input_count"])
    row = {
        "keyword_count": len(keywords), "keyword_success_count": good, "keyword_failed_count": bad, **{k: counts[k] for k in (
            "search_result_count", "accepted_before_global_dedup", "rejected_count", *(f"rejected_{r}" for r in REASONS), "batch_input_count")},
        "accepted_count": counts["batch_input_count"], "duplicate_count": within + across, "deduplicated_count": within + across, **{f"batch_{k}": counts[k] for k in ended},
        "batch_partial_count": 0, "batch_record_count": sum(counts[k] for k in ended), **{f"total_{k}": counts[k] + earlier.get(k, 0) for k in ended},
        "total_record_count": sum(counts[k] + earlier.get(k, 0) for k in ended),
    }
    df = spark.createDataFrame([(*row.values(), override)], ", ".join(f"{k} bigint" for k in row) + ", override string")
    status = pipeline_status(F.col("override"), F.col("keyword_failed_count"), F.col("keyword_success_count"), F.col("batch_input_count"), F.col("batch_failed_count"))
    return df.withColumns({"batch_started": F.col("batch_input_count") > 0, "pipeline_status": status}).drop("override")


def without_batch(spark: SparkSession, keywords: dict[str, str], status: str) -> DataFrame:
    """The summary of a run that came to no batch, with the status it ended by."""
    return pipeline_summary(spark, dict.fromkeys(_COUNTED, 0), keywords, override=status)


_COUNTED = ("search_result_count", "accepted_before_global_dedup", "rejected_count", *(f"rejected_{r}" for r in REASONS), "batch_input_count", "success_count", "failed_count", "skipped_count")


def replay(spark: SparkSession, items: DataFrame, keywords: list[str], path: str) -> DataFrame:
    """The summary of a run over a stored manifest's items (platform, post_id, status) instead of a search: they are written to path and counted on the way."""
    c = Counters()
    posts = c.watch(items, batch_input_count=F.count(F.lit(1)), success_count=of_status("success", "partial"), failed_count=of_status("failed"), skipped_count=of_status("skipped"))
    posts.write.parquet(path)
    counts = dict.fromkeys(_COUNTED, 0) | c.get()
    counts["accepted_before_global_dedup"] = counts["batch_input_count"]
    return pipeline_summary(spark, counts, dict.fromkeys(keywords, "manifest"), override="success" if counts["batch_input_count"] else "no_accepted_urls")


def replayed_keywords(keywords: DataFrame) -> DataFrame:
    """A replay's rows by keyword: nothing was searched, so nothing is counted."""
    none = lambda k: F.lit(None).cast("bigint").alias(k)
    return keywords.select("keyword", F.lit("manifest").alias("search_status"), none("search_result_count"), none("accepted_before_global_dedup"), none("rejected_count"))
