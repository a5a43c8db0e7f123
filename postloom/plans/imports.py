"""Import of collected records into runs, authors, posts and links: one change of four tables, or none.

Records are JSON lines; those without a schema_version are normalised first. A record that can't be read or lacks its identity is counted and
left out; anything else that fails leaves the tables as they were. What each record would have done to the tables one after another is
counted as sets: of a key's records the first inserts it unless it is there, the others update it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import optional_string
from postloom.functions.times import store_datetime
from postloom.operators.relational import with_ids
from postloom.plans import normalize as nz
from postloom.sources.folders import stored
from postloom.sources.versions import VersionedTables

RUNS = "id bigint, started_at timestamp, finished_at timestamp, keywords_json string, platform_order_json string, global_limit int, output_path string, summary_json string"
AUTHORS = "id bigint, platform string, author_key string, name string, handle string, profile_url string, type string"
POSTS = (
    "id bigint, platform string, post_id string, author_id bigint, collection_run_id bigint, input_url string, canonical_url string, content string, publish_time timestamp,"
    " comment_count bigint, like_count bigint, share_count bigint, repost_count bigint, view_count bigint, collection_status string, error string, collected_at timestamp"
)
LINKS = "post_id bigint, keyword string"
_OF_POST = ("input_url", "canonical_url", "content", "comment_count", "like_count", "share_count", "repost_count", "view_count", "collection_status", "error")


@dataclass(frozen=True)
class Run:
    """What is known of a collection run."""

    started_at: str | None = None
    finished_at: str | None = None
    keywords: tuple[str, ...] = ()
    platform_order: tuple[str, ...] = ()
    global_limit: int | None = None
    output_path: str | None = None
    summary: dict | None = None


def records_of(parsed: DataFrame) -> DataFrame:
    """(pos, failed, platform, post_id, author, fields of a post) of parsed lines (pos, v, reject_reason)."""
    raw = nz.raw_columns(parsed.drop("reject_reason").where(parsed["reject_reason"].isNull()))
    fields = ["pos", "platform", "post_id", "author", "publish_time", "collected_at", *_OF_POST]
    # a record of neither platform isn't normalised: it fails
    known = F.coalesce(optional_string(F.col("platform")).isin("x", "facebook"), F.lit(False))
    made = nz.normalize_posts(raw.where(F.col("schema_version").isNull() & known), ["pos"])
    plain = raw.where(F.col("schema_version").isNotNull() | ~known).withColumn("error", F.col("error.message"))
    good = made.select(fields).unionByName(plain.select(fields))
    failed = nz.import_error(F.col("platform"), F.col("post_id")).isNotNull()
    broken = parsed.where("reject_reason is not null").select("pos", F.lit(True).alias("failed"))
    return good.withColumn("failed", failed).unionByName(broken, allowMissingColumns=True)


def import_lines(spark: SparkSession, tables: VersionedTables, parsed: DataFrame, run: Run) -> dict[str, int]:
    """Bring parsed lines (pos, v, reject_reason; pos gives their order) into tables; gives the run's id and what was done."""
    change = tables.begin()
    records = stored(records_of(parsed), "import")
    good = records.where("not failed")
    read, failed = records.agg(F.count("*"), F.count_if("failed")).first()

    runs = change.read("collection_runs", RUNS)
    run_id = runs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    text = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":")) if x else None
    row = spark.createDataFrame(
        [(run_id, run.started_at, run.finished_at, text(run.keywords), text(run.platform_order), run.global_limit, run.output_path, text(run.summary))],
        "id bigint, s string, f string, keywords_json string, platform_order_json string, global_limit int, output_path string, summary_json string")
    row = row.withColumns({"started_at": store_datetime(F.col("s")), "finished_at": store_datetime(F.col("f"))})
    change.merge("collection_runs", RUNS, ["id"], row, lambda old, new: old.unionByName(new.select(old.columns)), buckets=1)

    # authors: the last record of a key gives its values, the first its turn among new ids
    keyed = good.withColumn("author_key", nz.author_key(F.col("author"))).where("author_key is not null")
    latest = keyed.groupBy("platform", "author_key").agg(F.count("*").alias("records"), F.min("pos").alias("first"), F.max_by("author", "pos").alias("a"))
    authors = change.read("authors", AUTHORS)
    latest = stored(latest.join(authors.select("platform", "author_key", F.col("id").alias("old_id")), ["platform", "author_key"], "left"), "authors")
    fresh = with_ids(latest.where("old_id is null"), "first", "id", authors)
    ids = stored(fresh.unionByName(latest.where("old_id is not null").withColumn("id", F.col("old_id"))).select(
        "id", "platform", "author_key", "a.name", "a.handle", "a.profile_url", F.coalesce("a.type", F.lit("unknown")).alias("type"), "records", "old_id"), "authors")
    replace = lambda keys: lambda old, new: old.join(new.select(keys), keys, "left_anti").unionByName(new.select(old.columns))
    change.merge("authors", AUTHORS, ["platform", "author_key"], ids, replace(["platform", "author_key"]))

    # posts: the last record of an identity, with its author of this or an earlier run
    post = F.struct("publish_time", "collected_at", *_OF_POST, nz.author_key(F.col("author")).alias("author_key"))
    last = good.groupBy("platform", "post_id").agg(F.count("*").alias("records"), F.min("pos").alias("first"), F.max_by(post, "pos").alias("p"))
    posts = change.read("posts", POSTS)
    last = stored(last.join(posts.select("platform", "post_id", F.col("id").alias("old_id")), ["platform", "post_id"], "left"), "posts")
    new = with_ids(last.where("old_id is null"), "first", "id", posts).unionByName(last.where("old_id is not null").withColumn("id", F.col("old_id")))
    new = new.select("id", "platform", "post_id", "records", "old_id", "p.*").join(ids.select("platform", "author_key", F.col("id").alias("author_id")), ["platform", "author_key"], "left")
    new = stored(new.withColumns({"collection_run_id": F.lit(run_id), "publish_time": store_datetime(F.col("publish_time")), "collected_at": store_datetime(F.col("collected_at"))}), "posts")
    change.merge("posts", POSTS, ["platform", "post_id"], new, replace(["platform", "post_id"]))

    # links: every post of the run with every keyword of the run, unless it is there
    words = sorted({w.strip() for w in run.keywords if w.strip()})
    each = sum(1 for w in run.keywords if w.strip())
    pairs = new.select(F.col("id").alias("post_id"), "records", F.explode(F.array(*map(F.lit, words)).cast("array<string>")).alias("keyword"))
    links = change.read("post_keywords", LINKS)
    missing = stored(pairs.join(links, ["post_id", "keyword"], "left_anti").select("post_id", "keyword"), "links")
    change.merge("post_keywords", LINKS, ["post_id", "keyword"], missing, lambda old, rows: old.unionByName(rows))

    a = ids.agg(F.coalesce(F.sum("records"), F.lit(0)), F.count_if(F.col("old_id").isNull())).first()
    p = new.agg(F.coalesce(F.sum("records"), F.lit(0)), F.count_if(F.col("old_id").isNull())).first()
    linked = missing.count()
    change.commit()
    return {"run_id": run_id, "records_read": read, "imported_count": read - failed, "failed_count": failed, "posts_inserted": p[1], "posts_updated": p[0] - p[1],
            "authors_inserted": a[1], "authors_updated": a[0] - a[1], "keyword_links_inserted": linked, "keyword_links_ignored": p[0] * each - linked}
