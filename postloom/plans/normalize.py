"""Raw records to the 19-field schema, to the strict final schema, and the validators of both, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import times
from postloom.functions.text import MISSING_AUTHOR, STATUSES, let, normalize_error, optional_string, valid_author_name

SCHEMA_VERSION = "1.0"
AUTHOR_TYPES = ("user", "page", "group", "unknown")
COUNTS = ("comment_count", "like_count", "share_count", "reply_count", "repost_count", "view_count")
_AUTHOR = "struct<name:string,handle:string,profile_url:string,type:string>"


def count(c: Column) -> Column:
    return F.when(c >= 0, c.cast("bigint"))


def text_of(v: Column, path: str) -> Column:
    """A text in a VARIANT: anything but a text is null, never cast."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def whole_of(v: Column, path: str) -> Column:
    """A whole number in a VARIANT: truth values, fractions and texts are null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def raw_columns(records: DataFrame, v: str = "v") -> DataFrame:
    """The typed raw columns of dynamic records (VARIANT); unknown keys are never carried on."""
    x = F.col(v)
    author_text = text_of(x, "$.author")
    author = F.struct(F.coalesce(text_of(x, "$.author.name"), author_text).alias("name"), *(
        text_of(x, f"$.author.{k}").alias(k) for k in ("handle", "profile_url", "type")))
    error = F.struct(text_of(x, "$.error.type").alias("type"), F.coalesce(text_of(x, "$.error.message"), text_of(x, "$.error")).alias("message"))
    items = F.coalesce(F.try_variant_get(x, "$.comments", "array<variant>"), F.array().cast("array<variant>"))
    comments = F.transform(items, lambda i: F.struct(*(text_of(i, f"$.{k}").alias(k) for k in ("comment_content", "comment_time", "comment_author"))))
    return records.select(
        *(c for c in records.columns if c != v),
        *(text_of(x, f"$.{k}").alias(k) for k in ("schema_version", "platform", "post_id", "input_url", "canonical_url", "content", "publish_time",
                                                   "publish_time_text", "collected_at", "collection_status")),
        author.alias("author"), error.alias("error"), comments.alias("comments"),
        F.struct(*(text_of(x, f"$.source.{k}").alias(k) for k in ("type", "name", "profile_url"))).alias("source"),
        *(whole_of(x, f"$.{k}").alias(k) for k in COUNTS))


def normalize_author(platform: Column, author: Column, source: Column) -> Column:
    """The author with handle, profile URL and type put right; a wrong name goes, and a group may stand in for it."""
    parts = F.struct(
        *(optional_string(author[k]).alias(k) for k in ("name", "handle", "profile_url")), valid_author_name(author["name"]).alias("valid"),
        optional_string(source["name"]).alias("group"), valid_author_name(source["name"]).alias("group_valid"))
    return let(parts, lambda p: let(_own_author(platform, author, p), lambda own: _or_group(platform, own, source, p)))


def _own_author(platform: Column, author: Column, p: Column) -> Column:
    is_x, is_fb = platform == "x", platform == "facebook"
    at = F.when(p["handle"].startswith("@"), p["handle"]).otherwise(F.concat(F.lit("@"), p["handle"]))
    derived = F.when(is_x & at.rlike("^@[A-Za-z0-9_]{1,15}$"), F.concat(F.lit("https://x.com/"), F.substring(at, 2, 1 << 30)))
    wrong = p["name"].isNotNull() & ~p["valid"]
    kind = (F.when(wrong & is_fb, "unknown").when(is_x & p["handle"].isNotNull(), "user").when(author["type"].isin(*AUTHOR_TYPES), author["type"])
            .when(is_x, "user").otherwise("unknown"))
    return F.struct(
        F.when(~wrong, p["name"]).alias("name"), F.when(is_x, at).otherwise(p["handle"]).alias("handle"),
        F.when(~(wrong & is_fb), F.coalesce(p["profile_url"], derived)).alias("profile_url"), kind.alias("type")).cast(_AUTHOR)


def _or_group(platform: Column, own: Column, source: Column, p: Column) -> Column:
    stand_in = ((platform == "facebook") & own["name"].isNull() & own["profile_url"].isNull() & (source["type"] == "group")
                & p["group"].isNotNull() & p["group_valid"])
    group = F.struct(p["group"].alias("name"), F.lit(None).cast("string").alias("handle"), optional_string(source["profile_url"]).alias("profile_url"),
                     F.lit("group").alias("type")).cast(_AUTHOR)
    return F.when(F.coalesce(stand_in, F.lit(False)), group).otherwise(own)


def normalize_posts(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 19 fields in order, for records of a supported platform; others are left out. Columns of keep stand in front."""
    d = raw.withColumn("platform", optional_string(F.col("platform"))).where("platform in ('x', 'facebook')")
    d = d.withColumns({k: optional_string(F.col(k)) for k in ("post_id", "input_url", "canonical_url", "content", "publish_time", "collected_at")})
    d = d.withColumn("author", normalize_author(F.col("platform"), F.col("author"), F.col("source")))
    is_x, status = F.col("platform") == "x", optional_string(F.col("collection_status"))
    has_author = F.col("author.name").isNotNull() | F.col("author.profile_url").isNotNull()
    has_identity, has_content = F.col("post_id").isNotNull() | F.col("canonical_url").isNotNull(), F.col("content").isNotNull()
    group_ok = ~is_x & (status == "partial") & (F.col("author.type") == "group") & F.col("author.name").isNotNull() & has_identity & has_content
    d = d.withColumn("_status", F.when(group_ok, "success").when((status == "success") & ~(has_author & has_content & has_identity), "partial").otherwise(status))
    error = normalize_error(F.col("error.type"), F.col("error.message"))
    d = d.withColumn("_error", error)
    error = F.when((F.col("_status") == "success") & (F.col("_error") == MISSING_AUTHOR), None).when(
        (F.col("_status") == "partial") & ~has_author & F.col("_error").isNull(), MISSING_AUTHOR).otherwise(F.col("_error"))
    comment_count = F.when(is_x, F.coalesce(count(F.col("reply_count")), count(F.col("comment_count")))).otherwise(count(F.col("comment_count")))
    fields = ("comment_content", "comment_time", "comment_author")
    comments = F.filter(F.transform(F.coalesce("comments", F.array().cast("array<struct<comment_content:string,comment_time:string,comment_author:string>>")),
                                    lambda c: F.struct(*(optional_string(c[k]).alias(k) for k in fields))),
                        lambda c: c[fields[0]].isNotNull() | c[fields[1]].isNotNull() | c[fields[2]].isNotNull())
    group = F.when(~is_x & (F.col("source.type") == "group"), F.struct(
        optional_string(F.col("source.name")).alias("name"), optional_string(F.col("source.profile_url")).alias("url")))
    group = F.when(group["name"].isNotNull() | group["url"].isNotNull(), group)
    return d.select(
        *(keep or []), F.lit(SCHEMA_VERSION).alias("schema_version"), "platform", "post_id", "input_url", "canonical_url", "author", "content", "publish_time",
        comment_count.alias("comment_count"), count(F.col("like_count")).alias("like_count"), count(F.col("share_count")).alias("share_count"),
        F.when(is_x, count(F.col("repost_count"))).alias("repost_count"), F.when(is_x, count(F.col("view_count"))).alias("view_count"),
        comments.alias("comments"), "collected_at", F.col("_status").alias("collection_status"), error.alias("error"),
        F.when(is_x, F.struct(F.coalesce(count(F.col("reply_count")), comment_count).alias("reply_count"))).alias("platform_metrics"),
        F.when(group.isNotNull(), F.struct(group.alias("facebook_group"))).alias("platform_context"))


def final_comments(comments: Column, as_of: Column) -> Column:
    """Comments with content, times normalised, each exact triple once, in order."""
    plain = lambda c: F.coalesce(optional_string(c), F.lit(""))
    made = F.transform(comments, lambda c: F.struct(
        plain(c["comment_content"]).alias("comment_content"), times.normalize_time(c["comment_time"], as_of).alias("comment_time"),
        plain(c["comment_author"]).alias("comment_author")))
    return F.array_distinct(F.filter(made, lambda c: c["comment_content"] != ""))


def final_posts(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The strict seven fields in order; texts are never null. Columns of keep stand in front."""
    plain = lambda c: F.coalesce(optional_string(c), F.lit(""))
    as_of = times.parse_iso(F.col("collected_at"))
    published = F.coalesce(F.nullif("publish_time", F.lit("")), F.col("publish_time_text"))
    return raw.select(
        *(keep or []), plain(F.col("author.name")).alias("author"), plain(F.col("content")).alias("content"),
        times.normalize_time(published, as_of).alias("publish_time"), *(count(F.col(k)).alias(k) for k in ("like_count", "share_count", "comment_count")),
        final_comments(F.coalesce("comments", F.array().cast("array<struct<comment_content:string,comment_time:string,comment_author:string>>")), as_of).alias("comments"))


def internal_error(platform: Column, status: Column, counts: dict[str, Column], has_error: Column) -> Column:
    """The first rule an internal result breaks, else null; messages are fixed values of the format."""
    out = F.when(~platform.eqNullSafe(F.lit("facebook")), "Internal result platform must be facebook.").when(
        ~F.coalesce(status.isin(*STATUSES), F.lit(False)), "Internal result collection_status is invalid.")
    for name, c in counts.items():
        out = out.when(c < 0, f"Internal result {name} must be a non-negative integer or null.")
    return out.when((status == "failed") & ~has_error, "Failed internal result must include error or failure_category.")


def import_error(platform: Column, post_id: Column) -> Column:
    return F.when(~F.coalesce(platform.isin("x", "facebook"), F.lit(False)), "A normalized post requires platform 'x' or 'facebook'.").when(
        optional_string(post_id).isNull(), "A normalized post requires post_id.")


def author_key(author: Column) -> Column:
    """What an author is matched by: profile URL, else handle, else name and type; null without any of them."""
    part = lambda k: optional_string(author[k])
    return F.coalesce(F.concat(F.lit("url:"), part("profile_url")), F.concat(F.lit("handle:"), part("handle")),
                      F.concat(F.lit("name:"), part("name"), F.lit("|"), F.coalesce(part("type"), F.lit("unknown"))))


def manifest_error(platform: Column, contexts_ok: Column, canonical_platform: Column) -> Column:
    return F.when(~platform.eqNullSafe(F.lit("facebook")), "not a Facebook item").when(~contexts_ok, "search_contexts must be an array").when(
        ~canonical_platform.eqNullSafe(F.lit("facebook")), "canonical_url is unsupported")


def final_error(texts: dict[str, Column], counts: dict[str, Column], comments: Column) -> Column:
    """The first rule that a final record breaks, else null; messages are fixed values of the format."""
    out = F.when(comments.isNull(), "Final result comments must be a list.")
    for name, c in texts.items():
        out = out.when(c.isNull(), f"Final result {name} must be a string.")
    for name, c in counts.items():
        out = out.when(c < 0, f"Final result {name} must be a non-negative integer or null.")
    for name in ("comment_content", "comment_time", "comment_author"):
        lacking = F.exists(F.transform(comments, lambda c: c.getField(name).isNull()), lambda x: x)  # noqa: B023  read at once
        out = out.when(lacking, f"Final comment {name} must be a string.")
    return out
