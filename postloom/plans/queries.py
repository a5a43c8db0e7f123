"""The query catalogue: each operator over the derived views, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import numbers as num
from postloom.functions import text as txt
from postloom.functions import times, url
from postloom.operators import relational as rel
from postloom.plans import summaries, views
from postloom.sources.folders import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = views.AS_OF


def query(sql: str | None = None):
    """Register a query under its name; sql may start after WITH's view c (classified) if it names it."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {views.CLASSIFIED_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url.classify(views.search(spark, sf_dir))


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


@query("SELECT pos, platform, post_id, canonical_url, context_type FROM c WHERE platform IS NOT NULL")
def classify_urls(spark, d):
    return classified(spark, d).where("platform is not null").select("pos", "platform", "post_id", "canonical_url", "context_type")


@query("SELECT * FROM (SELECT platform, post_id, canonical_url, pos FROM c WHERE platform IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY platform, post_id ORDER BY pos) = 1")
def dedupe_posts_first(spark, d):
    return rel.dedupe_first(classified(spark, d).where("platform is not null").select("platform", "post_id", "canonical_url", "pos"), ["platform", "post_id"], "pos")


_REASON = """, f AS (SELECT *, min(pos) OVER (PARTITION BY keyword, platform, post_id) AS fp FROM c),
r AS (SELECT *, CASE WHEN url IS NULL OR trim(url) = '' THEN 'missing_url' WHEN platform IS NULL THEN 'unsupported_url'
  WHEN platform <> 'facebook' THEN 'non_facebook_post' WHEN pos > fp THEN 'duplicate_facebook_post' END AS reason FROM f) """


def _reasons(spark, d):
    c = rel.with_first_position(classified(spark, d), ["keyword", "platform", "post_id"], "pos")
    return c.withColumn("reason", rel.reject_reason(F.col("first_pos"), F.col("pos"), F.col("url"), F.col("platform")))


@query(_REASON + "SELECT keyword, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1, 2")
def reject_reasons(spark, d):
    return _reasons(spark, d).groupBy("keyword", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(_REASON + "SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def reject_reasons_total(spark, d):
    each = _reasons(spark, d).where("reason is not null").groupBy("keyword", "reason").agg(F.count("*").alias("n"))
    return each.groupBy("reason").agg(F.sum("n").alias("n"))


@query(_REASON + """, a AS (SELECT keyword, count(*) FILTER (reason = 'duplicate_facebook_post') AS within_n, count(DISTINCT post_id) FILTER (platform = 'facebook') AS accepted FROM r GROUP BY 1)
SELECT CAST(sum(within_n) AS BIGINT) AS within_keyword, CAST(greatest(0, sum(accepted) - (SELECT count(DISTINCT post_id) FROM c WHERE platform = 'facebook')) AS BIGINT) AS across_keywords,
CAST(sum(within_n) + greatest(0, sum(accepted) - (SELECT count(DISTINCT post_id) FROM c WHERE platform = 'facebook')) AS BIGINT) AS duplicate_count FROM a""")
def duplicate_count(spark, d):
    r = _reasons(spark, d)
    each = r.where("platform = 'facebook'").groupBy("keyword", "post_id").agg(F.sum((F.col("reason") == "duplicate_facebook_post").cast("long")).alias("dup"))
    total = each.groupBy("post_id").agg(F.sum("dup").alias("dup"), F.count("*").alias("kws")).agg(
        F.coalesce(F.sum("dup"), F.lit(0)).alias("within_keyword"), F.coalesce(F.sum(F.col("kws") - 1), F.lit(0)).alias("across_keywords"))
    return total.withColumn("duplicate_count", F.col("within_keyword") + F.col("across_keywords"))


@query("SELECT keyword, pos, row_number() OVER (PARTITION BY keyword ORDER BY pos) AS rank FROM c")
def rank_per_keyword(spark, d):
    return rel.rank_per_key(views.search(spark, d).select("keyword", "pos"), ["keyword"], "pos").withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT keyword, pos, row_number() OVER (ORDER BY keyword, pos) AS rank FROM c")
def global_rank(spark, d):
    return rel.with_global_rank(views.search(spark, d).select("keyword", "pos"), ["keyword", "pos"]).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT keyword, pos, (row_number() OVER (PARTITION BY keyword ORDER BY pos) - 1) // 10 + 1 AS page FROM c")
def page_of_rank(spark, d):
    return rank_per_keyword(spark, d).select("keyword", "pos", rel.page_of_rank(F.col("rank")).alias("page"))


_RANKED = ", k2 AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY pos) AS rank FROM c), p AS (SELECT * FROM k2 WHERE platform = 'facebook' QUALIFY row_number() OVER (PARTITION BY keyword, post_id ORDER BY pos) = 1) "
_CONTEXT_SQL = "string_agg(keyword || '/' || rank || '/' || url, ' ' ORDER BY pos) AS contexts, count(*) AS n_contexts"


def _posts_by_keyword(spark, d):
    c = rel.rank_per_key(classified(spark, d), ["keyword"], "pos").where("platform = 'facebook'")
    return rel.dedupe_first(c.select("keyword", "platform", "post_id", "pos", "rank", "url", "canonical_url"), ["keyword", "platform", "post_id"], "pos")


def _flat(merged: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("search_contexts", lambda c: F.concat_ws("/", c["keyword"], c["rank"], c["url"])), " ")
    return merged.select("platform", "post_id", "canonical_url", "search_keyword", F.col("search_rank").cast("bigint").alias("search_rank"),
                         "search_result_url", text.alias("contexts"), F.size("search_contexts").cast("bigint").alias("n_contexts"))


@query(_RANKED + f"SELECT platform, post_id, arg_min(canonical_url, pos) AS canonical_url, arg_min(keyword, pos) AS search_keyword, arg_min(rank, pos) AS search_rank, arg_min(url, pos) AS search_result_url, {_CONTEXT_SQL} FROM p GROUP BY 1, 2")
def merge_search_contexts(spark, d):
    return _flat(rel.merge_contexts(_posts_by_keyword(spark, d), True))


@query(_RANKED + f"SELECT platform, post_id, arg_min(canonical_url, pos) AS canonical_url, arg_min(keyword, pos) AS search_keyword, {_CONTEXT_SQL} FROM p GROUP BY 1, 2")
def merge_contexts_job(spark, d):
    return _flat(rel.merge_contexts(_posts_by_keyword(spark, d), False)).drop("search_rank", "search_result_url")


@query("""SELECT pos, regexp_replace(regexp_extract(trim(url), '^([^?#]*)', 1), '/+$', '') ||
  CASE WHEN len(kv) = 0 THEN '' ELSE '?' || replace(array_to_string(kv, '&'), 'amp;', 'amp%3B') END AS cleaned FROM (SELECT pos, url,
  list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.') AND NOT regexp_matches(x, '^(comment_id|fbclid|eid|mibextid|rdid|__cft__|__tn__)=')) AS kv
  FROM c WHERE url IS NOT NULL) t""")
def clean_tracking_url(spark, d):
    v = views.search(spark, d).where("url is not null")
    return v.select("pos", url.clean_tracking(F.col("url")).alias("cleaned"))


@query("""SELECT pos, CASE WHEN p = '/login' OR p LIKE '/login/%' THEN 'login' WHEN p LIKE '/watch/%' OR (p = '/watch' AND regexp_matches(q, '(^|&)v=.')) THEN 'watch'
  WHEN contains(p, '/videos/') THEN 'video' WHEN p LIKE '/reel/%' OR p LIKE '/reels/%' THEN 'reel' WHEN contains(p, '/groups/') THEN 'group'
  WHEN contains(p, '/posts/') THEN 'standard_post' WHEN regexp_matches(p, '/(story|permalink)\\.php$') THEN 'story_or_permalink' ELSE 'unknown' END AS kind
  FROM (SELECT pos, lower(path) AS p, q FROM h WHERE host <> '') t""")
def destination_type(spark, d):
    v = url.with_url_parts(views.search(spark, d), "url").where("_scheme in ('http', 'https') and _host <> ''")
    return v.select("pos", url.destination_type(F.col("_path"), F.col("_query")).alias("kind"))


@query(""", t AS (SELECT keyword, count(*) % 130 AS target FROM c GROUP BY 1)
SELECT keyword, i AS page_number, (i - 1) * 10 + 1 AS start, least(10, least(target, 100) - (i - 1) * 10) AS num FROM t, unnest(generate_series(1, CAST(ceil(least(target, 100) / 10.0) AS BIGINT))) AS u(i)""")
def page_plan(spark, d):
    targets = views.search(spark, d).groupBy("keyword").agg((F.count("*") % 130).alias("target"))
    return rel.page_plan(targets)


@query(""", s AS (SELECT keyword, pos % 8 + 1 AS page_number, pos // 8 AS batch, CAST(10 AS BIGINT) AS requested, CASE WHEN pos % 11 = 3 THEN pos % 10 ELSE 10 END AS received FROM c),
n AS (SELECT keyword || '-' || batch AS keyword, page_number, requested, received FROM s),
w AS (SELECT *, coalesce(max(CASE WHEN received < requested THEN 1 ELSE 0 END) OVER (PARTITION BY keyword ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM n)
SELECT keyword, page_number, requested, received FROM w WHERE s = 0""")
def stop_paging(spark, d):
    v = views.search(spark, d).selectExpr(
        "concat(keyword, '-', pos div 8) as keyword", "pos % 8 + 1 as page_number", "cast(10 as bigint) as requested",
        "case when pos % 11 = 3 then pos % 10 else 10 end as received")
    return rel.stop_paging(v)


_NUMBER = """CASE WHEN NOT regexp_matches(X, '[0-9]') THEN NULL ELSE CAST(trunc(CAST(replace(regexp_extract(X, '([0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?)(\\s*[KkMmBb万亿億])?', 1), ',', '') AS DOUBLE) *
  CASE lower(trim(regexp_extract(X, '([0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?)(\\s*[KkMmBb万亿億])?', 2))) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN '万' THEN 1e4 WHEN '亿' THEN 1e8 WHEN '億' THEN 1e8 ELSE 1 END) AS BIGINT) END"""


@query(f"SELECT pos, metric, {_NUMBER.replace('X', 'metric')} AS n FROM c")
def parse_metric_count(spark, d):
    return views.search(spark, d).select("pos", "metric", num.parse_metric_count(F.col("metric")).alias("n"))


@query("""SELECT pos, try_cast(nullif(regexp_extract(metric, '([0-9,]+) comments', 1), '') AS BIGINT) AS comments, try_cast(nullif(replace(regexp_extract(metric, '([0-9,]+) likes', 1), ',', ''), '') AS BIGINT) AS likes,
  CASE WHEN regexp_matches(metric, '[0-9]+ comments') THEN CAST(regexp_extract(metric, '([0-9]+) shares', 1) AS BIGINT) END AS shares FROM c""")
def semantic_metric(spark, d):
    m = F.col("metric")
    return views.search(spark, d).select("pos", *(num.semantic_metric(m, k).alias(f"{k}s") for k in ("comment", "like", "share")))


@query("SELECT pos, CAST(regexp_extract(metric, '([0-9]+) of ([0-9]+)', 1) AS BIGINT) AS current, CAST(regexp_extract(metric, '([0-9]+) of ([0-9]+)', 2) AS BIGINT) AS total FROM c WHERE regexp_matches(metric, '[0-9]+ of [0-9]+')")
def comment_progress(spark, d):
    return views.search(spark, d).select("pos", num.comment_progress(F.col("metric")).alias("p")).where("p is not null").select("pos", "p.*")


_TIME = f"""CASE WHEN time_text IS NULL OR trim(time_text) = '' THEN '' WHEN regexp_full_match(time_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN time_text
  WHEN time_text = '2024-02-03T04:05:06Z' THEN time_text WHEN time_text LIKE '%+02:00' THEN strftime(CAST('2024-02-03 04:05:06' AS TIMESTAMP) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ')
  WHEN time_text = 'just now' THEN '{AS_OF}' WHEN regexp_full_match(time_text, '[0-9]*h') THEN strftime(CAST('2024-03-10 12:30:45' AS TIMESTAMP) - to_hours(CAST(regexp_extract(time_text, '[0-9]+') AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ')
  WHEN regexp_full_match(time_text, '[0-9]* ?(days|w|y)') THEN strftime(CAST('2024-03-10 12:30:45' AS TIMESTAMP) - to_days(CAST(CASE WHEN regexp_matches(time_text, '[0-9]') THEN CAST(regexp_extract(time_text, '[0-9]+') AS INT) ELSE 1 END *
    CASE WHEN time_text LIKE '%w' THEN 7 WHEN time_text LIKE '%y' THEN 365 ELSE 1 END AS INT)), '%Y-%m-%d') ELSE '' END"""


@query(f"SELECT pos, time_text, {_TIME} AS normalized FROM c")
def normalize_time(spark, d):
    return views.search(spark, d).select("pos", "time_text", times.normalize_time(F.col("time_text"), _as_of()).alias("normalized"))


@query("""SELECT pos, CASE WHEN time_text = '2025-99-99' THEN NULL WHEN regexp_matches(time_text, '^[0-9-]{10}T') THEN NULL END AS iso,
  CASE WHEN time_text IN ('2h', 'yesterday') OR regexp_full_match(time_text, '[0-9]+ days') THEN time_text END AS kept FROM c""")
def parse_publish_time(spark, d):
    p = times.parse_publish_time(F.col("time_text"))
    return views.search(spark, d).select("pos", p.alias("p")).select("pos", "p.iso", "p.kept")


_VALID = "coalesce(author IN ('Anna Bell', 'Maya'), false)"


@query(f"SELECT pos, author, {_VALID} AS valid FROM c")
def valid_author_name(spark, d):
    return views.search(spark, d).select("pos", "author", txt.valid_author_name(F.col("author")).alias("valid"))


_FAILURE = """CASE WHEN contains(t, 'unavailable') THEN 'unavailable' WHEN contains(t, 'login') THEN 'login_required' WHEN contains(t, 'too many') THEN 'rate_limited'
  WHEN contains(t, 'timeout') THEN 'navigation_timeout' WHEN contains(t, 'net::') THEN 'network_error' WHEN contains(t, 'unsupported') THEN 'invalid_url'
  WHEN contains(t, 'validation') THEN 'validation_error' WHEN contains(t, 'container') THEN 'extraction_error' ELSE 'unknown_error' END"""
_FAILED = f", x AS (SELECT pos, canonical_url, lower(coalesce(error_type, '') || ': ' || coalesce(error_message, '')) AS t FROM c WHERE status = 'failed'), y AS (SELECT *, {_FAILURE} AS category FROM x) "


def _failures(spark, d):
    f = classified(spark, d).where("status = 'failed'")
    text = txt.failure_text(F.col("error_type"), F.col("error_message"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return f.withColumn("k", txt.categorize_failure(text)).select("pos", "canonical_url", "k.*")


@query(_FAILED + "SELECT pos, category, category IN ('rate_limited', 'navigation_timeout', 'network_error', 'extraction_error') AS retryable FROM y")
def categorize_failure(spark, d):
    return _failures(spark, d).drop("canonical_url")


@query(_FAILED + "SELECT category, count(*) AS n FROM y GROUP BY 1")
def failure_category_counts(spark, d):
    return _failures(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query(_FAILED + "SELECT pos, canonical_url, category FROM y WHERE category IN ('rate_limited', 'navigation_timeout', 'network_error', 'extraction_error') AND canonical_url IS NOT NULL")
def retryable_items(spark, d):
    return _failures(spark, d).where("retryable and canonical_url is not null").drop("retryable")


@query("SELECT status, count(*) AS n FROM c GROUP BY 1")
def status_counts(spark, d):
    return views.search(spark, d).groupBy(F.coalesce("status", F.lit("None")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT platform, status, count(*) AS n FROM c WHERE platform IS NOT NULL GROUP BY 1, 2")
def platform_status_count(spark, d):
    return classified(spark, d).where("platform is not null").groupBy("platform", "status").agg(F.count("*").alias("n"))


@query("SELECT platform, count(*) AS n FROM c WHERE platform IS NOT NULL GROUP BY 1")
def platform_count(spark, d):
    return classified(spark, d).where("platform is not null").groupBy("platform").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM c WHERE platform IS NOT NULL")
def total_posts(spark, d):
    return classified(spark, d).where("platform is not null").agg(F.count("*").alias("n"))


@query("SELECT pos, platform, left(snippet, 80) AS preview FROM c WHERE platform IS NOT NULL ORDER BY pos DESC LIMIT 10")
def recent_posts(spark, d):
    return classified(spark, d).where("platform is not null").orderBy(F.desc("pos")).limit(10).select("pos", "platform", F.left("snippet", F.lit(80)).alias("preview"))


@query("SELECT keyword, CAST(count(*) FILTER (status IN ('success', 'partial')) AS BIGINT) AS success_count, count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status = 'skipped') AS skipped_count, count(*) AS record_count, CAST(sum(CASE WHEN like_count >= 0 THEN like_count END) AS BIGINT) AS likes FROM c GROUP BY 1")
def batch_summary(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    s = F.col("status")
    return views.search(spark, d).groupBy("keyword").agg(
        n(s.isin("success", "partial")).alias("success_count"), n(s == "failed").alias("failed_count"), n(s == "skipped").alias("skipped_count"),
        F.count("*").alias("record_count"), F.sum(F.when(F.col("like_count") >= 0, F.col("like_count"))).alias("likes"))


@query("""SELECT keyword, k, search_n, accepted_n, failed_n, CASE WHEN k = 3 THEN 'stopped' WHEN bad > 0 AND good > 0 THEN 'partial_search_failure' WHEN accepted_n = 0 THEN 'no_accepted_urls'
  WHEN failed_n > 0 THEN 'batch_completed_with_failures' ELSE 'success' END AS pipeline_status
  FROM (SELECT keyword, user_id % 5 AS k, count(*) AS search_n, count(DISTINCT post_id) FILTER (platform = 'facebook') AS accepted_n, count(*) FILTER (platform = 'facebook' AND status = 'failed' AND user_id % 5 > 1) AS failed_n,
    count(*) FILTER (url IS NULL AND user_id % 5 = 2) AS bad, count(*) FILTER (url IS NOT NULL) AS good FROM c GROUP BY 1, 2)""")
def pipeline_status(spark, d):
    """How runs ended: a run is a keyword and a fifth of the users; one fifth is overridden."""
    fb, k = F.col("platform") == "facebook", F.col("user_id") % 5
    n = lambda c: F.count(F.when(c, 1))
    a = classified(spark, d).groupBy("keyword", k.alias("k")).agg(
        F.count("*").alias("search_n"), F.count_distinct(F.when(fb, F.col("post_id"))).alias("accepted_n"), n(fb & (F.col("status") == "failed") & (k > 1)).alias("failed_n"),
        n(F.col("url").isNull() & (k == 2)).alias("bad"), n(F.col("url").isNotNull()).alias("good"))
    override = F.when(F.col("k") == 3, "stopped")
    return a.withColumn("pipeline_status", summaries.pipeline_status(override, F.col("bad"), F.col("good"), F.col("accepted_n"), F.col("failed_n"))).drop("bad", "good")


@query(_REASON + """, acc AS (SELECT * FROM r WHERE reason IS NULL), uq AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY platform, post_id ORDER BY pos) = 1),
kw AS (SELECT keyword, keyword = 'error' AS bad FROM c GROUP BY 1),
nn AS (SELECT (SELECT count(*) FROM kw) AS keyword_count, (SELECT count(*) FROM kw WHERE NOT bad) AS keyword_success_count, (SELECT count(*) FROM kw WHERE bad) AS keyword_failed_count,
  (SELECT count(*) FROM r) AS search_result_count, (SELECT count(*) FROM acc) AS accepted_before_global_dedup, (SELECT count(reason) FROM r) AS rejected_count,
  (SELECT count(*) FROM r WHERE reason = 'missing_url') AS rejected_missing_url, (SELECT count(*) FROM r WHERE reason = 'unsupported_url') AS rejected_unsupported_url,
  (SELECT count(*) FROM r WHERE reason = 'non_facebook_post') AS rejected_non_facebook_post, (SELECT count(*) FROM r WHERE reason = 'duplicate_facebook_post') AS rejected_duplicate_facebook_post,
  (SELECT count(*) FROM uq) AS batch_input_count, (SELECT count(*) FROM uq WHERE status IN ('success', 'partial')) AS s, (SELECT count(*) FROM uq WHERE status = 'failed') AS f, (SELECT count(*) FROM uq WHERE status = 'skipped') AS k)
SELECT keyword_count, keyword_success_count, keyword_failed_count, search_result_count, accepted_before_global_dedup, rejected_count, rejected_missing_url, rejected_unsupported_url, rejected_non_facebook_post,
  rejected_duplicate_facebook_post, batch_input_count, batch_input_count AS accepted_count, rejected_duplicate_facebook_post + accepted_before_global_dedup - batch_input_count AS duplicate_count,
  rejected_duplicate_facebook_post + accepted_before_global_dedup - batch_input_count AS deduplicated_count, s AS batch_success_count, f AS batch_failed_count, k AS batch_skipped_count,
  CAST(0 AS BIGINT) AS batch_partial_count, s + f + k AS batch_record_count, s + 5 AS total_success_count, f + 2 AS total_failed_count, k AS total_skipped_count, s + f + k + 7 AS total_record_count,
  batch_input_count > 0 AS batch_started, CASE WHEN keyword_failed_count > 0 THEN 'partial_search_failure' ELSE 'success' END AS pipeline_status FROM nn""")
def pipeline_summary(spark, d):
    """A run's summary from the counters of the job that writes its posts."""
    c = classified(spark, d)
    counts = summaries.write_accepted(c.select("keyword", "pos", "url", "platform", "post_id", "status"), new_folder(spark, "accepted"))
    keywords = {r.keyword: "failed" if r.keyword == "error" else "success" for r in c.select("keyword").distinct().collect()}  # a run's few keywords
    return summaries.pipeline_summary(spark, counts, keywords, {"success_count": 5, "failed_count": 2})


_SPLIT = ", o AS (SELECT * FROM c WHERE half = 'old' AND platform IS NOT NULL), n AS (SELECT * FROM c WHERE half = 'new' AND platform IS NOT NULL) "


def _halves(spark, d):
    c = classified(spark, d).where("platform is not null")
    return c.where("half = 'old'"), c.where("half = 'new'")


@query(_SPLIT + "SELECT pos, platform, post_id FROM n WHERE post_id NOT IN (SELECT post_id FROM o) AND url NOT IN (SELECT url FROM o) AND canonical_url NOT IN (SELECT canonical_url FROM o)")
def resume_anti_join_x(spark, d):
    old, new = _halves(spark, d)
    return rel.anti_processed(new, old, {k: k for k in ("url", "canonical_url", "post_id")}).select("pos", "platform", "post_id")


@query(_SPLIT + "SELECT pos, canonical_url FROM n WHERE canonical_url NOT IN (SELECT canonical_url FROM o)")
def resume_anti_join_fb(spark, d):
    old, new = _halves(spark, d)
    return rel.anti_processed(new, old, {"canonical_url": "canonical_url"}).select("pos", "canonical_url")


_HISTORY = _SPLIT + ", hs AS (SELECT platform, post_id, arg_max(canonical_url, pos) AS canonical_url, arg_max(status, pos) AS status FROM o GROUP BY 1, 2) "


def _history(spark, d):
    old, new = _halves(spark, d)
    return old.groupBy("platform", "post_id").agg(F.max_by("canonical_url", "pos").alias("canonical_url"), F.max_by("status", "pos").alias("status")), new


@query(_HISTORY + "SELECT n.pos, n.platform, n.post_id, CASE WHEN hs.status = 'success' THEN 'history_success' WHEN hs.status = 'failed' THEN 'history_failed_not_retryable' END AS reason FROM n LEFT JOIN hs USING (platform, post_id)")
def history_decision(spark, d):
    h, new = _history(spark, d)
    return rel.history_decision(new, h).select("pos", "platform", "post_id", "reason")


@query(_HISTORY + """, l AS (SELECT platform, post_id, arg_max(canonical_url, pos) AS u, arg_max(status, pos) AS s FROM n GROUP BY 1, 2)
SELECT platform, post_id, coalesce(u, canonical_url) AS canonical_url, CASE WHEN hs.status IS NULL THEN 'run2' ELSE 'run1' END AS first_run, CASE WHEN s IS NULL THEN 'run1' ELSE 'run2' END AS last_run, coalesce(s, status) AS status FROM hs FULL JOIN l USING (platform, post_id)""")
def history_upsert(spark, d):
    h, new = _history(spark, d)
    h = h.withColumns({"first_run": F.lit("run1"), "last_run": F.lit("run1")})
    return rel.history_upsert(h, new.select("platform", "post_id", "canonical_url", "status", "pos"), "run2")


_UPSERT = _SPLIT + """, o1 AS (SELECT platform, post_id, arg_max(struct_pack(a := like_count, b := canonical_url), pos) AS v FROM o GROUP BY 1, 2), n1 AS (SELECT platform, post_id, arg_max(struct_pack(a := like_count, b := canonical_url), pos) AS w FROM n GROUP BY 1, 2),
j AS (SELECT platform, post_id, CASE WHEN w IS NULL THEN v ELSE w END AS z, CASE WHEN w IS NULL THEN 'kept' WHEN v IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM o1 FULL JOIN n1 USING (platform, post_id)) """


def _upserted(spark, d):
    old, new = _halves(spark, d)
    cols = ["platform", "post_id", "like_count", "canonical_url"]
    first = rel.upsert_latest(old.select(cols).limit(0), old.select(*cols, "pos"), ["platform", "post_id"], "pos").drop("action")
    return rel.upsert_latest(first, new.select(*cols, "pos"), ["platform", "post_id"], "pos")


@query(_UPSERT + "SELECT platform, post_id, z.a AS like_count, z.b AS canonical_url, action FROM j")
def upsert_posts(spark, d):
    return _upserted(spark, d)


@query(_UPSERT + "SELECT action, count(*) AS n FROM j GROUP BY 1")
def import_summary(spark, d):
    return _upserted(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query(", p AS (SELECT DISTINCT platform, post_id FROM c WHERE platform IS NOT NULL), w AS (SELECT DISTINCT keyword FROM c) SELECT platform, post_id, keyword FROM p, w")
def post_keyword_cross(spark, d):
    c = classified(spark, d)
    return rel.post_keywords(c.where("platform is not null"), c.select("keyword"))


@query("SELECT DISTINCT platform, post_id, keyword FROM c WHERE platform IS NOT NULL")
def post_keyword_precise(spark, d):
    return classified(spark, d).where("platform is not null").select("platform", "post_id", "keyword").distinct()


_UNIQUE = ", p AS (SELECT * FROM c WHERE platform IS NOT NULL QUALIFY row_number() OVER (PARTITION BY platform, post_id ORDER BY pos) = 1) "


def _unique(spark, d):
    c = classified(spark, d).where("platform is not null").select("platform", "post_id", "canonical_url", "pos")
    return rel.dedupe_first(c, ["platform", "post_id"], "pos")


@query(_UNIQUE + "SELECT platform, post_id, pos FROM p ORDER BY platform DESC, pos LIMIT 1200")
def running_limit(spark, d):
    order = _unique(spark, d).withColumn("platform_ord", F.when(F.col("platform") == "x", 0).otherwise(1))
    return rel.running_limit(order, "platform_ord", ["pos"], 1200).select("platform", "post_id", "pos")


@query(", f AS (SELECT *, min(pos) OVER (PARTITION BY platform, post_id) AS fp FROM c) SELECT pos, CASE WHEN platform IS NULL OR platform <> 'facebook' THEN 'unsupported_facebook_url' WHEN pos > fp THEN 'duplicate_facebook_post' END AS skip_reason FROM f")
def dedupe_mark(spark, d):
    return rel.mark_batch(classified(spark, d)).select("pos", "skip_reason")


@query(""", f AS (SELECT *, min(pos) OVER (PARTITION BY platform, post_id) AS fp FROM c), s AS (SELECT pos, CASE WHEN platform IS NULL OR platform <> 'facebook' THEN 'unsupported_facebook_url' WHEN pos > fp THEN 'duplicate_facebook_post' END AS skip_reason FROM f),
r AS (SELECT *, count(*) FILTER (skip_reason IS NULL) OVER (ORDER BY pos) AS seen FROM s) SELECT pos, skip_reason FROM r WHERE seen <= 100""")
def limit_supported(spark, d):
    return rel.mark_batch(classified(spark, d), 100).select("pos", "skip_reason")


@query(""", e AS (SELECT user_id, pos, error_message = 'login wall found' OR keyword = 'error' AS bad, status <> 'skipped' AS done FROM c), g AS (SELECT *, coalesce(bad AND lag(bad) OVER (PARTITION BY user_id ORDER BY pos), false) AS trip FROM e WHERE done),
t AS (SELECT user_id, min(pos) AS trip_pos FROM g WHERE trip GROUP BY 1) SELECT user_id, pos, coalesce(pos > trip_pos, false) AS stopped FROM e LEFT JOIN t USING (user_id)""")
def login_wall_breaker(spark, d):
    bad = F.coalesce((F.col("error_message") == "login wall found") | (F.col("keyword") == "error"), F.lit(False))
    return rel.login_breaker(views.search(spark, d), "user_id", "pos", bad, processed=F.col("status") != "skipped").select("user_id", "pos", "stopped")


@query("""SELECT pos, CASE WHEN pos % 3 = 0 THEN 'Anna Bell' END AS author, CASE WHEN pos % 3 = 0 THEN 'Green river walk ' || (pos % 7) WHEN pos % 3 = 1 THEN title END AS content FROM c""")
def title_context(spark, d):
    return views.search(spark, d).select("pos", txt.title_context(F.col("title")).alias("t")).select("pos", "t.*")


@query("SELECT pos, CAST(CASE WHEN title IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS overlap FROM c")
def title_overlap(spark, d):
    return views.search(spark, d).select("pos", F.round(txt.title_overlap(F.col("snippet"), txt.title_context(F.col("title"))["content"]), 6).alias("overlap"))


_LOW = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"SELECT doc_id, length({_LOW}) >= 20 AND NOT regexp_matches({_LOW}, '{'|'.join(txt.POST_BLOCKED)}') AS post, length({_LOW}) >= 2 AND NOT regexp_matches({_LOW}, '{'|'.join(txt.COMMENT_BLOCKED)}') AS comment FROM documents")
def looks_like_text(spark, d):
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", txt.looks_like_post(t).alias("post"), txt.looks_like_comment(t).alias("comment"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches({_LOW}, 'log in|sign up|sign in') THEN 'login_wall' WHEN regexp_matches({_LOW}, 'this post is unavailable|something went wrong|account suspended|this account has been suspended') THEN 'unavailable' ELSE 'ok' END AS state FROM documents")
def page_state_markers(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", txt.page_state(F.col("text"), "x").alias("state"))


_COMMENTS = ", mm AS (SELECT conv_id, turn, role, text, concat(role, '|', lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS k FROM conversations), uu AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) = 1) "


def _comments(spark, d):
    m = spark.read.parquet(f"{d}/conversations.parquet").withColumn("k", F.concat_ws("|", "role", F.lower(txt.collapse(F.col("text")))))
    return rel.dedupe_first(m, ["conv_id", "k"], "turn")


@query(_COMMENTS + "SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS comments FROM uu GROUP BY 1")
def comments_dedupe(spark, d):
    each = _comments(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return each.select("conv_id", F.size("c").cast("bigint").alias("n"), F.array_join("c.text", "\n").alias("comments"))


@query(_COMMENTS + "SELECT conv_id, turn, text FROM uu QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def comment_cap(spark, d):
    return rel.rank_per_key(_comments(spark, d), ["conv_id"], "turn").where("rank <= 3").select("conv_id", "turn", "text")


@query("SELECT count(*) AS comments, count(DISTINCT conv_id) AS posts FROM conversations")
def comment_total(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").agg(F.count("*").alias("comments"), F.count_distinct("conv_id").alias("posts"))


@query("""SELECT pos, regexp_replace('<input type="password" value="s' || pos || '"><p>' || keyword || '</p>', '(value=")[^"]*(")', '\\1[REDACTED]\\2') AS html FROM c""")
def redact_inputs(spark, d):
    html = F.concat(F.lit('<input type="password" value="s'), F.col("pos"), F.lit('"><p>'), F.col("keyword"), F.lit("</p>"))
    return views.search(spark, d).select("pos", txt.redact_inputs(html).alias("html"))
